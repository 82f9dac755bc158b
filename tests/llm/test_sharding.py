"""The k-d tree against brute force: widest dimensions, exact weighted medians, one hot key divided."""

import random

import pytest

from spanforge.llm import sharding


def spread_of(rows, d):
    return max(r[d] for r in rows) - min(r[d] for r in rows) if rows else 0


def check(node, rows, dimensions, tolerance):
    if node.left is None:
        return 1
    assert node.dimension in dimensions
    if rows:
        assert spread_of(rows, node.dimension) == max(spread_of(rows, d) for d in dimensions)
    left, right = ([r for r in rows if (r[node.dimension] < node.at) == side] for side in (True, False))
    total, part = sum(r["size"] for r in rows), node.left.leaves / node.leaves
    goal, got = total * part, sum(r["size"] for r in left)
    # Brute force: the best cut between two different keys.
    sums, best, run = sorted((r[node.dimension], r["size"]) for r in rows), float(total), 0
    for i, (key, size) in enumerate(sums):
        run += size
        if i + 1 == len(sums) or sums[i + 1][0] != key:
            best = min(best, abs(run - goal))
    assert abs(got - goal) <= max(min(best, goal), tolerance * total / node.leaves) + 1e-6
    return check(node.left, left, dimensions, tolerance) + check(node.right, right, dimensions, tolerance)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    few = [rnd.getrandbits(16) << 47 for _ in range(5)]
    rows = []
    for _ in range(400):
        hot = rnd.random() < 0.35  # a third of the rows share the first digits of a key
        rows.append({"a": few[0] | rnd.getrandbits(47) if hot else rnd.getrandbits(63), "b": rnd.choice(few) | rnd.getrandbits(47), "size": rnd.choice([8, 50, 900, 20_000])})
    df = spark.createDataFrame([(r["a"], r["b"], r["size"]) for r in rows], "k_a long, k_b long, size long")
    for shards in (2, 7, 24):
        root = sharding.tree(df, shards, ["a", "b"])
        assert check(root, rows, ["a", "b"], 0.001) == shards
        assert sorted(n.first for n in sharding.leaves(root)) == list(range(shards))


def test_tree_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame([(5, 9, 100)] * 50, "k_a long, k_b long, size long")
    assert len(sharding.leaves(sharding.tree(same, 4, ["a", "b"]))) == 4
    assert len(sharding.leaves(sharding.tree(same.limit(0), 4, ["a", "b"]))) == 4
