"""Changes that come late, repeated and in another order than they were made, over several batches and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge.operators import mutation
from spanforge.streaming import ordered


def change(path, op, seq, minute, repo="r"):
    return {"repo_id": repo, "path": path, "op": op, "seq": seq, "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"}


@pytest.fixture
def stream(spark, tmp_path):
    store = mutation.Store(spark, f"file://{tmp_path}/store", buckets=4)
    rows = [("r", p, "old") for p in "abcde"] + [("q", "a", "old")]
    store.write("file", spark.createDataFrame(rows, "repo_id string, path string, body string"))
    (tmp_path / "in").mkdir()
    files = iter(range(99))

    def arrive(*changes):
        number = next(files)
        (tmp_path / "in" / f"{number:02d}.json").write_text("\n".join(map(json.dumps, changes)))
        load = lambda keys: keys.withColumn("body", F.lit(f"new{number}"))
        ordered.run(ordered.changes(spark, f"file://{tmp_path}/in"), store, "file", load, f"file://{tmp_path}/checkpoint", late="30 minutes")
        return {(r.repo_id, r.path): r.body for r in store.read("file").collect()}

    return store, arrive


def test_the_newest_change_holds_whatever_the_order(stream):
    store, arrive = stream
    got = arrive(change("a", "M", 5, 60), change("b", "R", 6, 61), change("b", "M", 4, 59), change("a", "M", 5, 60), change("z", "A", 7, 62))
    assert got == {("r", "a"): "new0", ("r", "c"): "old", ("r", "d"): "old", ("r", "e"): "old", ("q", "a"): "old", ("r", "z"): "new0"}
    # Every call is a restart from the checkpoint. Older changes of a, b and z, one of which is repeated, do nothing.
    got = arrive(change("a", "R", 3, 58), change("b", "M", 5, 60), change("z", "A", 7, 62), change("c", "R", 8, 63), change("a", "R", 9, 63, "q"))
    assert got == {("r", "a"): "new0", ("r", "d"): "old", ("r", "e"): "old", ("r", "z"): "new0"}
    got = arrive(change("b", "A", 10, 64), {**change("d", "R", None, 64)}, {**change("d", "R", 11, 64), "ts": None})
    assert got == {("r", "a"): "new0", ("r", "b"): "new2", ("r", "d"): "old", ("r", "e"): "old", ("r", "z"): "new0"}


def test_rows_behind_the_watermark_are_dropped_and_state_goes(stream):
    store, arrive = stream
    arrive(change("a", "M", 5, 60))
    arrive(change("c", "M", 6, 300))  # the watermark goes to 270
    got = arrive(change("d", "R", 7, 100), change("e", "R", 8, 290))  # the first is too late
    assert got[("r", "d")] == "old" and ("r", "e") not in got
    got = arrive(change("a", "R", 2, 310))  # a's state has gone by now: what is made in time counts as new
    assert ("r", "a") not in got
