"""Retrieval quality and experiment figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_path(a: Column, b: Column) -> Column:
    """One path ends with the other, in lower case."""
    a, b = F.lower(a), F.lower(b)
    return F.endswith(a, b) | F.endswith(b, a)


def judged(results: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (3, 5)) -> DataFrame:
    """By query: reciprocal rank of the first relevant result, and recall at each cut.

    results: (qid, id, rank); gold: (qid, expected), a row for each relevant id. A query of gold without results
    scores 0; gold with a null expected means that nothing is expected, which is recall 1.
    """
    wanted = gold.groupBy("qid").agg(F.count("expected").alias("n"))
    hits = results.join(gold.select("qid", F.col("expected").alias("id")).distinct(), ["qid", "id"])
    return scored(wanted, hits, "id", cuts)


def scored(wanted: DataFrame, hits: DataFrame, what: str, cuts: tuple[int, ...]) -> DataFrame:
    """reciprocal_rank and recalls of queries (qid, n) with their hits (qid, rank, what)."""
    by = hits.groupBy("qid").agg(F.min("rank").alias("first"), *[F.count_distinct(F.when(F.col("rank") <= k, F.col(what))).alias(f"h{k}") for k in cuts])
    recall = [F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.coalesce(f"h{k}", F.lit(0)) / F.greatest("n", F.lit(1)), 6)).alias(f"recall_at_{k}") for k in cuts]
    return wanted.join(by, "qid", "left").select("qid", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), *recall)


def by_number(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (qid, category) of queries of one category, and of those of several."""
    known = asked.where("qid is not null and category is not null").select("qid", "category").distinct()
    number = known.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return known.join(number.where("n = 1"), "qid", "left_semi"), known.join(number.where("n > 1"), "qid", "left_semi")


def pairs(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Gold of queries (qid, category): each member (id, category, ...) of its category but the query itself."""
    return asked.join(members, "category").where("id <> qid")


def judged_by_category(results: DataFrame, asked: DataFrame, members: DataFrame, cuts: tuple[int, ...] = (3, 5)) -> DataFrame:
    """judged() of queries (qid, category) of which each expects all members (id, category) of its category but itself;
    those without any are left out.

    What is expected is counted by category, and results are looked up among the members, so the pairs of queries and
    members are not made; only queries that have several categories, whose members may be the same, make theirs.
    """
    members = members.where("id is not null").select("id", "category").distinct()
    one, several = by_number(asked)
    sizes = members.groupBy("category").agg(F.count(F.lit(1)).alias("all"))
    own = members.select(F.col("id").alias("qid"), "category", F.lit(1).alias("own"))
    wanted = one.join(sizes, "category").join(own, ["qid", "category"], "left").select("qid", (F.col("all") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    hits = results.join(one, "qid").where("id <> qid").join(members, ["id", "category"], "left_semi")
    more = pairs(several, members).select("qid", F.col("id").alias("expected")).distinct()
    return scored(wanted, hits, "id", cuts).unionByName(judged(results, more, cuts))


def suffix_matches(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, path, rank, expected) of results (qid, path, rank) and expected paths (qid, expected) of which one ends
    with the other, in lower case (P16); expected ones are in lower case.

    Both ways are equalities: a path is listed with its ends of the lengths that the other side has for the same
    query, so no pair is tested that doesn't match.
    """
    return ends_meet(results, gold.where("expected is not null").select("qid", F.lower("expected").alias("expected")).distinct(), "qid").select("qid", "path", "rank", "expected")


def ends_meet(results: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """Results (by, path, ...) and gold (by, expected, ...), distinct and in lower case, that match within `by`."""
    r, g = results.where("path is not null").withColumn("low", F.lower("path")), gold
    lengths = lambda rows, c: rows.groupBy(by).agg(F.collect_set(F.length(c)).alias("lengths"))
    ends = lambda c, longest: F.explode(F.transform(F.filter("lengths", lambda n: n <= longest), lambda n: F.col(c).substr(F.length(c) - n + 1, n)))
    longer = r.join(lengths(g, "expected"), by).select(*results.columns, ends("low", F.length("low")).alias("expected")).join(g, [by, "expected"])
    shorter = g.join(lengths(r, "low"), by).select(*g.columns, ends("expected", F.length("expected") - 1).alias("low")).join(r, [by, "low"]).drop("low")
    return longer.unionByName(shorter)


def expectations(members: DataFrame) -> DataFrame:
    """(category, expected, first, last): distinct paths in lower case, with the least and highest id that has them."""
    return members.where("id is not null and expected is not null").groupBy("category", F.lower("expected").alias("expected")).agg(F.min("id").alias("first"), F.max("id").alias("last"))


def suffix_matches_by_category(results: DataFrame, asked: DataFrame, members: DataFrame) -> DataFrame:
    """suffix_matches() of queries (qid, category) of which each expects the paths of all members (id, category,
    expected) of its category but its own: matched within categories, so that queries don't repeat their members."""
    known = asked.where("category is not null").select("qid", "category").distinct()
    met = ends_meet(results.select("qid", "path", "rank").join(known, "qid"), expectations(members), "category")
    return met.where("not (first = qid and last = qid)").select("qid", "path", "rank", "expected").distinct()


def judged_by_path(results: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (3, 5)) -> DataFrame:
    """judged() where a result is relevant if its path and an expected one match by their ends."""
    wanted = gold.groupBy("qid").agg(F.count_distinct(F.lower("expected")).alias("n"))
    return scored(wanted, suffix_matches(results, gold), "expected", cuts)


def judged_by_path_and_category(results: DataFrame, asked: DataFrame, members: DataFrame, cuts: tuple[int, ...] = (3, 5)) -> DataFrame:
    """judged_by_path() of queries as in suffix_matches_by_category; as there and in judged_by_category, no pairs of
    queries and members are made but for queries that have several categories."""
    members = members.where("id is not null")
    one, several = by_number(asked)
    all_paths = expectations(members)
    ids = members.groupBy("category").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    sizes = all_paths.groupBy("category").agg(F.count(F.lit(1)).alias("all"))
    own = all_paths.where("first = last").groupBy("category", F.col("first").alias("qid")).agg(F.count(F.lit(1)).alias("own"))
    wanted = one.join(ids, "category").where("not (low = qid and high = qid)").join(sizes, "category", "left").join(own, ["qid", "category"], "left").select("qid", (F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("n"))
    more = pairs(several, members).groupBy("qid").agg(F.count_distinct(F.lower("expected")).alias("n"))
    return scored(wanted.unionByName(more), suffix_matches_by_category(results, asked, members), "expected", cuts)


def missing_by_path(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, expected): expected paths that no result matches by its end (U5), as they are written."""
    found = suffix_matches(results, gold).select("qid", F.col("expected").alias("low")).distinct()
    return gold.where("expected is not null").withColumn("low", F.lower("expected")).join(found, ["qid", "low"], "left_anti").select("qid", "expected")


def summary(by_query: DataFrame, by: list[str] | None = None, cuts: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Queries, MRR, mean recalls and hit rate."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))
    return by_query.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("queries"), mean("reciprocal_rank").alias("mrr"), *[mean(f"recall_at_{k}").alias(f"recall_at_{k}") for k in cuts], mean(F.when(F.col("reciprocal_rank") > 0, 1.0).otherwise(0.0)).alias("hit_rate"))


def missing(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Expected ids that no result has."""
    return gold.where("expected is not null").join(results.select("qid", F.col("id").alias("expected")), ["qid", "expected"], "left_anti")


def lift(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Change in percent from base, null where base is 0, and a word for it."""
    both = base.select(key, F.col(value).alias("base")).join(other.select(key, F.col(value).alias("experiment")), key)
    percent = F.when(F.col("base") != 0, F.round((F.col("experiment") - F.col("base")) / F.col("base") * 100, 2))
    return both.withColumn("lift_percent", percent).withColumn("badge", F.when(percent.isNull(), "N/A").when(percent > 0, "better").when(percent < 0, "worse").otherwise("same"))


def rollup(results: DataFrame, group: list[str]) -> DataFrame:
    """Worst status, and sums (A12): failed before partial before success."""
    severity = F.max(F.when(F.col("status") == "failed", 2).when(F.col("status") == "partial", 1).otherwise(0))
    return results.groupBy(*group).agg(F.when(severity == 2, "failed").when(severity == 1, "partial").otherwise("success").alias("status"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"))


def experiment(tickets: DataFrame, group: list[str]) -> DataFrame:
    """Figures of an agent benchmark (A15). tickets: quality, hallucinations, trap, correctness, tokens_in, tokens_out."""
    trap = F.count_if("trap")
    return tickets.groupBy(*group).agg(
        F.count(F.lit(1)).alias("tickets"),
        F.round(F.avg("quality"), 4).alias("mean_quality"),
        F.round(F.avg(F.when(F.col("hallucinations") > 0, 1.0).otherwise(0.0)), 4).alias("hallucination_rate"),
        F.round(F.when(trap > 0, F.count_if(F.col("trap") & (F.col("correctness") >= 4)) / trap).otherwise(0.0), 4).alias("refactor_success"),
        F.round(F.when(F.sum("tokens_in") > 0, F.sum("tokens_out") / F.sum("tokens_in")).otherwise(0.0), 4).alias("compression"),
    )


def migrated(source: DataFrame, target: DataFrame, least: float = 0.5) -> DataFrame:
    """By label: counts on both sides and whether the target holds enough."""
    a, b = (x.groupBy("label").agg(F.count(F.lit(1)).alias(n)) for x, n in ((source, "source_rows"), (target, "target_rows")))
    both = a.join(b, "label", "left").withColumn("target_rows", F.coalesce("target_rows", F.lit(0)))
    return both.withColumn("ok", F.col("target_rows") >= F.col("source_rows") * least)
