"""Whole runs: from a folder of sources to the tables of a store, and from a diff to a reviewed change set."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.paths import inside, is_binary, is_lock, is_skipped_module, modules_to_skip
from spanforge.functions.text import head_tail, token_estimate
from spanforge.operators import impact, retrieval, review, search
from spanforge.operators.mutation import Store, change_operations, latest_operation, plan_sync
from spanforge.plans.staging import staged
from spanforge.sources import files, parsing

TABLES = {
    "file": "repo_id string, path string, language string, summary string",
    "node": "repo_id string, path string, id string, type string, kind string, name string, content string, start_line int, end_line int",
    "edge": "repo_id string, path string, src string, src_label string, dst string, dst_label string, type string",
    "vector": "repo_id string, path string, id string, text string, embedding array<float>",
}
TARGETS = {"import": ("IMPORTS", "Module"), "call": ("CALLS", "Function"), "definition": ("DEFINES", "CodeBlock")}


def tables_of(sources: DataFrame, embed: Callable[[Column], Column]) -> dict[str, DataFrame]:
    """The store's rows of source files (repo_id, path, content, language), and errors of files that can't be parsed.

    The files are read and parsed once, and what is found is written; all tables are made of that. Imports of standard
    modules make no edge; vectors are of each file's summary and of each definition's text.
    """
    parsed = staged(parsing.parse(sources, heads=True), "parsed")
    sources = parsed.where("type = 'source'").select("repo_id", "path", "content", F.col("kind").alias("language"))
    nodes = parsing.node_ids(parsed.where("type <> 'source'"))
    good = nodes.where("type <> 'error'")
    summary = parsing.summaries(sources, good)
    file = sources.join(summary, ["repo_id", "path"]).select("repo_id", "path", "language", "summary")
    kept = good.where((F.col("type") != "import") | ~is_skipped_module(F.col("name"), modules_to_skip()))
    pick = lambda i: F.coalesce(*[F.when(F.col("type") == t, x[i]) for t, x in TARGETS.items()])
    edge = kept.select("repo_id", "path", F.col("path").alias("src"), F.lit("File").alias("src_label"), F.col("name").alias("dst"), pick(1).alias("dst_label"), pick(0).alias("type")).distinct()
    contains = file.select("repo_id", "path", F.col("repo_id").alias("src"), F.lit("Repository").alias("src_label"), F.col("path").alias("dst"), F.lit("File").alias("dst_label"), F.lit("CONTAINS").alias("type"))
    blocks = good.where("type = 'definition'").select("repo_id", "path", "id", head_tail(F.col("content")).alias("text"))
    texts = blocks.unionByName(file.select("repo_id", "path", parsing.file_id().alias("id"), F.col("summary").alias("text"))).dropDuplicates(["id"])
    return {
        "file": file,
        "node": good.select(*[x.split()[0] for x in TABLES["node"].split(", ")]).dropDuplicates(["repo_id", "path", "id", "start_line"]),
        "edge": edge.unionByName(contains),
        "vector": texts.withColumn("embedding", embed(F.col("text"))),
        "source": sources,
        "error": nodes.where("type = 'error'").select("repo_id", "path", "error"),
    }


def counts(store: Store, repo_id: str | None = None) -> dict[str, int]:
    """Rows of each table, of one repository or in all (A4)."""
    one = lambda rows: rows if repo_id is None else rows.where(F.col("repo_id") == repo_id)
    return {name: one(store.read(name)).count() for name in TABLES}


def index(spark: SparkSession, store: Store, root: str, repo_id: str, head: str | None = None, changes: DataFrame | None = None, embed: Callable[[Column], Column] | None = None) -> dict:
    """Bring a repository's tables up to its folder; {mode, status, files, deleted, errors}.

    Without changes, or without an earlier commit, or with too many, all is indexed anew (under version control the
    tracked files, so what .gitignore names is left out), else the files named in changes (letter, path, new_path)
    since the last indexed commit, and no others are opened: removals, then additions and modifications. All
    tables and the commit's name change together, or nothing does. Files that can't be parsed make the run partial;
    their commit counts as indexed, as they are the same next time.
    """
    embed = embed or parsing.embedder()
    for name, schema in TABLES.items():
        store.ensure(name, schema, by=["repo_id", "path"])
    last = store.metadata(f"commit:{repo_id}")
    mode = "full" if changes is None or head is None else plan_sync(changes, last, head)
    if mode == "nothing":
        return {"mode": mode, "status": "success", "files": 0, "deleted": 0, "errors": 0}
    key, deleted = ["repo_id"], 0
    gone = spark.createDataFrame([(repo_id,)], "repo_id string")
    if mode == "incremental":
        operations = change_operations(changes).withColumn("place", F.when(F.col("op") == "R", 0).otherwise(1))
        operations = latest_operation(operations, ["path"], ["place"]).withColumn("repo_id", F.lit(repo_id))
        key, gone = ["repo_id", "path"], operations.select("repo_id", "path")
        listed = operations.select("path", "op").collect()  # MOST_CHANGES at most
        deleted = sum(r["op"] == "R" for r in listed)
        sources = files.named_files(spark, root, repo_id, [r["path"] for r in listed if r["op"] != "R"])
    else:
        sources = files.source_files(spark, root, repo_id, files.tracked_files(local(root)))
    rows = tables_of(sources, embed)
    new = {name: store.replaced(name, gone, key, rows[name].select(*store.read(name).columns)) for name in TABLES}
    store.commit(new, {f"commit:{repo_id}": head} if head is not None else None)
    errors = rows["error"].count()
    return {"mode": mode, "status": "partial" if errors else "success", "files": rows["source"].count(), "deleted": deleted, "errors": errors}


def local(root: str) -> str:
    """A folder's path for programs of this machine."""
    return root.removeprefix("file://").removeprefix("file:")


def update(spark: SparkSession, store: Store, root: str, repo_id: str, embed: Callable[[Column], Column] | None = None) -> dict:
    """index() of a checked-out repository: what changed since the commit indexed last, as version control tells it.

    Where that commit is not known any more, or nothing is under version control, all is indexed anew.
    """
    head, last = files.head_commit(local(root)), store.metadata(f"commit:{repo_id}")
    changes = None
    if head is not None and last is not None and last != head:
        try:
            changes = files.changed_letters(spark, local(root), last, head)
        except subprocess.CalledProcessError:
            changes = None  # the history was rewritten
    elif head is not None and last == head:
        return {"mode": "nothing", "status": "success", "files": 0, "deleted": 0, "errors": 0}
    return index(spark, store, root, repo_id, head, changes, embed)


def review_working(spark: SparkSession, store: Store, root: str, repo_id: str, policies: list[dict], staged_only: bool = False, base: str | None = None, **options) -> dict[str, DataFrame]:
    """reviewed() of what is changed in a checked-out repository (S9): its working tree, what is staged, or since a base."""
    diff = spark.createDataFrame([(files.working_diff(local(root), staged_only, base),)], "diff string")
    return reviewed(store, repo_id, diff, files.source_files(spark, root, repo_id, files.tracked_files(local(root))).select("path", "content"), policies, **options)


def evaluated(spark: SparkSession, store: Store, gold_path: str, embed: Callable[[Column], Column], limit: int = 10, fallback: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """Search for each query of a gold set (S16) in the store's vectors and judge the files found by their paths.

    Files count once, at their best place; queries without a vector take the fallback's (V12).
    """
    gold = files.gold_set(spark, gold_path)
    asked = search.embedded_queries(gold.select(F.col("id").alias("qid"), F.col("query").alias("text")), embed, fallback or embed)
    hits = search.nearest(store.read("vector"), asked, limit, keep=("path",), skip_self=False)
    best = Window.partitionBy("qid").orderBy("first", "path")
    found = hits.groupBy("qid", "path").agg(F.min("rank").alias("first")).withColumn("rank", F.row_number().over(best)).drop("first")
    wanted = gold.select(F.col("id").alias("qid"), F.explode_outer("expected_paths").alias("expected"))
    by_query = staged(retrieval.judged_by_path(found, wanted).join(gold.select(F.col("id").alias("qid"), "category"), "qid"), "judged")
    return {"queries": by_query, "all": retrieval.summary(by_query), "categories": retrieval.summary(by_query, ["category"]), "missing": retrieval.missing_by_path(found, wanted)}


def reviewed(store: Store, repo_id: str, diff: DataFrame, contents: DataFrame, policies: list[dict], budget: int = 8000, limit: int = 10) -> dict[str, DataFrame]:
    """From a diff (one row) to what a reviewer needs: changed, violations, impact, context and verdict.

    Changed files are the diff's sections but for lock files. Impact ranks their dependants; context keeps of these,
    by rank, what fits the budget of tokens: contents (path, content) that lie in the repository and are text.
    Verdict is the rule that needs no model, for each changed file.
    """
    changed = files.split_diffs(diff).where(~is_lock(F.col("path"))).select(F.lit(repo_id).alias("repo_id"), "path", F.col("section").alias("diff"))
    edge = store.read("edge")
    of = lambda kind, name: edge.where(F.col("type") == kind).select("repo_id", "path", F.col("dst").alias(name))
    radius = impact.radius(changed.select("repo_id", "path"), of("IMPORTS", "module"), of("DEFINES", "name"), of("CALLS", "name"), limit, together=changed)
    safe = contents.where(inside("/repo", F.col("path")) & ~is_binary(F.col("path")) & F.col("content").isNotNull())
    items = radius.join(safe.select("path", "content"), "path").withColumn("tokens", token_estimate(F.col("content")))
    kept = review.budgeted_items(items, "changed", ["rank", "path"], "tokens", budget)
    context = kept.where("kept").join(safe.select("path", "content"), "path").select("changed", "rank", "path", "tokens", "content")
    has = lambda rows, flag: rows.groupBy(F.col("changed").alias("path")).agg(F.lit(True).alias(flag))
    flags = changed.select("path").join(has(context, "_context"), "path", "left").join(has(radius, "_impact"), "path", "left")
    verdict = review.verdict(F.coalesce("_context", F.lit(False)), F.coalesce("_impact", F.lit(False)))
    return {"changed": changed, "violations": review.violations(policies, changed), "impact": radius, "context": context, "verdict": flags.select("path", verdict.alias("v")).select("path", "v.risk_level", "v.confidence")}


def synced(operations: DataFrame) -> DataFrame:
    """Files synced, changed and deleted (A13) of rows (op)."""
    return operations.agg(F.count(F.lit(1)).alias("files_synced"), F.count_if(F.col("op") != "R").alias("changed"), F.count_if(F.col("op") == "R").alias("deleted"))


def worst(results: DataFrame) -> DataFrame:
    """The status of a run from those of its parts."""
    return retrieval.rollup(results, [])
