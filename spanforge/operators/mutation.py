"""Changes to keyed tables, and a store of versioned snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanforge.functions.text import payload
from spanforge.operators.governance import rejected
from spanforge.plans.staging import staged

#: git's letters for changes.
LETTERS = {"A": "A", "D": "R", "M": "M"}
MOST_CHANGES = 100


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Existing rows whose key doesn't come in, and the last incoming row of each key (K2-K4)."""
    if order is not None:
        value = F.struct(*[c for c in incoming.columns if c not in key])
        incoming = incoming.groupBy(*key).agg(F.max_by(value, F.col(order)).alias("_v")).select(*key, "_v.*")
    else:
        incoming = incoming.dropDuplicates(key)
    return existing.join(incoming, key, "left_anti").unionByName(incoming.select(*existing.columns))


def delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def delete_files(files: DataFrame, blocks: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with their blocks and edges go; modules and functions stay even if nothing refers to them."""
    key = ["repo_id", "path"]
    source = gone.select("repo_id", F.col("path").alias("src"))
    return delete(files, gone, key), delete(blocks, gone, key), delete(edges, source, ["repo_id", "src"])


def delete_out_edges(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Imports and calls of changed files go, definitions stay (K7)."""
    mark = changed.select("repo_id", F.col("path").alias("src"), F.lit(True).alias("_changed")).distinct()
    return edges.join(mark, ["repo_id", "src"], "left").where("_changed is null or type not in ('IMPORTS', 'CALLS')").drop("_changed")


def change_operations(diff: DataFrame) -> DataFrame:
    """(path, op) of rows (letter, path, new_path): a rename removes one path and adds another; copies, type
    changes and unknown letters count as modifications of the path they end at (S8)."""
    end = F.coalesce("new_path", "path")
    one = lambda op, path: F.array(F.struct(F.lit(op).alias("op"), path.alias("path")))
    rows = F.when(F.col("letter").startswith("R"), F.concat(one("R", F.col("path")), one("A", F.col("new_path"))))
    for letter, op in LETTERS.items():
        rows = rows.when(F.col("letter") == letter, one(op, F.col("path")))
    return diff.select(F.explode(rows.otherwise(one("M", end))).alias("c")).select("c.path", "c.op")


def latest_operation(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return changes.groupBy(*key).agg(F.max_by("op", F.struct(*order)).alias("op"))


def changeset(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Operations that lead from one snapshot to another."""
    a, b = old.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_old")), new.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_new"))
    op = F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "R").when(~F.col("_a").eqNullSafe(F.col("_b")), "M")
    return a.join(b, key, "full_outer").select(*key, op.alias("op")).where("op is not null")


def apply_changes(rows: DataFrame, changes: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Removed and modified keys go, fresh rows of added and modified ones come (T4)."""
    gone = changes.where("op in ('R', 'M', 'A')").select(*key).distinct()
    come = fresh.join(changes.where("op in ('A', 'M')").select(*key).distinct(), key, "left_semi")
    return rows.join(gone, key, "left_anti").unionByName(come)


class Store:
    """Named tables in a folder. A commit changes any number of tables and notes together, or nothing.

    A table's rows lie in buckets by a hash of the columns `by` (repository and path where it has them); a version
    names a folder for each bucket, and a change writes only the buckets whose rows it touches. The whole state is a
    small numbered file that appears by one rename, and the highest number holds: readers keep the state they began
    with, and a crash leaves the one before. One writer at a time: a number that another has taken is an error.
    `at_version` reads older versions, `vacuum` removes them.
    """

    def __init__(self, spark: SparkSession, root: str, dimension: int | None = None, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if dimension is not None:
            kept = self.metadata("dimension")
            if kept is None:
                self.set_metadata("dimension", str(dimension))
            elif int(kept) != dimension:
                raise ValueError(f"the store holds vectors of {kept} numbers, not {dimension}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def state(self) -> dict:
        """{number, tables: {name: {schema, by, buckets, versions: [{bucket: folder}]}}, metadata}"""
        names = [n for n in self._names(f"{self.root}/_state") if n.endswith(".json") and not n.startswith("_")]
        if not names:
            return {"number": 0, "tables": {}, "metadata": {}}
        stream = self._fs.open(self._path(f"{self.root}/_state/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, tables: dict[str, dict] | None = None, metadata: dict[str, str] | None = None, state: dict | None = None) -> None:
        """Make new versions (from written() and replaced()) current, and set notes, all at once."""
        state = state or self.state()
        for name, table in (tables or {}).items():
            before = state["tables"].get(name, {"versions": []})
            state["tables"][name] = {**table, "versions": [*before["versions"], table["versions"][-1]]}
        state["metadata"] |= metadata or {}
        state["number"] += 1
        final, new = self._path(f"{self.root}/_state/{state['number']:012d}.json"), self._path(f"{self.root}/_state/_{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(new, final):
            self._fs.delete(new, False)
            raise OSError("another writer has committed; nothing was changed")

    def _bucket(self, by: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by]), F.lit(buckets)).cast("int")

    def written(self, name: str, rows: DataFrame, by: list[str] | None = None, buckets: int | None = None, rest: dict | None = None) -> dict:
        """A new version of a table: rows written to folders of their own, and the rest of the buckets as they were."""
        by = by or (["repo_id", "path"] if {"repo_id", "path"} <= set(rows.columns) else rows.columns[:1])
        buckets, folder = buckets or self.buckets, f"v-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(by, buckets)).write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{folder}")
        new = {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self._names(f"{self.root}/{name}/{folder}") if n.startswith("_bucket=")}
        return {"schema": rows.schema.json(), "by": by, "buckets": buckets, "versions": [{**(rest or {}), **new}]}

    def replaced(self, name: str, gone: DataFrame, key: list[str], rows: DataFrame | None = None) -> dict:
        """A new version without the rows of the keys that go, and with other rows; only the buckets of both are read
        and written, if the key tells the bucket."""
        table = self.state()["tables"][name]
        version, by, buckets = table["versions"][-1], table["by"], table["buckets"]
        if set(by) <= set(key):
            keys = gone.select(*by)
            if rows is not None:
                keys = keys.unionByName(rows.select(*by))
            touched = {str(r[0]) for r in keys.select(self._bucket(by, buckets)).distinct().collect()}
        else:
            touched = {str(b) for b in range(buckets)}
        now = delete(self._rows(name, table, {b: f for b, f in version.items() if b in touched}), gone, key)
        if rows is not None:
            now = now.unionByName(rows.select(*now.columns))
        return self.written(name, now, by, buckets, {b: f for b, f in version.items() if b not in touched})

    def _rows(self, name: str, table: dict, version: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(table["schema"]))
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in version.values()])

    def write(self, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        self.commit({name: self.written(name, rows, by)})

    def read(self, name: str, at_version: int = -1) -> DataFrame:
        table = self.state()["tables"][name]
        return self._rows(name, table, table["versions"][at_version])

    def exists(self, name: str) -> bool:
        return name in self.state()["tables"]

    def ensure(self, name: str, schema: str, by: list[str] | None = None) -> None:
        """The table, empty if it isn't there yet."""
        if not self.exists(name):
            self.write(name, self.spark.createDataFrame([], schema), by)

    def merge(self, name: str, incoming: DataFrame, key: list[str], order: str | None = None) -> None:
        if order is not None:
            value = F.struct(*[c for c in incoming.columns if c not in key])
            incoming = incoming.groupBy(*key).agg(F.max_by(value, F.col(order)).alias("_v")).select(*key, "_v.*")
        else:
            incoming = incoming.dropDuplicates(key)
        if self.exists(name):
            self.commit({name: self.replaced(name, incoming.select(*key), key, incoming)})
        else:
            self.write(name, incoming, by=None if {"repo_id", "path"} <= set(key) else key)

    def remove(self, name: str, gone: DataFrame, key: list[str]) -> int:
        """Delete by key; how many rows went (K9)."""
        n = self.read(name).join(gone, key, "left_semi").count()
        if n:
            self.commit({name: self.replaced(name, gone, key)})
        return n

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Forget all versions but the last ones, then delete the folders that none of these has."""
        state = self.state()
        table = state["tables"][name]
        table["versions"] = table["versions"][-keep:]
        self.commit(state=state)
        kept = {f for v in table["versions"] for f in v.values()}
        for folder in self._names(f"{self.root}/{name}"):
            for part in self._names(f"{self.root}/{name}/{folder}"):
                if part.startswith("_bucket=") and f"{folder}/{part}" not in kept:
                    self._fs.delete(self._path(f"{self.root}/{name}/{folder}/{part}"), True)

    def copy_to(self, other: Store, names: list[str], least: float = 0.5) -> dict[str, bool]:
        """Migration to another store in one commit, and for each table whether it holds enough there."""
        other.commit({name: other.written(name, self.read(name), self.state()["tables"][name]["by"]) for name in names})
        return {name: other.read(name).count() >= least * self.read(name).count() for name in names}

    def metadata(self, key: str) -> str | None:
        """Of the store, such as a repository's last indexed commit."""
        return self.state()["metadata"].get(key)

    def set_metadata(self, key: str, value: str) -> None:
        self.commit(metadata={key: value})


VECTOR = "id string, embedding array<float>, payload map<string,string>"


def add_texts(store: Store, rows: DataFrame, embed: Callable[[Column], Column], table: str = "added") -> DataFrame:
    """Append (text, meta map<string,string>) to a table of vectors under random ids, as one batch (K1); (id, payload).

    The rows are embedded and written once, before the table takes them, so a task that is run again gives no second id;
    a failure leaves the table as it was.
    """
    store.ensure(table, VECTOR, by=["id"])
    new = staged(rows.select(F.uuid().alias("id"), embed(F.col("text")).alias("embedding"), payload(F.col("text"), F.col("meta")).alias("payload")), "added")
    store.commit({table: store.replaced(table, new.select("id"), ["id"], new)})
    return new.select("id", "payload")


POLICY = "id string, type string, pattern string, severity string, message string, precept_id string"


def put_policies(store: Store, policies: DataFrame) -> None:
    """Create or replace policies by id (K12); those that break their bounds are refused as a whole."""
    faults = rejected(policies, "policy_rule").limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{f['id']}: {f['field']} {f['reason']}" for f in faults))
    store.ensure("policy", POLICY, by=["id"])
    store.merge("policy", policies.select(*[x.split()[0] for x in POLICY.split(", ")]), ["id"])


def policies(store: Store) -> DataFrame:
    """All policies, by id."""
    store.ensure("policy", POLICY, by=["id"])
    return store.read("policy").orderBy("id")


def drop_policy(store: Store, policy_id: str) -> bool:
    """Whether there was one."""
    store.ensure("policy", POLICY, by=["id"])
    return store.remove("policy", store.spark.createDataFrame([(policy_id,)], "id string"), ["id"]) > 0


def put_pull_requests(store: Store, requests: DataFrame, changed: DataFrame) -> None:
    """Upsert (repo_id, number, title) and the files (repo_id, number, path) they change, those that are there."""
    store.ensure("pull_request", "repo_id string, number long, title string", by=["repo_id", "number"])
    store.ensure("modifies", "repo_id string, number long, path string", by=["repo_id", "number"])
    key = ["repo_id", "number"]
    requests = requests.dropDuplicates(key)
    known = changed.select("repo_id", "number", "path").distinct().join(store.read("file").select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    known = known.join(requests.select(*key), key, "left_semi")
    store.commit({"pull_request": store.replaced("pull_request", requests.select(*key), key, requests), "modifies": store.replaced("modifies", requests.select(*key), key, known)})


def plan_sync(changes: DataFrame, last: str | None, head: str) -> str:
    """What an update must do: nothing, all anew, or the changes; too many changes also mean all anew."""
    if last == head:
        return "nothing"
    if last is None or changes.limit(MOST_CHANGES + 1).count() > MOST_CHANGES:
        return "full"
    return "incremental"
