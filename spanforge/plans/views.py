"""The data model of code graphs, derived from the generated tables, in DataFrames and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of the largest table that a task is given.
LINES = 1 << 18


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def repository(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def orders(self) -> DataFrame:
        """(o_orderkey, repo_id, o_orderstatus) of orders with a customer and a nation."""
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
        return rows.select("o_orderkey", F.col("n_regionkey").cast("string").alias("repo_id"), "o_orderstatus")

    @cached_property
    def file(self) -> DataFrame:
        return self.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("path"), "repo_id", F.col("o_orderstatus").alias("status"))

    @cached_property
    def parts(self) -> int:
        """Parts of about LINES lines each, so that what a task sorts or groups doesn't grow with the table."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table("lineitem").count() // LINES))

    def lines(self, condition: str, target: str, shared: bool = False) -> DataFrame:
        """(src, dst, repo_id), distinct; with `shared`, files have the paths that several repositories have."""
        key = target[1:]
        found = self.numbers(condition, key, not shared)
        if shared:
            found = found.select(F.expr("l_orderkey div 5").alias("file"), key, "repo_id").repartition(self.parts, "file").distinct()
            return found.select(F.concat(F.lit("f"), "file").alias("src"), F.concat(F.lit(target[0]), key).alias("dst"), "repo_id")
        return found.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit(target[0]), key).alias("dst"), "repo_id")

    def numbers(self, condition: str, key: str, distinct: bool = True) -> DataFrame:
        """(l_orderkey, key, repo_id): numbers move and not the texts made of them, once for the distinct rows and the join."""
        rows = self.table("lineitem").where(condition).select("l_orderkey", key).repartition(self.parts, "l_orderkey")
        return (rows.distinct() if distinct else rows).join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", key, "repo_id")

    @cached_property
    def imports(self) -> DataFrame:
        return self.lines("true", "pl_partkey")

    @cached_property
    def defines(self) -> DataFrame:
        return self.lines("l_linenumber = 1", "sl_suppkey")

    @cached_property
    def calls(self) -> DataFrame:
        return self.lines("l_linenumber <> 1", "sl_suppkey")

    @cached_property
    def modifies(self) -> DataFrame:
        return self.table("orders").select(F.col("o_custkey").alias("number"), F.concat(F.lit("o"), "o_orderkey").alias("path"))

    @cached_property
    def doc_paths(self) -> DataFrame:
        top = F.when(F.col("doc_id") % 7 == 0, "tests/").otherwise("src/")
        return self.table("documents").select("doc_id", F.concat(top, "lang", F.lit("/"), "source", F.lit("/d"), "doc_id", F.lit(".py")).alias("path"), F.col("lang").alias("type"), F.col("source").alias("repo"), "text")

    @cached_property
    def vectors(self) -> DataFrame:
        e = self.table("embeddings")
        return e.join(self.doc_paths, e["vec_id"] == F.col("doc_id")).select(F.col("vec_id").alias("id"), "embedding", "path", "type", "repo", "label")

    @cached_property
    def doc_refs(self) -> DataFrame:
        return self.doc_paths.select(F.col("path").alias("src"), F.col("repo").alias("dst"), F.lit("docs").alias("repo_id"), F.lit("IMPORTS").alias("type"))

    @cached_property
    def graph(self) -> DataFrame:
        return self.edges(self.imports, self.calls)

    def edges(self, imports: DataFrame, calls: DataFrame) -> DataFrame:
        out = None
        for rows, kind, label in ((imports, "IMPORTS", "Module"), (calls, "CALLS", "Function")):
            part = rows.select("src", F.lit("File").alias("src_label"), "dst", F.lit(label).alias("dst_label"), F.lit(kind).alias("type"), "repo_id")
            out = part if out is None else out.unionByName(part)
        return out

    @cached_property
    def nodes(self) -> DataFrame:
        targets = self.graph.select(F.col("dst_label").alias("label"), "repo_id", F.col("dst").alias("id")).distinct()
        return self.file.select(F.lit("File").alias("label"), "repo_id", F.col("path").alias("id")).unionByName(targets)

    # The same edges with files whose paths several repositories have.
    def shared_path(self, column: str) -> Column:
        return F.concat(F.lit("f"), F.expr(f"cast(substr({column}, 2) as bigint) div 5"))

    @cached_property
    def sedge(self) -> DataFrame:
        return self.edges(self.lines("true", "pl_partkey", True), self.lines("l_linenumber <> 1", "sl_suppkey", True))

    @cached_property
    def sdefines(self) -> DataFrame:
        return self.defines.select("repo_id", self.shared_path("src").alias("path"), F.col("dst").alias("name")).distinct()

    @cached_property
    def smodifies(self) -> DataFrame:
        return self.modifies.join(self.file, "path").select("number", "repo_id", self.shared_path("path").alias("path")).distinct()

    # A second graph, of parts: files that import modules named for a part and a symbol of it.
    @cached_property
    def ifile(self) -> DataFrame:
        p = F.col("p_partkey")
        folder = F.when(p % 11 == 0, "core/").otherwise("src/")
        return self.table("part").select(F.concat(folder, F.lit("p"), p, F.lit(".rs")).alias("path"), (p % 5).cast("string").alias("repo_id"), p.alias("key"))

    def part_lines(self, condition: str) -> DataFrame:
        rows = self.table("lineitem").where(condition).select(F.col("l_partkey").alias("key"), "l_suppkey").repartition(self.parts, "key").distinct()
        return rows.join(self.ifile, "key").select("path", F.concat(F.lit("s"), "l_suppkey").alias("name"), "repo_id")

    @cached_property
    def idef(self) -> DataFrame:
        return self.part_lines("l_linenumber = 1")

    @cached_property
    def icall(self) -> DataFrame:
        return self.part_lines("l_linenumber <> 1")

    @cached_property
    def iimp(self) -> DataFrame:
        first = self.table("lineitem").where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("key"))
        second = self.table("lineitem").where("l_linenumber = 2").select("l_orderkey", "l_partkey", "l_suppkey")
        rows = first.join(second, "l_orderkey").select("key", "l_partkey", "l_suppkey").repartition(self.parts, "key").distinct()
        return rows.join(self.ifile, "key").select("path", F.concat(F.lit("p"), "l_partkey", F.lit("::s"), "l_suppkey").alias("module"), "repo_id")


#: The same as DuckDB's common table expressions, each with those before it.
SQL = r"""
repository AS (SELECT r_regionkey::VARCHAR AS id, r_name AS name FROM region),
file AS (SELECT 'o' || o_orderkey AS path, n_regionkey::VARCHAR AS repo_id, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
imports AS (SELECT DISTINCT path AS src, 'p' || l_partkey AS dst, repo_id FROM lineitem JOIN file ON path = 'o' || l_orderkey),
defines AS (SELECT DISTINCT path AS src, 's' || l_suppkey AS dst, repo_id FROM lineitem JOIN file ON path = 'o' || l_orderkey WHERE l_linenumber = 1),
calls AS (SELECT DISTINCT path AS src, 's' || l_suppkey AS dst, repo_id FROM lineitem JOIN file ON path = 'o' || l_orderkey WHERE l_linenumber <> 1),
modifies AS (SELECT o_custkey AS number, 'o' || o_orderkey AS path FROM orders),
doc_paths AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE 'src/' END || lang || '/' || source || '/d' || doc_id || '.py' AS path, lang AS type, source AS repo, text FROM documents),
vectors AS (SELECT vec_id AS id, embedding, path, type, repo, label FROM embeddings JOIN doc_paths ON vec_id = doc_id),
graph AS (SELECT src, 'File' AS src_label, dst, 'Module' AS dst_label, 'IMPORTS' AS type, repo_id FROM imports
  UNION ALL SELECT src, 'File', dst, 'Function', 'CALLS', repo_id FROM calls),
sedge AS (SELECT DISTINCT 'f' || (substr(src, 2)::BIGINT // 5) AS src, src_label, dst, dst_label, type, repo_id FROM graph),
sdefines AS (SELECT DISTINCT repo_id, 'f' || (substr(src, 2)::BIGINT // 5) AS path, dst AS name FROM defines),
smodifies AS (SELECT DISTINCT number, repo_id, 'f' || (substr(path, 2)::BIGINT // 5) AS path FROM modifies JOIN file USING (path)),
nodes AS (SELECT 'File' AS label, repo_id, path AS id FROM file UNION ALL SELECT DISTINCT dst_label, repo_id, dst FROM graph),
ifile AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'core/' ELSE 'src/' END || 'p' || p_partkey || '.rs' AS path, (p_partkey % 5)::VARCHAR AS repo_id, p_partkey AS key FROM part),
idef AS (SELECT DISTINCT path, 's' || l_suppkey AS name, repo_id FROM lineitem JOIN ifile ON key = l_partkey WHERE l_linenumber = 1),
icall AS (SELECT DISTINCT path, 's' || l_suppkey AS name, repo_id FROM lineitem JOIN ifile ON key = l_partkey WHERE l_linenumber <> 1),
iimp AS (SELECT DISTINCT path, 'p' || b.l_partkey || '::s' || b.l_suppkey AS module, repo_id
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 JOIN ifile ON key = a.l_partkey)
"""


def sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([SQL.strip(), *more]) + "\n" + body
