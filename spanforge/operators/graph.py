"""Property graph: building, traversal, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.plans import staging

#: The types of relationship.
RELATIONSHIPS = ("IMPORTS", "CALLS", "DEFINES", "CONTAINS", "MODIFIES", "BELONGS_TO")
EDGE = "id string, src string, src_label string, dst string, dst_label string, type string, repo_id string"


def allowed(types: list[str] | None, strict: bool = False) -> list[str]:
    """Known types among those asked for; none left means all, or an error if strict."""
    unknown = [t for t in types or [] if t not in RELATIONSHIPS]
    if strict and unknown:
        raise ValueError(f"unknown relationship types: {', '.join(unknown)}")
    return [t for t in types or [] if t in RELATIONSHIPS] or list(RELATIONSHIPS)


def clamp_depth(depth: int) -> int:
    return max(1, min(depth, 3))


def edges(refs: DataFrame, type_: str, src_label: str, dst_label: str, distinct: bool = True) -> DataFrame:
    """Distinct edges of one type from (src, dst, repo_id); without `distinct`, as often as refs have them."""
    rows = refs.select("src", "dst", "repo_id")
    return (rows.distinct() if distinct else rows).select("src", F.lit(src_label).alias("src_label"), "dst", F.lit(dst_label).alias("dst_label"), F.lit(type_).alias("type"), "repo_id")


def contains(repositories: DataFrame, files: DataFrame) -> DataFrame:
    """Repository to file; a file without its repository has no edge."""
    return files.join(repositories.select(F.col("id").alias("repo_id")), "repo_id").select(F.col("repo_id").alias("src"), F.col("path").alias("dst"), "repo_id")


NODE = ["label", "repo", "id"]
#: The same for joins: what differs most comes first, as that is what sorts look at first.
NODE_KEY = ["id", "repo", "label"]
ENDS = ["src", "src_label", "dst", "dst_label", "repo_id"]
#: Rows of a frontier in a bucket up to which it is hashed.
HASHED = 1 << 18


def by_both_ends(all_edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(label, repo, id, to_label, to, out, rest): each edge of the types under its two ends, with the other end, whether
    it leaves the node, and the edge's other columns. Ids are texts or numbers."""
    rest = F.struct(*[c for c in all_edges.columns if c not in ENDS])
    e = all_edges.where(F.col("type").isin(allowed(types))).select(*ENDS, rest.alias("rest"), F.explode(F.array(F.lit(True), F.lit(False))).alias("out"))
    end = lambda x, y: F.when(F.col("out"), F.col(x)).otherwise(F.col(y))
    return e.select(end("src_label", "dst_label").alias("label"), F.col("repo_id").alias("repo"), end("src", "dst").alias("id"), end("dst_label", "src_label").alias("to_label"), end("dst", "src").alias("to"), "out", "rest")


def whole_edges(met: DataFrame) -> DataFrame:
    """The edges again, with qid before their columns, from rows of by_both_ends with a qid."""
    end = lambda x, y, name: F.when(F.col("out"), F.col(x)).otherwise(F.col(y)).alias(name)
    known = [x.split()[0] for x in EDGE.split(", ")]
    all_ = met.select("qid", end("id", "to", "src"), end("label", "to_label", "src_label"), end("to", "id", "dst"), end("to_label", "label", "dst_label"), F.col("repo").alias("repo_id"), "rest")
    more = met.schema["rest"].dataType.names
    order = [c for c in known if c in ENDS or c in more] + [c for c in more if c not in known]
    return all_.select("qid", *[F.col(c) if c in ENDS else F.col(f"rest.`{c}`") for c in order])


def adjacency(all_edges: DataFrame, types: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """by_both_ends as a written table, bucketed by node: hops from it read one file a bucket and don't move it. Rows are
    not sorted, as Spark doesn't use the order of a bucket's rows."""
    return staging.bucketed(by_both_ends(all_edges, types), "adjacency", NODE_KEY, buckets, order=False)


def traverse_from(neighbours: DataFrame, starts: DataFrame, depth: int = 1, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reachable from each start over at most `depth` edges, in either direction.

    neighbours: by_both_ends or adjacency of the edges; starts: (qid, label, repo, id), of which several may have one
    qid. Nodes are (qid, label, repo, id, depth), with the least depth; edges are (qid, the columns of edges), each
    once for a qid. A start with an empty repo stands for the nodes of that name in all repositories; one without
    edges is a node alone.

    The frontier is pairs of qid and node. Each hop is one join of it with the neighbours and is written, as is the
    next frontier, without what an earlier one had; so every hop's plan has the same size, and Spark knows whether a
    frontier is small enough to be broadcast. With the number of buckets of an adjacency, a frontier of at most HASHED
    rows a bucket is hashed, so that no hop sorts the neighbours; a larger one is merged.
    """
    starts = staging.staged(starts.select("qid", *NODE), "starts")
    loose, named = starts.where("repo = ''"), starts.where("repo <> ''")
    if not loose.isEmpty():  # else the neighbours are not read for it
        some = neighbours.select(*NODE).join(loose.select("label", "id").distinct(), ["label", "id"], "left_semi").distinct()
        named = named.unionByName(loose.drop("repo").join(some, ["label", "id"]).select("qid", *NODE))
    frontier = staging.staged(named.distinct(), "frontier")
    seen, found = [frontier.withColumn("depth", F.lit(0))], None
    depth = clamp_depth(depth)
    for hop in range(1, depth + 1):
        small = buckets is not None and frontier.count() <= buckets * HASHED
        met = staging.staged(neighbours.join(frontier.hint("shuffle_hash") if small else frontier, NODE_KEY), "hop")
        found = met if found is None else found.unionAll(met)
        new = met.select("qid", F.col("to_label").alias("label"), "repo", F.col("to").alias("id")).distinct()
        for old in seen[-2:]:  # a neighbour's depth differs by one at most, so only the last two can hold it again
            new = new.join(old, ["qid", *NODE_KEY], "left_anti")
        new = new.select("qid", *NODE)
        frontier = staging.staged(new, "frontier") if hop < depth else new
        seen.append(frontier.withColumn("depth", F.lit(hop)))
    nodes = seen[0]
    for level in seen[1:]:
        nodes = nodes.unionByName(level)
    return nodes, whole_edges(found).distinct()


def traverse(all_edges: DataFrame, start: DataFrame, depth: int = 1, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reachable from the starts (label, repo, id) taken together; see traverse_from. The edges of the
    types are written once, so that hops don't work them out again."""
    known = staging.staged(all_edges.where(F.col("type").isin(allowed(types))), "edges")
    nodes, edges_ = traverse_from(by_both_ends(known, types), start.select(F.lit(0).alias("qid"), *NODE), depth)
    return nodes.select(*NODE), edges_.drop("qid")


def stats(nodes: DataFrame, all_edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """node_count, edge_count and density, for all or by repository (A1, A2)."""
    by = by or []
    n = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("node_count"))
    m = all_edges.groupBy(*by).agg(F.count(F.lit(1)).alias("edge_count"))
    both = n.join(m, by, "left") if by else n.crossJoin(m)  # one row each
    both = both.withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
    possible = F.col("node_count") * (F.col("node_count") - 1)
    return both.withColumn("density", F.when(F.col("node_count") > 1, F.round(F.col("edge_count") / possible, 6)).otherwise(0.0))


def directions(all_edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(node, direction, type, n) of every node: how many edges leave and reach it (F22). Nodes of different
    repositories are apart with by = ("repo_id",), whose columns come first."""
    end = lambda name, direction: F.struct(F.col(name).alias("node"), F.lit(direction).alias("direction"))
    both = all_edges.select(*by, "type", F.explode(F.array(end("src", "outgoing"), end("dst", "incoming"))).alias("e"))
    return both.groupBy(*by, "e.node", "e.direction", "type").agg(F.count(F.lit(1)).alias("n"))


#: What a relationship is called at either end.
SECTIONS = {("outgoing", "DEFINES"): "Defines", ("outgoing", "IMPORTS"): "Imports", ("outgoing", "CALLS"): "Calls", ("incoming", "IMPORTS"): "Used by", ("incoming", "CALLS"): "Used by"}


def explore(all_edges: DataFrame, focus: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(repo_id, node, section, others) of each node in focus (repo_id, node), or of all: what it defines, imports and calls, and
    who uses it, sorted (F22, module exploration). Nodes without edges give no row.

    With `most`, the first so many of others and their number `total`: a module that very many use stays one small row.
    """
    name = lambda direction: F.coalesce(*[F.when(F.col("type") == t, s) for (d, t), s in SECTIONS.items() if d == direction], F.lit("Other"))
    near = lambda end: all_edges if focus is None else all_edges.join(focus.withColumnRenamed("node", end), ["repo_id", end], "left_semi")
    out = near("src").select("repo_id", F.col("src").alias("node"), name("outgoing").alias("section"), F.col("dst").alias("other"))
    into = near("dst").select("repo_id", F.col("dst").alias("node"), name("incoming").alias("section"), F.col("src").alias("other"))
    both, key = out.unionAll(into), ["repo_id", "node", "section"]
    if most is None:
        return both.groupBy(*key).agg(F.sort_array(F.collect_set("other")).alias("others"))
    each = both.distinct()
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("other"))).where(F.col("_n") <= most)
    return first.groupBy(*key).agg(F.sort_array(F.collect_list("other")).alias("others")).join(each.groupBy(*key).agg(F.count(F.lit(1)).alias("total")), key)


def repositories(repos: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, files) of every repository, also of those without files."""
    n = files.groupBy(F.col("repo_id").alias("id")).agg(F.count(F.lit(1)).alias("files"))
    return repos.join(n, "id", "left").select("id", "name", F.coalesce("files", F.lit(0)).alias("files"))


def node_names(nodes: DataFrame) -> DataFrame:
    """(id, name): a node's path, else its name, else its id, else `unknown` (P17); a column may be missing."""
    some = [F.col(c).cast("string") for c in ("path", "name", "id") if c in nodes.columns]
    return nodes.select("id", F.coalesce(*some, F.lit("unknown")).alias("name"))


def shown(all_edges: DataFrame, most: int = 5) -> DataFrame:
    """The first edges that reach each node, as reports show them; CONTAINS is left out."""
    order = Window.partitionBy("dst", "repo_id").orderBy("type", "src")
    return all_edges.where("type <> 'CONTAINS'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def file_key(*tables: DataFrame) -> list[str]:
    """What names a file in all the tables: repository and path, or the path alone if one doesn't know repositories."""
    return ["repo_id", "path"] if all("repo_id" in t.columns for t in tables) else ["path"]


def file_pull_requests(modifies: DataFrame, files: DataFrame) -> DataFrame:
    """Pull requests of each known file."""
    key = file_key(modifies, files)
    return modifies.join(files.select(*key).distinct(), key).select(*key, "number")


def pull_request_impact(modifies: DataFrame, files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(number, path, block): files a pull request changes, with the blocks they define, if any.

    With repo_id in modifies and files, files are told apart by it, and it stands before path.
    """
    key = file_key(modifies, files)
    known = modifies.select("number", *key).join(files.select(*key).distinct(), key)
    blocks = blocks.withColumnRenamed("src", "path")
    defined = blocks.select(*file_key(blocks, known), F.col("name").alias("block")).distinct()
    return known.join(defined, file_key(blocks, known), "left").select("number", *key, "block")


def last_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last."""
    value = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(value, F.col(order)).alias("_v")).select(*key, "_v.*")


def nothing(spark) -> tuple[DataFrame, DataFrame]:
    """The empty graph."""
    return spark.createDataFrame([], "label string, repo string, id string"), spark.createDataFrame([], EDGE)
