"""Reverse-dependency impact of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.paths import is_critical, stem
from spanforge.plans import staging


def stem_importers(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """(changed, path): files that import a module whose name begins with the changed file's stem.

    A prefix condition would compare every pair. Instead each distinct module is listed under its prefixes of
    the lengths that stems have, which the equality of the join then finds. What is broadcast has a row for each
    distinct length, so no more rows than the longest file name has characters.
    """
    stems = changed.select("repo_id", F.col("path").alias("changed"), stem(F.col("path")).alias("stem"))
    return stems.join(named_by(stems, imports, "stem"), ["repo_id", "stem"]).where("path <> changed").select("repo_id", "changed", "path").distinct()


def named_by(names: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    """(repo_id, name, path): files that import a module that begins with a name (a stem) or ends with it (a symbol)."""
    lengths = names.select(F.length(name).alias("n")).where("n > 0").distinct()
    modules = imports.select("repo_id", "module").distinct()
    part = F.expr("substr(module, 1, n)" if name == "stem" else "right(module, n)").alias(name)
    parts = modules.join(F.broadcast(lengths), F.length("module") >= F.col("n")).select("repo_id", "module", part)
    known = parts.join(names.select("repo_id", name).distinct(), ["repo_id", name], "left_semi")
    return known.join(imports.select("repo_id", "module", "path"), ["repo_id", "module"]).select("repo_id", name, "path").distinct()


def importer_counts(changed: DataFrame, imports: DataFrame, defines: DataFrame | None = None) -> DataFrame:
    """(repo_id, changed, importers): how many files stem_importers finds, or symbol_importers if defines are given;
    counted by stem or symbol, so a module that many import makes no pairs with the files that it is named for."""
    if defines is None:
        name, mine = "stem", changed.select("repo_id", "path", stem(F.col("path")).alias("stem"))
    else:
        name, mine = "symbol", defines.join(changed, ["repo_id", "path"], "left_semi").select("repo_id", "path", F.col("name").alias("symbol"))
    found = named_by(mine, imports, name)
    return caller_counts(changed, mine.withColumnRenamed(name, "name"), found.withColumnRenamed(name, "name"), written=False).withColumnRenamed("callers", "importers")


def callers(changed: DataFrame, defines: DataFrame, calls: DataFrame) -> DataFrame:
    """Files that call a function of a name that the changed file defines."""
    mine = defines.join(changed, ["repo_id", "path"], "left_semi").select("repo_id", F.col("path").alias("changed"), "name")
    return mine.join(calls.select("repo_id", "name", "path"), ["repo_id", "name"]).where("path <> changed").select("repo_id", "changed", "path").distinct()


#: Names of a file up to which they are counted in pairs.
MOST_NAMES = 32


def caller_counts(changed: DataFrame, defines: DataFrame, calls: DataFrame, written: bool = True) -> DataFrame:
    """(repo_id, changed, callers): how many files callers() finds for each changed file that has any.

    A name that many files define and many call would make all their pairs. A file's callers are those of each of its
    names, so names are counted once, less those counted again (repeated_callers) and the file itself. Files that define
    the same names are counted as one kind. Without `written`, the last join works the files out again, so that its plan
    shows how they are found.
    """
    file = ["path", "repo_id"]
    listed = lambda rows, out: rows.groupBy(*file).agg(F.sort_array(F.collect_set("name")).alias(out))
    known = defines.select(*file, "name").join(changed.select(*file), file, "left_semi")
    both = listed(known, "names").join(listed(calls.select(*file, "name").dropna(subset=file), "called"), file, "full")
    files = staging.staged(both.withColumn("no", F.monotonically_increasing_id()), "files")
    kinds = staging.staged(files.where("size(names) > 0").select("names", "repo_id").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    each = files.select(F.explode("called").alias("name"), "repo_id").groupBy("name", "repo_id").agg(F.count(F.lit(1)).alias("n"))
    total = kinds.select("kind", "repo_id", F.explode("names").alias("name")).join(each, ["name", "repo_id"]).groupBy("kind").agg(F.sum("n").alias("n"))
    again = repeated_callers(kinds.where("size(names) > 1"), files)
    by_kind = kinds.join(total, "kind").join(again, "kind", "left").select("names", "repo_id", (F.col("n") - F.coalesce("again", F.lit(0))).alias("n"))
    own = F.coalesce(F.arrays_overlap("names", "called"), F.lit(False)).cast("int")
    found = (files if written else both).where("size(names) > 0").join(by_kind, ["names", "repo_id"])
    return found.select("repo_id", F.col("path").alias("changed"), (F.col("n") - own).alias("callers")).where("callers > 0")


def repeated_callers(kinds: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, again) from kinds (kind, repo_id, names) and files (no, repo_id, called): a file that calls m of a kind's names
    counts m - 1.

    Few files call two names that some file defines together, so pairs of names are matched, of kinds and of files with at
    most MOST_NAMES of them. A kind of two names takes a pair's number of files; of one with more, a file that calls m is
    met m * (m - 1) / 2 times. What has more names is met name by name.
    """
    def pairs(rows: DataFrame, names: str, *keep: str) -> DataFrame:
        first = rows.select(*keep, "repo_id", names, F.explode(names).alias("a"))
        return first.select(*keep, "repo_id", "a", F.explode(names).alias("b")).where("a < b")

    def by_name(some: DataFrame, callers_: DataFrame) -> DataFrame:
        asked = some.select("kind", "repo_id", F.explode("names").alias("name"))
        met = asked.join(callers_.select("no", "repo_id", F.explode("called").alias("name")), ["name", "repo_id"])
        return met.groupBy("kind", "no").agg((F.count(F.lit(1)) - 1).alias("n"))

    pair = ["a", "b", "repo_id"]
    narrow, wide = kinds.where(F.size("names") <= MOST_NAMES), kinds.where(F.size("names") > MOST_NAMES)
    wanted = pairs(narrow.withColumn("two", F.size("names") == 2), "names", "kind", "two")
    made = pairs(files.where(F.size("called") <= MOST_NAMES), "called", "no")
    hits = staging.staged(made.join(wanted.select(*pair).distinct(), pair, "left_semi"), "called-pairs")
    twos = wanted.where("two").join(hits.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")), pair).select("kind", "n")
    more = wanted.where("not two").join(hits, pair).groupBy("kind", "no").agg(F.count(F.lit(1)).alias("p"))
    more = more.select("kind", F.expr("cast(round((sqrt(1 + 8 * p) - 1) / 2) as bigint)").alias("n"))
    rest = by_name(wide, files).unionByName(by_name(narrow, files.where(F.size("called") > MOST_NAMES))).select("kind", "n")
    return twos.unionByName(more).unionByName(rest).groupBy("kind").agg(F.sum("n").alias("again"))


def symbol_importers(changed: DataFrame, defines: DataFrame, imports: DataFrame) -> DataFrame:
    """Files that import a module whose name ends with a name that the changed file defines (J7); as J5, by suffixes.

    A row for each distinct length of a name is broadcast, no more than the longest name has characters."""
    mine = defines.join(changed, ["repo_id", "path"], "left_semi").select("repo_id", F.col("path").alias("changed"), F.col("name").alias("symbol"))
    return mine.join(named_by(mine, imports, "symbol"), ["repo_id", "symbol"]).where("path <> changed").select("repo_id", "changed", "path").distinct()


def first_hits(mine: DataFrame, named: DataFrame, limit: int) -> DataFrame:
    """(repo_id, changed, path) from mine (repo_id, path, name) and named (repo_id, name, path), equal names: of each
    name only the first limit + 1 paths by (critical, path).

    A path that no other kind of hit names scores the same as all others of its kind, but for being critical. So if it
    is among the first `limit` of a file, it is among the first of each of its names, the file itself not counted.
    """
    order = Window.partitionBy("repo_id", "name").orderBy(is_critical(F.col("path")).desc(), "path")
    first = named.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit + 1).drop("_n")
    return mine.withColumnRenamed("path", "changed").join(first, ["repo_id", "name"]).where("path <> changed").select("repo_id", "changed", "path").distinct()


def radius(changed: DataFrame, imports: DataFrame, defines: DataFrame, calls: DataFrame, limit: int = 10, together: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Ranked dependants of every changed file, at most `limit` each (V9).

    Hits weigh 1, 1 and 0.5; the relationship is that of the first kind of hit; critical paths gain 5. Only hits by stem
    are all ranked. Callers that are no other kind of hit come from the first of each name (first_hits), and so do files
    that only import a symbol. Files that do both are told as the symbol's importers are met. If a name of a file has
    more than `limit` callers, there are `limit` hits of 1 at least, so what only imports a symbol must be critical; if
    it has so many critical callers, what is not critical, or only imports a symbol, is not among the first.
    """
    file = changed.select("repo_id", "path").distinct()
    # Each is read several times.
    mine = staging.staged(defines.select("repo_id", "path", "name").join(file, ["repo_id", "path"], "left_semi").distinct(), "defined")
    made = staging.staged(calls.select("repo_id", "name", "path").distinct(), "called")
    imports = staging.staged(imports.select("repo_id", "module", "path").distinct(), "imported")
    symbols = staging.staged(named_by(mine.withColumnRenamed("name", "symbol"), imports, "symbol").withColumnRenamed("symbol", "name"), "symbols")
    key = ["repo_id", "changed", "path"]
    flags = lambda rows, *on: rows.select(*key, *[F.lit(f in on).alias(f) for f in ("stem", "call", "symbol")])
    alike = lambda rows: rows.groupBy(*key).agg(*[F.max(f).alias(f) for f in ("stem", "call", "symbol")])
    # A file's names, of those it defines, calls or imports, are few, so a pair is looked up in the names of its files.
    names = lambda x, out: x.groupBy("repo_id", "path").agg(F.collect_set("name").alias(out))
    shared = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    counts = made.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_critical(F.col("path"))).alias("critical"))
    own = mine.join(counts, ["repo_id", "name"], "left").groupBy("repo_id", F.col("path").alias("changed"))
    own = own.agg(F.collect_set("name").alias("_defined"), F.coalesce(F.max("n"), F.lit(0)).alias("_callers"), F.coalesce(F.max("critical"), F.lit(0)).alias("_critical"))
    called = names(made, "_called")

    by_name = Window.partitionBy("repo_id", "name").orderBy(is_critical(F.col("path")).desc(), "path")
    placed = symbols.withColumn("_first", F.row_number().over(by_name) <= limit + 1).withColumn("_core", is_critical(F.col("path")))
    importing = placed.join(called, ["repo_id", "path"], "left")
    met = mine.withColumnRenamed("path", "changed").join(own, ["repo_id", "changed"]).join(importing, ["repo_id", "name"])
    met = met.where((F.col("path") != F.col("changed")) & (F.col("_core") | (F.col("_critical") <= limit)))
    met = met.select(*key, F.lit(False).alias("stem"), shared("_defined", "_called").alias("call"), (F.col("_first") & (F.col("_critical") <= limit) & (F.col("_core") | (F.col("_callers") <= limit))).alias("alone"))
    by_symbol = met.where("call or alone").select(*key, "stem", "call", F.lit(True).alias("symbol"))

    stems = stem_importers(changed, imports).join(own, ["repo_id", "changed"], "left").join(called, ["repo_id", "path"], "left").join(names(symbols, "_imported"), ["repo_id", "path"], "left")
    by_stem = stems.select(*key, F.lit(True).alias("stem"), shared("_defined", "_called").alias("call"), shared("_defined", "_imported").alias("symbol"))
    hits = alike(by_symbol.unionAll(by_stem).unionAll(flags(first_hits(mine, made, limit), "call")))
    part = lambda flag, weight: F.when(F.col(flag), weight).otherwise(0.0)
    score = part("stem", 1.0) + part("call", 1.0) + part("symbol", 0.5) + F.when(is_critical(F.col("path")), 5.0).otherwise(0.0)
    relationship = F.when(F.col("stem") | ~F.col("call"), "IMPORTS").otherwise("CALLS")
    total = hits.select(*key, score.alias("score"), relationship.alias("relationship"))
    order = Window.partitionBy("repo_id", "changed").orderBy(F.col("score").desc(), "path")
    out = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    for rows, flag in ((together, "co_changed"), (deleted, "co_deleted")):
        if rows is not None:
            mark = rows.select("repo_id", "path").distinct().withColumn(flag, F.lit(True))
            out = out.join(mark, ["repo_id", "path"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out
