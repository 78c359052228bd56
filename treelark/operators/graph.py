"""The index as a graph: resolution, references, neighbours, closeness and impact."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as k
from ..functions import text as t

JS_ENDINGS = tuple("ts tsx js jsx mjs cjs".split())
#: Counted rows of a frontier that are sent to every task, some 100 bytes each.
FEW = 10_000


def kept(df: DataFrame) -> DataFrame:
    """A small result that a query uses more than once, such as directory edges: made once, as a reliable checkpoint."""
    return _cut(df, {})


def _cut(df: DataFrame, state: dict) -> DataFrame:
    """Cuts a loop's lineage by a reliable checkpoint; the folder is the cluster's, or one of our own where none is set."""
    sc = df.sparkSession.sparkContext
    if not state.get("set"):
        if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().isDefined()):
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="treelark-checkpoints-"))
        state["set"] = True
    return df.checkpoint()


def joined_path(base: Column, raw: Column) -> Column:
    """A relative path against a directory, with . and .. taken out."""
    parts = F.split(F.concat_ws("/", base, raw), "/")
    fold = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(fold, "/")


def script_candidates(from_file: Column, raw: Column) -> Column:
    """Files a relative import may mean, in order: another ending for a .js one, as written, with an ending, as a directory."""
    at = joined_path(t.dirname(from_file), raw)
    bare = F.regexp_replace(at, r"\.(m|c)?jsx?$", "")
    swapped = F.when(bare != at, F.array(*(F.concat(bare, F.lit(e)) for e in (".ts", ".tsx")))).otherwise(F.array().cast("array<string>"))
    return F.concat(swapped, F.array(at, *(F.concat(at, F.lit(f".{e}")) for e in JS_ENDINGS), *(F.concat(at, F.lit(f"/index.{e}")) for e in JS_ENDINGS)))


def python_candidates(from_file: Column, raw: Column) -> Column:
    """Files a Python import may mean: leading dots name parents; an absolute one is tried from each ancestor; x.py first."""
    here = t.dirname(from_file)
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(raw, r"^\.+", ""), r"\.", "/")
    up = F.element_at(t.ancestors(here), F.greatest(dots, F.lit(1)))
    bases = F.when(dots > 0, F.array(up)).otherwise(t.ancestors(here))
    return F.flatten(F.transform(bases, lambda b: F.transform(F.array(F.lit(".py"), F.lit("/__init__.py")), lambda e: F.regexp_replace(F.concat(F.when(b == ".", F.lit("")).otherwise(F.concat(b, F.lit("/"))), rest, e), r"^/|//", ""))))


def resolve(edges: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """edges with resolved_to: the first candidate that is a file, null for none. An equi-join on exploded candidates."""
    keyed = edges.withColumn("_edge", F.struct(*edges.columns))
    tried = keyed.select("_edge", F.posexplode(candidates).alias("pos", "candidate"))
    found = tried.join(files.select(F.col("file").alias("candidate")).distinct(), "candidate").groupBy("_edge").agg(F.min_by("candidate", "pos").alias("resolved_to"))
    return keyed.join(found, "_edge", "left").drop("_edge")


def backfill(tentative: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """References of (file, raw, name, at): by the first import edge of the same raw to the symbol of that name there."""
    first = imports.where("resolved_to IS NOT NULL").groupBy("from_file", "raw").agg(F.min_by("resolved_to", "line").alias("target"))
    each = symbols.groupBy(F.col("file").alias("target"), "name").agg(F.min_by("id", "at").alias("symbol_id"))
    return tentative.join(first, (F.col("file") == F.col("from_file")) & (tentative["raw"] == first["raw"])).select("file", "name", "at", "target").join(each, ["target", "name"]).select("symbol_id", "file", "at")


def dir_edges(imports: DataFrame) -> DataFrame:
    """(from_dir, to_dir, weight) of resolved imports between different directories."""
    return imports.where("resolved_to IS NOT NULL AND from_dir <> to_dir").groupBy("from_dir", "to_dir").agg(F.count("*").alias("weight"))


def importers(imports: DataFrame, file: str) -> DataFrame:
    return imports.where(F.col("resolved_to") == file).select(F.col("from_file").alias("file")).distinct()


def importees(imports: DataFrame, file: str) -> DataFrame:
    return imports.where((F.col("from_file") == file) & F.col("resolved_to").isNotNull()).select(F.col("resolved_to").alias("file")).distinct()


def references_to(references: DataFrame, symbols: DataFrame, name: str | None = None, file: str | None = None) -> DataFrame:
    """References of the symbols of that name or file; symbols are filtered before the join."""
    s = symbols
    if name is not None:
        s = s.where(F.col("name") == name)
    if file is not None:
        s = s.where(F.col("file") == file)
    return references.join(s.select(F.col("id").alias("symbol_id"), "name", F.col("file").alias("defined_in")), "symbol_id")


def references_from(references: DataFrame, symbols: DataFrame, file: str) -> DataFrame:
    return references.where(F.col("file") == file).join(symbols.select(F.col("id").alias("symbol_id"), "name", F.col("file").alias("defined_in")), "symbol_id")


def find_definitions(symbols: DataFrame, name: str, file: str | None = None, directory: str | None = None) -> DataFrame:
    s = symbols.where(F.col("name") == name)
    if file is not None:
        s = s.where(F.col("file") == file)
    if directory is not None:
        s = s.where(t.in_scope(F.col("file"), F.lit(directory)))
    return s


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """Exported names with exactly one definition."""
    return symbols.where("exported").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("file").alias("file")).where("n = 1").drop("n")


def caller_sets(references: DataFrame, low: int = 2, high: int = 20) -> DataFrame:
    """(symbol_id, callers): distinct files that use a symbol, where there are low to high of them."""
    return references.groupBy("symbol_id").agg(F.countDistinct("file").alias("callers")).where(F.col("callers").between(low, high))


def siblings(imports: DataFrame, file: str) -> DataFrame:
    """Other files of the directory that some import names."""
    ends = imports.select(F.explode(F.array("from_file", "resolved_to")).alias("file")).where("file IS NOT NULL").distinct()
    return ends.where((t.dirname(F.col("file")) == file.rsplit("/", 1)[0]) & (F.col("file") != file))


def neighbour_dirs(edges: DataFrame, directory: str) -> DataFrame:
    """(dir, strength): the larger weight of either direction."""
    out = edges.where(F.col("from_dir") == directory).select(F.col("to_dir").alias("dir"), "weight").unionByName(edges.where(F.col("to_dir") == directory).select(F.col("from_dir").alias("dir"), "weight"))
    return out.groupBy("dir").agg(F.max("weight").alias("strength"))


def find_related(imports: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """(file, reason, strength): importers, importees, neighbouring directories and siblings, each with its strongest reason
    (of equals the first kind)."""
    directory = file.rsplit("/", 1)[0]
    into = imports.where(F.col("resolved_to") == file).groupBy(F.col("from_file").alias("file")).agg(F.count("*").alias("strength")).withColumn("kind", F.lit(0))
    out = imports.where((F.col("from_file") == file) & F.col("resolved_to").isNotNull()).groupBy(F.col("resolved_to").alias("file")).agg(F.count("*").alias("strength")).withColumn("kind", F.lit(1))
    near = neighbour_dirs(edges, directory).select(F.col("dir").alias("file"), "strength", F.lit(2).alias("kind"))
    beside = siblings(imports, file).select("file", F.lit(1).cast("long").alias("strength"), F.lit(3).alias("kind"))
    every = into.unionByName(out).unionByName(near).unionByName(beside)
    best = Window.partitionBy("file").orderBy(F.desc("strength"), "kind")
    names = F.array(*map(F.lit, ("importer", "importee", "dir_neighbor", "sibling")))
    return every.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("file", F.element_at(names, F.col("kind") + 1).alias("reason"), "strength")


def proximity(edges: DataFrame, seeds: DataFrame, hops: int = k.PROXIMITY_HOPS) -> DataFrame:
    """(dir, hops, prox = 1 / (1 + hops)) of directories within hops of seeds(dir), edges taken both ways."""
    both = edges.select(F.col("from_dir").alias("a"), F.col("to_dir").alias("b")).unionByName(edges.select(F.col("to_dir").alias("a"), F.col("from_dir").alias("b"))).distinct()
    state: dict = {}
    both = _cut(both, state)  # directories and their edges: read once, whatever the hops
    seen = _cut(seeds.select("dir", F.lit(0).alias("hops")).distinct(), state)
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.join(both, F.col("dir") == F.col("a")).select(F.col("b").alias("dir")).distinct().join(seen.select("dir"), "dir", "left_anti").withColumn("hops", F.lit(h))
        frontier = _cut(step, state)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.withColumn("prox", 1 / (1 + F.col("hops")))


def impact(symbols: DataFrame, references: DataFrame, imports: DataFrame, seeds: DataFrame, depth: int = k.IMPACT_DEPTH, results: int = k.IMPACT_RESULTS) -> tuple[DataFrame, dict]:
    """Files that a change of seeds(file, symbol_id or null) reaches: (file, hops, via_kind, via_from), and what stopped it.

    Hop 0 follows references to the seed symbol, or to all exported ones, and every importer of the seed's file; later
    hops follow references to exported symbols, and importers of files that export nothing. Of several ways to a file in one
    hop the smallest (kind, from) is named; where results ends a hop, its first files by name stay. A depth of 0 takes no
    hop. The frontier and what was seen are tables. Pairs of files that references make are made once; imports are read as
    they are in each hop and meet the frontier first, so that few of them go on.
    """
    state: dict = {}
    exported = symbols.where("exported").select(F.col("id").alias("symbol_id"), F.col("file").alias("target"))
    uses = references.select("symbol_id", F.col("file").alias("user"))
    by_ref = _cut(uses.join(exported, "symbol_id").select("target", "user").distinct(), state).withColumn("kind", F.lit("reference"))
    edges = imports.where("resolved_to IS NOT NULL").select(F.col("resolved_to").alias("target"), F.col("from_file").alias("user"), F.lit("import").alias("kind"))

    def met(files: DataFrame, n: int, ways: DataFrame) -> DataFrame:
        """The ways to files(target), of which there are n: few are sent to the ways."""
        return (F.broadcast(files) if n <= FEW else files).join(ways, "target").select("target", "user", "kind")

    named, whole = seeds.agg(F.count("symbol_id"), F.count_if(F.col("symbol_id").isNull())).first()
    seen = seeds.select("file").distinct()
    out, stopped, frontier = None, [], None
    count = n = seen.count()
    for h in range(depth + 1):
        if h and frontier is None:
            break
        at = (frontier if h else seen).select(F.col("file").alias("target"))
        if h:
            ways = met(at, n, by_ref).unionByName(met(at.join(exported.select("target").distinct(), "target", "left_anti"), n, edges))
        else:
            ways = met(at, n, edges)
            if whole:
                ways = ways.unionByName(met(seeds.where("symbol_id IS NULL").select(F.col("file").alias("target")).distinct(), n, by_ref))
            if named:
                symbol = seeds.where("symbol_id IS NOT NULL").select("symbol_id", F.col("file").alias("target"))
                ways = ways.unionByName((F.broadcast(symbol) if named <= FEW else symbol).join(uses, "symbol_id").select("target", "user", F.lit("reference").alias("kind")))
        step = ways.groupBy(F.col("user").alias("file")).agg(F.min(F.struct(F.col("kind"), F.col("target"))).alias("v")).join(seen, "file", "left_anti").select("file", F.lit(h).alias("hops"), F.col("v.kind").alias("via_kind"), F.col("v.target").alias("via_from"))
        if h == depth:
            if not step.isEmpty():
                stopped.append("max_depth")
            break
        step = _cut(step, state)
        n = step.count()
        if count + n > results:
            step = _cut(step.orderBy("file").limit(max(results - count, 0)), state)
            stopped.append("max_results")
        out = step if out is None else out.unionByName(step)
        count += n
        if not n or "max_results" in stopped:
            break
        seen, frontier = seen.unionByName(step.select("file")), step
    if out is None:
        out = seen.select("file", F.lit(0).alias("hops"), F.lit("").alias("via_kind"), F.lit("").alias("via_from")).where("false")
    return out, {"stopped": stopped or ["natural"]}


def affected_scopes(affected: DataFrame) -> DataFrame:
    """(scope, min_hops, files)."""
    return affected.groupBy(t.dirname(F.col("file")).alias("scope")).agg(F.min("hops").alias("min_hops"), F.count("*").alias("files"))


def seeds(symbols: DataFrame, form: str) -> DataFrame:
    """Seeds from 'path#symbol', a file that has symbols, or a symbol's name (all its definitions)."""
    if "#" in form:
        file, name = form.split("#", 1)
        return symbols.where((F.col("file") == file) & (F.col("name") == name)).select("file", F.col("id").alias("symbol_id"))
    if "/" in form or "." in form:
        return symbols.sparkSession.createDataFrame([(form,)], "file string").select("file", F.lit(None).cast(dict(symbols.dtypes)["id"]).alias("symbol_id"))
    return symbols.where(F.col("name") == form).select("file", F.col("id").alias("symbol_id"))


def reverse_dependencies(imports: DataFrame, file: str) -> DataFrame:
    """(file, hop): importers, and their importers."""
    one = importers(imports, file).withColumn("hop", F.lit(1))
    two = imports.join(one.select(F.col("file").alias("resolved_to")), "resolved_to").select(F.col("from_file").alias("file"), F.lit(2).alias("hop")).distinct()
    return one.unionByName(two).groupBy("file").agg(F.min("hop").alias("hop")).where(F.col("file") != file)
