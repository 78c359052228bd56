"""The named queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as k
from ..functions import text as t
from ..operators import evidence, extract, freshness, graph, history, policy, retrieval, scan, scoring, stats
from ..streaming import watch
from .relations import Tables, with_

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: A search that matches words of the sample texts.
QUERY = "the thonre and herinn eau sch"
ZONES = ["summary", "constraints", "path"]


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def _up(path: str) -> str:
    """DuckDB: a path of up to three segments and its ancestors."""
    return f"list_distinct(list_concat(list_reverse(list_transform(range(1, len(string_split({path}, '/')) + 1), lambda n: array_to_string(list_slice(string_split({path}, '/'), 1, n), '/'))), ['.']))"


def _half_up(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10.0"


# scans, projections, scopes


@query(with_("files", "SELECT dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(ceil(sum(size) / 4) AS BIGINT) AS tokens FROM files GROUP BY dir"))
def token_stats_by_scope(x: Tables) -> DataFrame:
    return stats.dir_tokens(x.files())


@query(with_("files", "SELECT '.' || lang AS ext, count(*) AS files FROM files GROUP BY lang"))
def extension_histogram(x: Tables) -> DataFrame:
    return stats.extension_histogram(x.files().withColumn("file", F.concat("file", F.lit("."), "lang")))


@query(with_("files", f", d AS (SELECT dir, ceil(sum(size) / 4) AS tokens FROM files GROUP BY dir), a AS (SELECT dir, tokens FROM d UNION ALL SELECT split_part(dir, '/', 1), 0 FROM d GROUP BY ALL UNION ALL SELECT '.', 0), up AS (SELECT DISTINCT unnest({_up('dir')}) AS dir FROM d WHERE tokens >= 9000) SELECT a.dir, CAST(tokens AS BIGINT) AS tokens FROM a WHERE dir IN (SELECT dir FROM up) OR dir = '.'"))
def min_token_filter(x: Tables) -> DataFrame:
    own = stats.dir_tokens(x.files()).select("dir", "tokens")
    above = own.select(F.explode(t.ancestors(F.col("dir"))).alias("dir")).distinct().join(own, "dir", "left_anti").withColumn("tokens", F.lit(0).cast("long"))
    return stats.min_token_filter(own.unionByName(above), 9000)


@query(with_("files", f", e AS (SELECT DISTINCT unnest({_up('dir')}) AS dir FROM files), o AS (SELECT dir, count(*) AS n FROM files GROUP BY dir) SELECT e.dir, CASE WHEN e.dir = '.' THEN NULL WHEN contains(e.dir, '/') THEN regexp_replace(e.dir, '/[^/]*$', '') ELSE '.' END AS parent, CASE WHEN e.dir = '.' THEN 0 ELSE CAST(len(string_split(e.dir, '/')) AS INT) END AS depth, coalesce(n, 0) AS files FROM e LEFT JOIN o USING (dir)"))
def directory_tree(x: Tables) -> DataFrame:
    return scan.directories(x.files())


@query(with_("files", "SELECT file, dir, size FROM files WHERE lang <> 'de' AND NOT (source LIKE 'src1%' AND source <> 'src15')"))
def scan_ignored(x: Tables) -> DataFrame:
    named = x.files().withColumn("name", F.concat("name", F.lit(".md")))
    return scan.scan(named, ["src1*", "!src15", "**/de"]).select("file", "dir", "size")


@query(with_("files", ", s AS (SELECT DISTINCT source AS scope FROM files WHERE CAST(substr(source, 4) AS INT) % 2 = 0 UNION ALL SELECT '.') SELECT DISTINCT dir, CASE WHEN source IN (SELECT scope FROM s) THEN source ELSE '.' END AS scope FROM files"))
def nearest_scope(x: Tables) -> DataFrame:
    f = x.files()
    tracked = f.where(F.substring("source", 4, 9).try_cast("int") % 2 == 0).select(F.col("source").alias("scope")).distinct().unionByName(x.spark.range(1).select(F.lit(".").alias("scope")))
    return scan.nearest_scope(f.select("dir").distinct(), tracked)


@query(with_("files", f", e AS (SELECT DISTINCT unnest({_up('dir')}) AS dir FROM files) SELECT dir, CASE dir WHEN 'src3' THEN 'self' WHEN '.' THEN 'parent' ELSE 'child' END AS role FROM e WHERE dir IN ('.', 'src3') OR dir LIKE 'src3/%'"))
def scope_window(x: Tables) -> DataFrame:
    return scan.scope_window(scan.directories(x.files()), "src3")


@query(with_("files", "SELECT source AS shard, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY source"))
def shards(x: Tables) -> DataFrame:
    return x.files().groupBy(scan.shard(F.col("file")).alias("shard")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(with_("files", ", d AS (SELECT DISTINCT source, dir, lang FROM files) SELECT source AS dir, string_agg(lang || ':' || n, ',' ORDER BY lang) AS children FROM (SELECT d.source, d.lang, count(*) AS n FROM d JOIN files f USING (dir) GROUP BY ALL) GROUP BY source"))
def child_summaries(x: Tables) -> DataFrame:
    f = x.files()
    s = f.groupBy("dir").agg(F.count("*").cast("string").alias("summary")).withColumnRenamed("dir", "scope")
    rows = scan.child_summaries(scan.directories(f), s)
    return rows.select("dir", F.array_join(F.transform("subdirectories", lambda c: F.concat(c["name"], F.lit(":"), c["summary"])), ",").alias("children"))


@query("SELECT p_name AS name, p_type AS kind, CAST(count(*) AS BIGINT) AS n FROM part WHERE NOT regexp_matches(p_brand || '/' || p_type, '^Brand#[^/]/SMALL$') AND (regexp_matches(p_brand, '^Brand#1') OR regexp_matches(p_type, '^(?:PROMO|LARGE)$')) GROUP BY ALL")
def glob_filter(x: Tables) -> DataFrame:
    s = x.symbols()
    return s.where(t.matches_glob(F.col("file"), ["Brand#1*/**", "*/{PROMO,LARGE}", "!Brand#?/SMALL"])).groupBy("name", "kind").agg(F.count("*").alias("n"))


# the index


@query(with_("imports", "SELECT from_file, resolved_to, count(*) AS n, min(line) AS first_line FROM imports GROUP BY ALL"))
def import_edges(x: Tables) -> DataFrame:
    return x.imports().groupBy("from_file", "resolved_to").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query(with_("imports", "SELECT from_dir, to_dir, count(*) AS weight FROM imports WHERE to_dir IS NOT NULL AND from_dir <> to_dir GROUP BY ALL"))
def dir_edges(x: Tables) -> DataFrame:
    return graph.dir_edges(x.imports())


def _some_file(x: Tables, side: str) -> str:
    """The first file of that side: one row, whatever the size."""
    return x.imports().where("resolved_to IS NOT NULL").agg(F.min(side)).first()[0] or ""


@query(with_("imports", "SELECT DISTINCT from_file AS file FROM imports WHERE resolved_to = (SELECT min(resolved_to) FROM imports)"))
def importers(x: Tables) -> DataFrame:
    return graph.importers(x.imports(), _some_file(x, "resolved_to"))


@query(with_("imports", "SELECT DISTINCT resolved_to AS file FROM imports WHERE resolved_to IS NOT NULL AND from_file = (SELECT min(from_file) FROM imports WHERE resolved_to IS NOT NULL)"))
def importees(x: Tables) -> DataFrame:
    return graph.importees(x.imports(), _some_file(x, "from_file"))


@query(with_("refs symbols", "SELECT r.file, r.line, s.id AS symbol_id, s.file AS defined_in FROM refs r JOIN symbols s ON s.id = r.symbol_id WHERE s.name = 'blue bolt'"))
def references_to(x: Tables) -> DataFrame:
    return graph.references_to(x.references(), x.symbols(), name="blue bolt").select("file", "line", "symbol_id", "defined_in")


@query(with_("refs symbols", "SELECT r.symbol_id, r.line, s.name, s.file AS defined_in FROM refs r JOIN symbols s ON s.id = r.symbol_id WHERE r.file = '7'"))
def references_from(x: Tables) -> DataFrame:
    return graph.references_from(x.references(), x.symbols(), "7").select("symbol_id", "line", "name", "defined_in")


@query(with_("symbols", "SELECT id, name, file FROM symbols WHERE name = 'small ring' AND (file = 'Brand#2' OR file LIKE 'Brand#2/%')"))
def find_definition(x: Tables) -> DataFrame:
    return graph.find_definitions(x.symbols(), "small ring", directory="Brand#2").select("id", "name", "file")


@query(with_("refs symbols", ", u AS (SELECT r.file, r.line, s.id FROM refs r JOIN symbols s ON s.id = r.symbol_id WHERE s.name = 'red widget') SELECT file, line, id AS symbol_id, (SELECT count(*) FROM u) AS total_matched, (SELECT count(*) FROM u) > 20 AS truncated FROM u ORDER BY file, line, id LIMIT 20"))
def find_references(x: Tables) -> DataFrame:
    rows = graph.references_to(x.references(), x.symbols(), name="red widget").select("file", "line", "symbol_id")
    return retrieval.capped(rows, [F.col("file"), F.col("line"), F.col("symbol_id")], 20)


@query(with_("symbols", "SELECT kind, name, min(id) AS id FROM symbols WHERE exported GROUP BY ALL HAVING count(*) = 1"))
def unique_symbols(x: Tables) -> DataFrame:
    s = x.symbols()
    return graph.unique_symbols(s.withColumn("name", F.concat_ws("|", "kind", "name"))).select(F.split_part("name", F.lit("|"), F.lit(1)).alias("kind"), F.split_part("name", F.lit("|"), F.lit(2)).alias("name"), "id")


@query(with_("refs", "SELECT symbol_id, count(DISTINCT file) AS callers FROM refs GROUP BY symbol_id HAVING callers BETWEEN 2 AND 20"))
def caller_sets(x: Tables) -> DataFrame:
    return graph.caller_sets(x.references())


_RELATED = """, f AS (SELECT min(resolved_to) AS f, regexp_replace(min(resolved_to), '/[^/]*$', '') AS d FROM imports), e AS (SELECT from_dir, to_dir, count(*) AS weight FROM imports WHERE to_dir IS NOT NULL AND from_dir <> to_dir GROUP BY ALL),
b AS (SELECT DISTINCT unnest([from_file, resolved_to]) AS file FROM imports),
a AS (SELECT from_file AS file, 'importer' AS reason, 0 AS k, count(*) AS strength FROM imports, f WHERE resolved_to = f GROUP BY ALL UNION ALL SELECT resolved_to, 'importee', 1, count(*) FROM imports, f WHERE from_file = f AND resolved_to IS NOT NULL GROUP BY ALL
UNION ALL SELECT dir, 'dir_neighbor', 2, max(weight) FROM (SELECT to_dir AS dir, weight FROM e, f WHERE from_dir = d UNION ALL SELECT from_dir, weight FROM e, f WHERE to_dir = d) GROUP BY dir UNION ALL SELECT file, 'sibling', 3, 1 FROM b, f WHERE file IS NOT NULL AND regexp_replace(file, '/[^/]*$', '') = d AND file <> f)
SELECT file, reason, strength FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY strength DESC, k) AS r FROM a) WHERE r = 1"""


@query(with_("imports", _RELATED))
def find_related(x: Tables) -> DataFrame:
    i = x.imports()
    return graph.find_related(i, graph.dir_edges(i), _some_file(x, "resolved_to"))


@query(with_("imports", ", b AS (SELECT DISTINCT unnest([from_file, resolved_to]) AS file FROM imports), f AS (SELECT min(from_file) AS f FROM imports WHERE resolved_to IS NOT NULL) SELECT file FROM b, f WHERE file IS NOT NULL AND file <> f AND regexp_replace(file, '/[^/]*$', '') = regexp_replace(f, '/[^/]*$', '')"))
def siblings(x: Tables) -> DataFrame:
    return graph.siblings(x.imports(), _some_file(x, "from_file"))


@query("WITH RECURSIVE " + with_("imports", ", e AS (SELECT DISTINCT from_dir, to_dir FROM imports WHERE to_dir IS NOT NULL AND from_dir <> to_dir), b AS (SELECT from_dir AS a, to_dir AS b FROM e UNION SELECT to_dir, from_dir FROM e), r AS (SELECT min(a) AS dir, 0 AS hops FROM b UNION SELECT b.b, hops + 1 FROM r JOIN b ON b.a = r.dir WHERE hops < 4) SELECT dir, min(hops) AS hops, 1 / (1 + min(hops)) AS prox FROM r WHERE dir IS NOT NULL GROUP BY dir")[5:])
def dir_proximity(x: Tables) -> DataFrame:
    e = graph.kept(graph.dir_edges(x.imports()))
    seed = e.agg(F.least(F.min("from_dir"), F.min("to_dir")).alias("dir")).where("dir IS NOT NULL")
    return graph.proximity(e, seed)


#: Every line item is a reference to its part, from the file of the part that its supplier's number names.
_IMPACT = with_(
    "symbols refs imports",
    ", u AS (SELECT DISTINCT s.file AS target, v.file AS usr FROM lineitem JOIN symbols s ON s.id = l_partkey AND s.exported JOIN symbols v ON v.id = l_suppkey), seed AS (SELECT file FROM symbols WHERE id = 5 UNION SELECT min(resolved_to) FROM imports), "
    "i AS (SELECT DISTINCT resolved_to AS target, from_file AS usr FROM imports WHERE resolved_to IS NOT NULL), l AS (SELECT * FROM u UNION SELECT * FROM i WHERE target NOT IN (SELECT file FROM symbols WHERE exported)), "
    f"r AS (SELECT usr AS file, 0 AS hops FROM (SELECT * FROM u UNION SELECT * FROM i) JOIN seed ON target = seed.file WHERE usr NOT IN (SELECT file FROM seed) UNION SELECT usr, hops + 1 FROM r JOIN l ON l.target = r.file WHERE hops + 1 < {k.IMPACT_DEPTH}), "
    "z AS (SELECT file, min(hops) AS hops FROM r WHERE file NOT IN (SELECT file FROM seed) GROUP BY file)",
)


def _impact(x: Tables) -> DataFrame:
    """Of the file of symbol 5, as a whole, and of an imported file."""
    s, i = x.symbols(), x.imports()
    lines = x.table("lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_suppkey").alias("id"))
    r = x.spread(x.spread(lines, "id").join(s.select("id", "file"), "id").select("symbol_id", "file"), "symbol_id")
    files = s.where("id = 5").select("file").unionByName(i.agg(F.min("resolved_to").alias("file")).where("file IS NOT NULL"))
    seeds = graph.kept(files.select("file", F.lit(None).cast("long").alias("symbol_id")))
    return graph.impact(s, r, i, seeds, results=1 << 62)[0]


@query("WITH RECURSIVE " + _IMPACT[5:] + " SELECT file, hops FROM z")
def impact_files(x: Tables) -> DataFrame:
    return _impact(x).select("file", "hops")


@query("WITH RECURSIVE " + _IMPACT[5:] + " SELECT CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS scope, min(hops) AS min_hops, count(*) AS files FROM z GROUP BY 1")
def impact_scopes(x: Tables) -> DataFrame:
    return graph.affected_scopes(_impact(x))


@query(with_("imports", ", f AS (SELECT min(resolved_to) AS f FROM imports), o AS (SELECT DISTINCT from_file AS file, 1 AS hop FROM imports, f WHERE resolved_to = f), w AS (SELECT DISTINCT i.from_file AS file, 2 AS hop FROM imports i JOIN o ON i.resolved_to = o.file) SELECT file, min(hop) AS hop FROM (SELECT * FROM o UNION ALL SELECT * FROM w) GROUP BY file"))
def reverse_dependencies(x: Tables) -> DataFrame:
    return graph.reverse_dependencies(x.imports(), _some_file(x, "resolved_to"))


@query("""WITH f AS (SELECT 'src/' || lang || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '/index.tsx' ELSE '' END AS file FROM documents),
e AS (SELECT doc_id, 'src/' || lang AS dir, doc_id + 1 AS other, CASE doc_id % 3 WHEN 0 THEN '.js' ELSE '' END AS ending FROM documents),
c AS (SELECT doc_id, unnest(CASE WHEN ending = '.js' THEN [dir || '/' || other || '.ts', dir || '/' || other || '.tsx', dir || '/' || other || '.js'] || list_transform(['ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'], lambda x: dir || '/' || other || '.js.' || x) || list_transform(['ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'], lambda x: dir || '/' || other || '.js/index.' || x) ELSE [dir || '/' || other] || list_transform(['ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'], lambda x: dir || '/' || other || '.' || x) || list_transform(['ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'], lambda x: dir || '/' || other || '/index.' || x) END) AS candidate, unnest(range(1, 20)) AS pos FROM e)
SELECT e.doc_id, m.resolved_to FROM e LEFT JOIN (SELECT doc_id, arg_min(candidate, pos) AS resolved_to FROM c JOIN f ON f.file = c.candidate GROUP BY doc_id) m USING (doc_id)""")
def import_resolution(x: Tables) -> DataFrame:
    d = x.table("documents").select("doc_id", "lang")
    end = F.when(F.col("doc_id") % 4 == 0, ".ts").when(F.col("doc_id") % 4 == 1, ".js").when(F.col("doc_id") % 4 == 2, "/index.tsx").otherwise("")
    files = d.select(F.concat(F.lit("src/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), end).alias("file"))
    edges = d.select("doc_id", F.concat(F.lit("src/"), "lang", F.lit("/a.ts")).alias("from_file"), F.concat(F.lit("./"), (F.col("doc_id") + 1).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".js").otherwise("")).alias("raw"))
    return graph.resolve(edges, files, graph.script_candidates(F.col("from_file"), F.col("raw"))).select("doc_id", "resolved_to")


# retrieval

_STOP = "[" + ", ".join(f"'{w}'" for w in k.STOPWORDS) + "]"


def _parts_sql(x: str) -> str:
    """Identifier parts without look-around: boundaries are marked one kind after the other."""
    out = x
    for a, b in ((r"([a-z])([A-Z])", r"\1_\2"), (r"([A-Z])([A-Z][a-z])", r"\1_\2"), (r"([A-Z])([A-Z][a-z])", r"\1_\2"), (r"([A-Za-z])([0-9])", r"\1_\2"), (r"([0-9])([A-Za-z])", r"\1_\2")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"list_transform(list_filter(string_split({out}, '_'), lambda p: length(p) >= 2), lambda p: lower(p))"


_TOKENS = (
    "fr AS (SELECT scope, zone, unnest(list_filter(regexp_split_to_array(body, '[^A-Za-z0-9_]+'), lambda w: length(w) >= 2)) AS w FROM (SELECT scope, unnest(['summary', 'constraints', 'path']) AS zone, unnest([summary, constraints, path]) AS body FROM zones)), "
    f"pt AS (SELECT scope, zone, w, {_parts_sql('w')} AS p FROM fr), "
    "tk AS (SELECT scope, zone, term FROM (SELECT scope, zone, unnest(list_concat([lower(w)], CASE WHEN len(p) > 1 OR (len(p) = 1 AND p[1] <> lower(w)) THEN p ELSE [] END)) AS term FROM pt) "
    f"WHERE NOT list_contains({_STOP}, term))"
)


@query(with_("zones", f", {_TOKENS} SELECT term, zone, count(*) AS n, count(DISTINCT scope) AS docs FROM tk GROUP BY ALL"))
def tokenize_terms(x: Tables) -> DataFrame:
    return retrieval.term_counts(x.zones(), ZONES)


@query(with_("zones", f", {_TOKENS}, n AS (SELECT count(*) AS n FROM zones) SELECT zone, count(*) AS tokens, round(count(*) / any_value(n), 6) AS average FROM tk, n GROUP BY zone"))
def zone_stats(x: Tables) -> DataFrame:
    lengths = retrieval.zone_lengths(x.zones(), ZONES)
    return lengths.groupBy("zone").agg(F.sum("length").alias("tokens"), F.round(F.avg("length"), 6).alias("average"))


@query(with_("zones", f", {_TOKENS}, n AS (SELECT count(*) AS n FROM zones) SELECT term, count(DISTINCT scope) AS df, round(ln(1 + (any_value(n) - count(DISTINCT scope) + 0.5) / (count(DISTINCT scope) + 0.5)), 6) AS idf FROM tk, n GROUP BY term"))
def idf_table(x: Tables) -> DataFrame:
    z = x.zones()
    n = z.agg(F.count("*").alias("n"))
    df = retrieval.document_frequency(z, ZONES)
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(retrieval.idf(F.col("df"), F.col("n")), 6).alias("idf"))


_BM25 = (
    f"{_TOKENS}, q AS (SELECT * FROM (VALUES ('thonre', 1), ('herinn', 1), ('eau', 1), ('sch', 1)) v(term, times)), n AS (SELECT count(*) AS n FROM zones), "
    "ln AS (SELECT scope, zone, count(*) AS dl FROM tk GROUP BY ALL), av AS (SELECT zone, sum(dl) / any_value(n) AS avgdl FROM ln, n GROUP BY zone), "
    "tf AS (SELECT scope, zone, term, count(*) AS tf FROM tk WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(DISTINCT scope) AS df FROM tf GROUP BY term), "
    "sc AS (SELECT scope, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * CASE zone WHEN 'summary' THEN 3.0 WHEN 'constraints' THEN 1.5 ELSE 0.5 END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN ln USING (scope, zone) JOIN av USING (zone), n GROUP BY scope)"
)


@query(with_("zones", f", {_BM25} SELECT scope, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, scope LIMIT 20"))
def bm25_search(x: Tables) -> DataFrame:
    return retrieval.top(retrieval.bm25(x.zones(), ZONES, QUERY), 20)


_EXCERPT = (
    "w AS (SELECT scope, zone, body, unnest(['thonre', 'herinn', 'eau', 'sch']) AS w FROM (SELECT scope, unnest(['summary', 'constraints', 'path']) AS zone, unnest([summary, constraints, path]) AS body FROM zones)), "
    "x AS (SELECT scope, zone, body, instr(lower(body), w) AS p, w FROM w WHERE instr(lower(body), w) > 0), "
    "y AS (SELECT scope, zone, any_value(body) AS body, min((p, length(w), w)) AS h FROM x GROUP BY ALL), "
    "ex AS (SELECT scope, zone, substr(substr(body, greatest(h[1] - 60, 1), h[1] - greatest(h[1] - 60, 1)) || '**' || substr(body, h[1], h[2]) || '**' || substr(body, h[1] + h[2], 100 - h[2]), 1, 160) AS excerpt FROM y)"
)


@query(with_("zones", f", {_EXCERPT.replace('h[1]', 'struct_extract_at(h, 1)').replace('h[2]', 'struct_extract_at(h, 2)')} SELECT scope, zone, excerpt FROM ex"))
def excerpts(x: Tables) -> DataFrame:
    return retrieval.excerpts(x.zones(), ZONES, QUERY)


@query(with_("zones", f", {_BM25}, {_EXCERPT.replace('h[1]', 'struct_extract_at(h, 1)').replace('h[2]', 'struct_extract_at(h, 2)')} SELECT scope, round(score, 4) AS score, count(*) AS excerpts FROM sc JOIN ex USING (scope) GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10"))
def search_context(x: Tables) -> DataFrame:
    return retrieval.search_context(x.zones(), ZONES, QUERY).withColumn("excerpts", F.size("excerpts").cast("long"))


def _candidates(x: Tables) -> DataFrame:
    """Directories as search results: total by size, some included by name."""
    d = stats.dir_tokens(x.files())
    must = F.when(F.col("dir").rlike("^src3/"), 1.0).otherwise(0.0)
    return d.select(F.col("dir").alias("scope"), (F.col("tokens") % 1400 + 1).alias("tokens"), must.alias("must"), (F.col("bytes") % 1000 / 1000).alias("total"))


_CAND = "c AS (SELECT dir AS scope, CAST(ceil(sum(size) / 4) AS BIGINT) % 1400 + 1 AS tokens, CASE WHEN dir LIKE 'src3/%' THEN 1.0 ELSE 0.0 END AS must, CAST(sum(size) AS BIGINT) % 1000 / 1000 AS total FROM files GROUP BY dir)"


@query(with_("files", f", {_CAND}, b AS (SELECT max(total) AS best FROM c) SELECT scope, round(total / (best + 1e-9), 6) AS norm, CAST(must AS DOUBLE) AS must, round(0.55 * total / (best + 1e-9) + 0.05 * must, 6) AS total FROM c, b"))
def pack_candidates(x: Tables) -> DataFrame:
    c = _candidates(x)
    near = c.select("scope", F.lit(0.0).alias("prox")).where("false")
    rows = retrieval.composite(c.select("scope", F.col("total").alias("score")), near, c.where("must > 0").select("scope"))
    return rows.select("scope", F.round("norm", 6).alias("norm"), "must", F.round("total", 6).alias("total"))


@query(with_("files", f", {_CAND}, r AS (SELECT *, row_number() OVER (ORDER BY must DESC, round(total, 9) DESC, scope) AS i FROM c), l AS (SELECT list({{'s': scope, 't': tokens}} ORDER BY i) AS l FROM r), f AS (SELECT list_reduce(list_transform(l, lambda x: {{'u': 0::BIGINT, 'p': [x.s], 't': x.t}}), lambda a, x: CASE WHEN len(a.p) < 20 AND (len(a.p) < 3 OR a.u + x.t <= 3230) THEN {{'u': a.u + x.t, 'p': list_concat(a.p, x.p), 't': x.t}} ELSE a END, {{'u': 0::BIGINT, 'p': CAST([] AS VARCHAR[]), 't': 0::BIGINT}}) AS r FROM l) SELECT r.u AS used, unnest(range(len(r.p))) AS position, unnest(r.p) AS scope FROM f"))
def pack_budget(x: Tables) -> DataFrame:
    return retrieval.pack(_candidates(x)).select("used", F.col("position").cast("long").alias("position"), "scope")


@query(with_("files", ", c AS (SELECT source, lang, file, size, sum(length(file) + length(CAST(size AS VARCHAR)) + 20) OVER (PARTITION BY source ORDER BY size, file ROWS UNBOUNDED PRECEDING) AS s FROM files) SELECT source, count(*) AS n, max(file) AS last FROM c WHERE s + 64 <= 1000 GROUP BY source"))
def byte_ceiling_prefix(x: Tables) -> DataFrame:
    kept = retrieval.byte_ceiling(x.files().select("file", "size", "source"), [F.col("size"), F.col("file")], ["source"], 1000)
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.max("file").alias("last"))


# policy


def _index(x: Tables) -> dict[str, DataFrame]:
    return {"imports": x.imports(), "files": x.files(), "symbols": x.symbols(), "evidence": x.evidence()}


def _violations(x: Tables, scope: str, rule: dict) -> DataFrame:
    return policy.EVALUATORS[rule["kind"]](_index(x), rule, scope)


@query(with_("imports", "SELECT from_file AS file, line, coalesce(resolved_to, raw) AS \"to\", count(*) AS n FROM imports WHERE (from_file = 'ASIA' OR from_file LIKE 'ASIA/%') AND regexp_matches(coalesce(resolved_to, raw), '^(?:EUROPE|AFRICA)/') GROUP BY ALL"))
def policy_forbid_import(x: Tables) -> DataFrame:
    v = _violations(x, "ASIA", {"kind": "forbid_import", "from": "**", "to": ["{EUROPE,AFRICA}/**"]})
    return v.groupBy("file", "line", "to").agg(F.count("*").alias("n"))


@query(with_("files", "SELECT file FROM files f WHERE lang = 'fr' AND NOT EXISTS (SELECT 1 FROM files g WHERE g.doc_id % 7 = 0 AND g.source = f.source AND g.lang = f.lang AND g.doc_id + 20 = f.doc_id)"))
def policy_require_import(x: Tables) -> DataFrame:
    f = x.files()
    edges = f.where("doc_id % 7 = 0").select(F.concat_ws("/", "dir", (F.col("doc_id") + 20).cast("string")).alias("from_file"), F.lit("shared/log").alias("resolved_to"), F.lit(None).cast("string").alias("raw"))
    return policy.require_import({"files": f, "imports": edges}, {"kind": "require_import", "from": "*/fr/*", "to": "shared/**"}, ".").select("file")


@query(with_("symbols", "SELECT 'no export' AS finding FROM symbols WHERE exported AND name = 'purple nothing' AND (file LIKE 'Brand#1/%') HAVING count(*) = 0"))
def policy_require_export(x: Tables) -> DataFrame:
    return _violations(x, "Brand#1", {"kind": "require_export", "symbol": "purple nothing"}).select(F.lit("no export").alias("finding"))


@query(with_("files", "SELECT file, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(len(string_split(text, chr(10))) AS INT) END AS line FROM files WHERE text IS NOT NULL AND lang <> 'de' AND CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(text, chr(10))) END > 12"))
def policy_max_file_lines(x: Tables) -> DataFrame:
    return _violations(x, ".", {"kind": "max_file_lines", "value": 12, "exclude": ["**/de/**"]}).select("file", "line")


@query(with_("files", ", n AS (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '/' || lang || '/' || CAST(doc_id // 2 AS VARCHAR) || '.test.ts' ELSE file || '.ts' END AS file, doc_id FROM files), b AS (SELECT regexp_extract(file, '[^/]*$') AS b FROM n) SELECT file FROM n WHERE NOT contains(file, '.test.') AND regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', '') || '.test.ts' NOT IN (SELECT b FROM b)"))
def policy_require_test_file(x: Tables) -> DataFrame:
    f = x.files()
    named = f.select(F.when(F.col("doc_id") % 3 == 0, F.concat("dir", F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".test.ts"))).otherwise(F.concat("file", F.lit(".ts"))).alias("file"))
    return policy.require_test_file({"files": named}, {"kind": "require_test_file", "source": "**/*.ts", "pattern": "{name}.test.{ext}"}, ".").select("file")


@query(with_("imports", "SELECT from_file AS file, coalesce(resolved_to, raw) AS \"to\", count(*) AS n FROM imports WHERE regexp_matches(from_file, '^AFRICA/') AND NOT regexp_matches(coalesce(resolved_to, raw), '^(?:AFRICA|ASIA)/') GROUP BY ALL"))
def policy_dependency_boundary(x: Tables) -> DataFrame:
    v = _violations(x, ".", {"kind": "dependency_boundary", "from": "AFRICA/**", "allowed_to": ["AFRICA/**", "ASIA/**"]})
    return v.groupBy("file", "to").agg(F.count("*").alias("n"))


_EVID = ", v AS (SELECT scope, unnest(CASE WHEN test_status IS NULL AND lint_status IS NULL THEN ['evidence'] ELSE list_filter([CASE WHEN test_status IS DISTINCT FROM 'passing' THEN 'test_status' END, CASE WHEN lint_status IS DISTINCT FROM 'clean' THEN 'lint_status' END, CASE WHEN coverage IS NULL OR coverage < 40 THEN 'coverage_min' END], lambda f: f IS NOT NULL) END) AS symbol FROM evidence)"
_EVID_RULE = {"kind": "evidence_requires", "test_status": "passing", "lint_status": "clean", "coverage_min": 40}


@query(with_("evidence", f"{_EVID} SELECT scope AS file, symbol, count(*) AS n FROM v GROUP BY ALL"))
def policy_evidence_requires(x: Tables) -> DataFrame:
    return _violations(x, ".", _EVID_RULE).groupBy("file", "symbol").agg(F.count("*").alias("n"))


@query(with_("evidence files", f"{_EVID}, n AS (SELECT (SELECT count(*) FROM v) AS a, (SELECT count(*) FROM files WHERE len(string_split(text, chr(10))) > 100000) AS b) SELECT 2 AS evaluated, CAST((a = 0)::INT + (b = 0)::INT AS BIGINT) AS passed, CAST(a + b AS BIGINT) AS violations, a + b = 0 AS ok, a + b > 500 AS truncated FROM n"))
def policy_summary(x: Tables) -> DataFrame:
    return policy.summary(_index(x), [(".", _EVID_RULE), (".", {"kind": "max_file_lines", "value": 100_000})])


@query(with_("evidence", f"{_EVID}, e AS (SELECT unnest({_up('scope')}) AS scope FROM v) SELECT scope, count(*) AS violations FROM e WHERE scope = '.' OR scope IN (SELECT DISTINCT source FROM documents) GROUP BY scope"))
def policy_attribution(x: Tables) -> DataFrame:
    scopes = x.files().select(F.col("source").alias("scope")).distinct().unionByName(x.spark.range(1).select(F.lit(".").alias("scope")))
    return policy.attributed(_violations(x, ".", _EVID_RULE), scopes)


# fingerprints, freshness, health


@query(with_("files", "SELECT dir, substr(sha256(string_agg(name || ':' || doc_id || ':' || size, chr(10) ORDER BY name || ':' || doc_id || ':' || size)), 1, 8) AS fingerprint FROM files GROUP BY dir"))
def dir_fingerprint(x: Tables) -> DataFrame:
    return freshness.dir_fingerprint(x.files().withColumn("mtime", F.col("doc_id")))


@query(with_("files", "SELECT file, substr(sha256(coalesce(text, '')), 1, 16) AS fingerprint FROM files"))
def file_fingerprint(x: Tables) -> DataFrame:
    return x.files().select("file", freshness.file_fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))


@query(with_("symbols", "SELECT regexp_replace(file, '/[^/]*$', '') AS scope, substr(sha256('semv1' || chr(10) || string_agg('s|' || file || '|' || kind || '|' || name, chr(10) ORDER BY 's|' || file || '|' || kind || '|' || name)), 1, 12) AS semantic_fingerprint FROM symbols WHERE exported GROUP BY 1"))
def semantic_fingerprint(x: Tables) -> DataFrame:
    return freshness.semantic_fingerprint(x.symbols())


_STATE = "CASE WHEN stored IS NULL THEN 'missing' WHEN stored = now THEN 'fresh' WHEN sem0 IS NULL OR sem0 = sem1 THEN 'cosmetic_stale' ELSE 'semantic_stale' END"
_DIRS = "d AS (SELECT dir, count(*) AS n, CAST(ceil(sum(size) / 4) AS BIGINT) AS tokens, CAST(sum(size) AS BIGINT) AS b, max(doc_id) AS m FROM files GROUP BY dir), st AS (SELECT dir, tokens, CASE WHEN b % 5 = 0 THEN NULL ELSE b % 3 END AS stored, b % 2 AS now, CASE WHEN m % 4 = 0 THEN NULL ELSE m % 3 END AS sem0, n % 2 AS sem1 FROM d), fs AS (SELECT dir, tokens, " + _STATE + " AS state FROM st)"


def _states(x: Tables) -> DataFrame:
    d = x.files().groupBy("dir").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / 4).alias("tokens"), F.sum("size").alias("b"), F.max("doc_id").alias("m"))
    stored, sem = F.when(F.col("b") % 5 != 0, F.col("b") % 3), F.when(F.col("m") % 4 != 0, F.col("m") % 3)
    return d.select("dir", "tokens", freshness.state(stored, F.col("b") % 2, sem, F.col("n") % 2).alias("state"))


@query(with_("files", f", {_DIRS} SELECT dir, state, CASE WHEN state LIKE '%stale' THEN 'stale' ELSE state END AS shown FROM fs"))
def freshness_states(x: Tables) -> DataFrame:
    return _states(x).select("dir", "state", freshness.three_state(F.col("state")).alias("shown"))


@query(with_("files", f", {_DIRS} SELECT count(*) AS total, count(*) FILTER (state <> 'missing') AS tracked, count(*) FILTER (state = 'fresh') AS fresh, count(*) FILTER (state LIKE '%stale') AS stale, count(*) FILTER (state = 'missing') AS missing, floor(count(*) FILTER (state = 'fresh') / count(*) * 1000 * 10 + 0.5) / 10.0 AS fresh_permille, CAST(coalesce(sum(tokens) FILTER (state = 'fresh'), 0) AS BIGINT) AS fresh_tokens, CAST(coalesce(sum(tokens) FILTER (state LIKE '%stale'), 0) AS BIGINT) AS stale_tokens FROM fs"))
def freshness_summary(x: Tables) -> DataFrame:
    return stats.freshness_summary(_states(x))


@query(with_("files", f", {_DIRS} SELECT dir, state FROM fs WHERE state IN ('semantic_stale', 'missing')"))
def stale_selection(x: Tables) -> DataFrame:
    return freshness.stale(_states(x), semantic_only=True).select("dir", "state")


@query(with_("files", f", {_DIRS}, s AS (SELECT dir, CASE WHEN tokens % 3 = 0 THEN NULL ELSE CAST(tokens % 2 AS VARCHAR) END AS semantic_fingerprint FROM fs), n AS (SELECT dir, CAST(tokens % 5 % 2 AS VARCHAR) AS fresh FROM fs WHERE tokens % 7 <> 0) SELECT s.dir AS scope, CASE WHEN fresh IS NULL THEN 'skipped' WHEN fresh IS NOT DISTINCT FROM semantic_fingerprint THEN 'unchanged' ELSE 'updated' END AS action, coalesce(fresh, semantic_fingerprint) AS semantic_fingerprint FROM s LEFT JOIN n USING (dir)"))
def semantic_stamping(x: Tables) -> DataFrame:
    d = _states(x).withColumnRenamed("dir", "scope")
    have = d.select("scope", F.when(F.col("tokens") % 3 != 0, (F.col("tokens") % 2).cast("string")).alias("semantic_fingerprint"))
    return freshness.stamp(have, d.where("tokens % 7 <> 0").select("scope", (F.col("tokens") % 5 % 2).cast("string").alias("semantic_fingerprint")))


_HEALTH = "count(*) FILTER (test_status IS NOT NULL OR lint_status IS NOT NULL) AS with_evidence, count(*) FILTER (test_status = 'passing') AS passing, count(*) FILTER (test_status = 'failing') AS failing, count(*) FILTER (lint_status = 'clean') AS lint_clean, count(*) FILTER (lint_status = 'errors') AS lint_errors, CAST(coalesce(sum(test_count), 0) AS BIGINT) AS tests, count(coverage) AS covered, floor(avg(coverage) * 10 + 0.5) / 10.0 AS coverage_avg, min(coverage) AS coverage_min, max(coverage) AS coverage_max, coalesce(string_agg(DISTINCT CASE WHEN test_status = 'failing' THEN scope END, ',' ORDER BY CASE WHEN test_status = 'failing' THEN scope END), '') AS failing_scopes"


@query(with_("evidence", f"SELECT {_HEALTH} FROM evidence"))
def health_aggregate(x: Tables) -> DataFrame:
    return evidence.health(x.evidence())


@query(with_("evidence", "SELECT scope, count(*) FILTER (test_status = 'passing') AS passing, count(*) FILTER (test_status = 'failing') AS failing, CAST(coalesce(sum(test_count), 0) AS BIGINT) AS tests FROM evidence GROUP BY scope"))
def health_by_scope(x: Tables) -> DataFrame:
    return x.evidence().groupBy("scope").agg(F.count_if(F.col("test_status") == "passing").alias("passing"), F.count_if(F.col("test_status") == "failing").alias("failing"), F.coalesce(F.sum("test_count"), F.lit(0)).alias("tests"))


@query(with_("evidence", ", r AS (SELECT scope, coalesce(test_status = 'passing', false) AS ok, test_status IS NOT NULL AS has FROM evidence) SELECT scope, CASE WHEN NOT bool_or(has) THEN 'no_context' WHEN count(*) FILTER (NOT ok) = 0 THEN 'ok' WHEN count(*) FILTER (ok) = 0 THEN 'failed' ELSE 'partial' END AS status FROM r GROUP BY scope"))
def verify_status(x: Tables) -> DataFrame:
    return evidence.scope_status(x.evidence().select("scope", F.coalesce(F.col("test_status") == "passing", F.lit(False)).alias("ok"), F.col("test_status").isNotNull().alias("has_context")))


@query("SELECT user_id AS scope, arg_max(CASE WHEN value < 30 THEN 'passing' ELSE 'failing' END, event_id) FILTER (event_type IN ('click', 'error')) AS test_status, arg_max(CAST(value AS INT), event_id) FILTER (event_type = 'view') AS test_count FROM events GROUP BY user_id")
def evidence_merge(x: Tables) -> DataFrame:
    e = x.table("events")
    rows = e.select(F.col("user_id").alias("scope"), "event_id", F.when(F.col("event_type").isin("click", "error"), F.when(F.col("value") < 30, "passing").otherwise("failing")).alias("test_status"), F.when(F.col("event_type") == "view", F.bround("value").cast("int")).alias("test_count"))
    return evidence.merged(rows, "scope", F.col("event_id"))


@query("SELECT user_id, count(*) FILTER (a <> 'skip') AS tests, count(*) FILTER (a = 'fail') AS failing FROM (SELECT user_id, CAST(value AS BIGINT) % 7 AS test, arg_max(CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'skip' ELSE 'pass' END, event_id) AS a FROM (SELECT user_id, event_id, event_type, floor(value) AS value FROM events) GROUP BY ALL) GROUP BY user_id")
def last_action_per_test(x: Tables) -> DataFrame:
    e = x.table("events").select("user_id", (F.floor("value") % 7).alias("test"), "event_id", F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skip").otherwise("pass").alias("action"))
    last = history.last_of(e, ["user_id", "test"], "action", F.col("event_id"))
    return last.groupBy("user_id").agg(F.count_if(F.col("action") != "skip").alias("tests"), F.count_if(F.col("action") == "fail").alias("failing"))


# statistics

_ECON = "d AS (SELECT dir, CAST(ceil(sum(size) / 4) AS BIGINT) AS source_tokens, CASE WHEN CAST(sum(size) AS BIGINT) % 4 <> 0 THEN CAST(sum(size) AS BIGINT) % 900 + 10 END AS context_tokens FROM files GROUP BY dir)"


def _economy(x: Tables) -> DataFrame:
    return x.files().groupBy("dir").agg(F.ceil(F.sum("size") / 4).alias("source_tokens"), F.when(F.sum("size") % 4 != 0, F.sum("size") % 900 + 10).alias("context_tokens"))


@query(with_("files", f", {_ECON}, s AS (SELECT CAST(sum(source_tokens) AS BIGINT) AS total_tokens, CAST(sum(source_tokens) FILTER (context_tokens IS NOT NULL) AS BIGINT) AS t, CAST(sum(context_tokens) AS BIGINT) AS c FROM d) SELECT total_tokens, t AS tracked_tokens, c AS context_tokens, t - c AS saved_tokens, floor((t - c) * 100 / t * 10 + 0.5) / 10.0 AS reduction_pct, floor(t / c * 10 + 0.5) / 10.0 AS ratio FROM s"))
def token_economics(x: Tables) -> DataFrame:
    return stats.token_economics(_economy(x))


@query(with_("files", f", {_ECON}, r AS (SELECT (source_tokens - context_tokens) * 100 / source_tokens AS r FROM d WHERE source_tokens > 0 AND context_tokens IS NOT NULL) SELECT floor(quantile_disc(r, 0.5) * 10 + 0.5) / 10.0 AS p50, floor(quantile_disc(r, 0.95) * 10 + 0.5) / 10.0 AS p95 FROM r"))
def reduction_percentiles(x: Tables) -> DataFrame:
    return stats.reduction_percentiles(_economy(x))


_FACTS = {"summary": "length(text) > 500", "exports": "text LIKE '%Licensed%'", "decisions": "lang = 'en'", "constraints": "contains(text, chr(10))", "dependencies": "doc_id % 3 = 0"}


@query(with_("files", ", f AS (SELECT " + ", ".join(f"coalesce({v}, false) AS {n}" for n, v in _FACTS.items()) + " FROM files) SELECT count(*) AS scopes, " + ", ".join(f"floor(count(*) FILTER ({n}) / count(*) * 100 * 10 + 0.5) / 10.0 AS {n}_pct" for n in _FACTS) + ", floor(avg(" + " + ".join(f"{n}::INT" for n in _FACTS) + ") * 10 + 0.5) / 10.0 AS signal FROM f"))
def quality_rates(x: Tables) -> DataFrame:
    facts = {n: F.coalesce(F.expr(v), F.lit(False)) for n, v in _FACTS.items()}
    return stats.quality(x.files(), facts)


@query(with_("files", "SELECT doc_id, " + " + ".join(f"coalesce({v}, false)::INT" for v in _FACTS.values()) + " AS signal FROM files"))
def signal_density(x: Tables) -> DataFrame:
    return x.files().select("doc_id", stats.signal_score(*(F.expr(v) for v in _FACTS.values())).alias("signal"))


@query("WITH l AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id), h AS (SELECT date_diff('second', date_trunc('second', a), date_trunc('second', b)) / 3600 AS h FROM l) SELECT count(*) AS lagging, floor(quantile_disc(h, 0.5) * 10 + 0.5) / 10.0 AS median_hours FROM h WHERE h > 0")
def context_lag(x: Tables) -> DataFrame:
    cut = lambda c: F.date_trunc("second", c)
    return stats.context_lag(x.table("events").groupBy("user_id").agg(cut(F.min("ts")).alias("last_updated"), cut(F.max("ts")).alias("newest")))


# scores


def _scored(x: Tables) -> DataFrame:
    r = x.results()
    return r.withColumns({"score": F.round(scoring.list_coverage(F.col("response"), F.col("expected")), 6), "abstained": scoring.abstained(F.col("response"))})


_COV = "CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_filter(expected, lambda e: contains(lower(response), lower(e)))) / len(expected) END"
#: As a SQL string.
_ABSTAIN = scoring.ABSTAIN.replace("'", "''")
_SC = f", sc AS (SELECT *, round({_COV}, 6) AS score, regexp_matches(response, '{_ABSTAIN}') AS abstained FROM results)"
_MEAS = "count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(avg(abstained::INT), 6) AS abstention, round(avg(latency_ms), 6) AS latency, CAST(sum(input_tokens) AS BIGINT) AS tokens, round(CASE WHEN count(*) FILTER (score >= 0.7) = 0 THEN -1 ELSE sum(input_tokens) / count(*) FILTER (score >= 0.7) END, 6) AS cost_per_correct"


def _finite(d: DataFrame) -> DataFrame:
    return scoring.rounded(d.withColumn("cost_per_correct", F.when(F.col("cost_per_correct") == float("inf"), -1.0).otherwise(F.col("cost_per_correct"))))


@query(with_("results", f"{_SC} SELECT arm, {_MEAS} FROM sc GROUP BY arm"))
def arm_summary(x: Tables) -> DataFrame:
    return _finite(scoring.arm_summary(_scored(x)))


@query(with_("results", f"{_SC} SELECT arm, category, {_MEAS} FROM sc GROUP BY GROUPING SETS ((arm, category), (arm))"))
def arm_category_matrix(x: Tables) -> DataFrame:
    return _finite(scoring.arm_matrix(_scored(x)))


@query(with_("results", f"{_SC}, a AS (SELECT arm, avg(score) AS m, CAST(sum(input_tokens) AS BIGINT) AS t, CASE WHEN count(*) FILTER (score >= 0.7) > 0 THEN sum(input_tokens) / count(*) FILTER (score >= 0.7) END AS c FROM sc GROUP BY arm) SELECT a.arm, round(a.m - r.m, 6) AS score_delta, a.t - r.t AS token_delta, round(a.c - r.c, 6) AS cost_delta FROM a, a r WHERE r.arm = 'context' AND a.arm <> 'context'"))
def arm_deltas(x: Tables) -> DataFrame:
    return scoring.rounded(scoring.arm_deltas(scoring.arm_summary(_scored(x))))


@query(with_("results", f"{_SC} SELECT category, round(avg(m), 6) AS mean, count(*) AS repos FROM (SELECT category, arm, avg(score) AS m FROM sc GROUP BY ALL) GROUP BY category"))
def mean_of_means(x: Tables) -> DataFrame:
    return scoring.rounded(scoring.mean_of_means(_scored(x), "arm"))


@query(with_("results", f"SELECT task_id, round({_COV}, 6) AS score FROM results"))
def score_list_coverage(x: Tables) -> DataFrame:
    return _scored(x).select("task_id", "score")


@query(with_("results", "SELECT task_id, CASE WHEN len(list_filter(expected, lambda e: contains(lower(response), e))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM results"))
def score_target_hit(x: Tables) -> DataFrame:
    return x.results().select("task_id", scoring.target_hit(F.col("response"), F.col("expected")).alias("score"))


_WORDS = "list_filter(regexp_split_to_array(lower(response), '[^a-z]+'), lambda w: length(w) >= 4)"


def _answer_words() -> F.Column:
    return F.filter(F.split(F.lower("response"), "[^a-z]+"), lambda w: F.length(w) >= 4)


@query(with_("results", f", p AS (SELECT task_id, expected, {_WORDS} AS p FROM results) SELECT task_id, CASE WHEN len(expected) = 0 THEN 1.0 ELSE round(coalesce(1 / list_min(list_filter(list_transform(expected, lambda e: list_position(p, e)), lambda i: i > 0)), 0), 6) END AS score FROM p"))
def score_mrr(x: Tables) -> DataFrame:
    return x.results().select("task_id", F.round(scoring.mrr(_answer_words(), F.col("expected")), 6).alias("score"))


@query(with_("results", f", p AS (SELECT task_id, expected, list_distinct({_WORDS}) AS p FROM results), h AS (SELECT *, len(list_intersect(p, expected)) AS h FROM p) SELECT task_id, round(CASE WHEN len(expected) = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE 2 * (h / len(p)) * (h / len(expected)) / (h / len(p) + h / len(expected)) END, 6) AS score FROM h"))
def score_f1(x: Tables) -> DataFrame:
    return x.results().select("task_id", F.round(scoring.file_set_f1(_answer_words(), F.col("expected")), 6).alias("score"))


@query(with_("results", "SELECT task_id, CAST(ceil(length(question) / 3.6) + 12 + 8 AS BIGINT) AS tokens FROM results"))
def token_estimates(x: Tables) -> DataFrame:
    return x.results().select("task_id", scoring.input_tokens(F.lit("anthropic"), F.lit("sonnet"), F.lit(""), F.col("question")).cast("long").alias("tokens"))


@query(with_("results", f"{_SC}, b AS (SELECT category, arm, avg(score) AS s FROM sc WHERE task_id % 2 = 0 GROUP BY ALL), a AS (SELECT category, arm, avg(score) AS s FROM sc WHERE task_id % 2 = 1 GROUP BY ALL) SELECT category, arm, round(b.s, 6) AS before, round(a.s, 6) AS after FROM b LEFT JOIN a USING (category, arm) WHERE a.s IS NULL OR b.s - a.s > 0.02"))
def regression_canary(x: Tables) -> DataFrame:
    s = _scored(x)
    of = lambda m: s.where(F.col("task_id") % 2 == m).groupBy("category", "arm").agg(F.avg("score").alias("score"))
    return scoring.rounded(scoring.regressions(of(0), of(1), ["category", "arm"]))


@query(with_("refs", ", e AS (SELECT symbol_id, count(*) AS e FROM refs WHERE line <= 3 GROUP BY symbol_id), a AS (SELECT symbol_id, count(*) AS a FROM refs WHERE line >= 2 GROUP BY symbol_id), s AS (SELECT CAST(sum(least(coalesce(e, 0), coalesce(a, 0))) AS BIGINT) AS matched, CAST(sum(coalesce(e, 0)) AS BIGINT) AS expected, CAST(sum(coalesce(a, 0)) AS BIGINT) AS actual FROM e FULL JOIN a USING (symbol_id)) SELECT *, round(matched / actual, 6) AS precision, round(matched / expected, 6) AS recall FROM s"))
def precision_recall(x: Tables) -> DataFrame:
    r = x.references()
    of = lambda c: r.where(c).groupBy("symbol_id").agg(F.count("*").alias("n"))
    return scoring.rounded(scoring.precision_recall(of("line <= 3"), of("line >= 2"), ["symbol_id"]))


@query()
def seeded_sample(x: Tables) -> DataFrame:
    return scoring.seeded_sample(x.files().select("doc_id"), "doc_id", 50, 42).select("doc_id", "position")


@query()
def stratified_limit(x: Tables) -> DataFrame:
    return scoring.stratified_sample(x.files().select("doc_id", "lang"), "lang", "doc_id", 60, 42).select("doc_id", "lang")


@query(with_("refs symbols files", ", a AS (SELECT 'definition' AS category, name AS subject, min(file) AS expected FROM (SELECT kind || '|' || name AS name, file, id FROM symbols WHERE exported) GROUP BY name HAVING count(*) = 1), b AS (SELECT 'callers', CAST(symbol_id AS VARCHAR), CAST(count(DISTINCT file) AS VARCHAR) FROM refs GROUP BY symbol_id HAVING count(DISTINCT file) BETWEEN 2 AND 20), c AS (SELECT 'directory', dir, CAST(count(*) AS VARCHAR) FROM files GROUP BY dir) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"))
def task_synthesis(x: Tables) -> DataFrame:
    u = graph.unique_symbols(x.symbols().withColumn("name", F.concat_ws("|", "kind", "name")))
    return scoring.tasks(u, graph.caller_sets(x.references()), stats.dir_tokens(x.files())).withColumn("expected", F.col("expected")[0])


# history


def _revision(x: Tables, before: bool) -> DataFrame:
    o = x.table("orders")
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    own = o.where(F.col("o_orderdate") < cut if before else F.col("o_orderdate") >= cut)
    return own.groupBy(F.col("o_custkey").alias("scope")).agg(F.max("o_orderstatus").alias("status"), F.max("o_orderpriority").alias("priority"), F.count("*").cast("string").alias("fingerprint"))


_REV = "SELECT o_custkey AS scope, unnest(['status', 'priority']) AS field, unnest(['{\"v\":\"' || max(o_orderstatus) || '\"}', '{\"v\":\"' || max(o_orderpriority) || '\"}']) AS v FROM orders WHERE o_orderdate {} TIMESTAMP '1998-06-01' GROUP BY o_custkey"


@query(f"WITH a AS ({_REV.replace('{}', '<')}), b AS ({_REV.replace('{}', '>=')}) SELECT scope, field, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'modified' END AS kind, a.v AS before, b.v AS after FROM a FULL JOIN b USING (scope, field) WHERE a.v IS DISTINCT FROM b.v")
def snapshot_diff(x: Tables) -> DataFrame:
    of = lambda before: history.fields_of(_revision(x, before), ["scope"], ["status", "priority", "fingerprint"])
    return history.snapshot_diff(of(True), of(False), ["scope"])


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' GROUP BY k), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' GROUP BY k) SELECT k AS scope, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k)")
def set_added_removed(x: Tables) -> DataFrame:
    return history.classify(_revision(x, True), _revision(x, False), "scope", "fingerprint")


@query(with_("commits", "SELECT scope, count(*) FILTER (p <> fingerprint) AS transitions FROM (SELECT scope, fingerprint, lag(fingerprint) OVER (PARTITION BY scope ORDER BY ts, seq) AS p FROM commits WHERE fingerprint IS NOT NULL) GROUP BY scope"))
def fingerprint_transitions(x: Tables) -> DataFrame:
    return history.transitions(x.commits())


@query(with_("commits", "SELECT scope, count(*) AS commits, arg_max(sha, (ts, seq)) AS last_sha, max(ts) AS last_ts FROM commits GROUP BY scope ORDER BY commits DESC, scope LIMIT 20"))
def hotspots(x: Tables) -> DataFrame:
    return history.hotspots(x.commits())


@query(with_("commits", "SELECT ts, seq, sha FROM commits WHERE scope = 7 ORDER BY ts DESC, seq DESC LIMIT 50"))
def timeline(x: Tables) -> DataFrame:
    return history.timeline(x.commits(), 7).select("ts", "seq", "sha")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'phantom' ELSE 'unlisted' END AS finding FROM (SELECT DISTINCT doc_id FROM labels) a FULL JOIN (SELECT DISTINCT doc_id + 100 AS doc_id FROM documents) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def strict_crossref(x: Tables) -> DataFrame:
    return history.compare_sets(x.table("labels"), x.table("documents").select((F.col("doc_id") + 100).alias("doc_id")), ["doc_id"])


# extraction


@query("SELECT page_id, h AS href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) GROUP BY ALL")
def href_extraction(x: Tables) -> DataFrame:
    return extract.hrefs(x.table("pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT file, name FROM (SELECT CAST(doc_id AS VARCHAR) || '.py' AS file, unnest(regexp_extract_all('os.getenv(\"' || upper(source) || '_X\") os.environ[\"PATH\"] ' || CASE WHEN doc_id % 2 = 0 THEN 'os.environ.get(''K' || doc_id % 10 || ''')' ELSE '' END, 'os\\.(?:environ\\[|environ\\.get\\(|getenv\\()[\"'']([A-Z][A-Z0-9_]*)[\"'']', 1)) AS name FROM documents) WHERE name <> 'PATH' GROUP BY ALL")
def env_names(x: Tables) -> DataFrame:
    d = x.table("documents")
    text = F.concat(F.lit('os.getenv("'), F.upper("source"), F.lit('_X") os.environ["PATH"] '), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("os.environ.get('K"), (F.col("doc_id") % 10).cast("string"), F.lit("')"))).otherwise(""))
    return extract.environment(d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), text.alias("text")))


@query("SELECT doc_id, i AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(l, 'Licensed under')")
def line_markers(x: Tables) -> DataFrame:
    d = x.table("documents").select(F.col("doc_id").cast("string").alias("file"), F.regexp_replace("text", "Licensed under", "TODO: Licensed under").alias("text"))
    return extract.markers(d).select(F.col("file").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"))


@query("SELECT doc_id, CAST(length(regexp_replace(regexp_replace(replace(text, 'e', '//'), '/\\*(?s:.*?)\\*/', '', 'g'), '(?m)(^|[^:])//.*$', '\\1', 'g')) AS INT) AS left_over FROM documents")
def comment_strip(x: Tables) -> DataFrame:
    return x.table("documents").select("doc_id", F.length(extract.without_comments(F.replace("text", F.lit("e"), F.lit("//")), "c")).alias("left_over"))


# change monitoring: the batch twins of the streams

_GAP = ", g AS (SELECT dir, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL '30 minutes' THEN 1 ELSE 0 END AS s, seq FROM changes WINDOW w AS (PARTITION BY dir ORDER BY ts, seq)), n AS (SELECT dir, ts, sum(s) OVER (PARTITION BY dir ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM g)"


@query(with_("changes", f"{_GAP} SELECT dir, min(ts) AS first_change, max(ts) AS last_change, count(*) AS changes FROM n GROUP BY dir, k"))
def debounce_sessions(x: Tables) -> DataFrame:
    return watch.debounced(x.changes(), "30 minutes").select("dir", "first_change", "last_change", "changes")


@query(with_("changes", "SELECT dir, ts, p AS before, state AS after FROM (SELECT *, lag(state) OVER (PARTITION BY dir ORDER BY ts, seq) AS p FROM changes) WHERE p IS NULL OR p <> state"))
def state_transitions(x: Tables) -> DataFrame:
    return watch.transitions_of(x.changes())


@query(with_("changes", "SELECT state, count(*) AS dirs FROM (SELECT dir, arg_max(state, (ts, seq)) AS state FROM changes GROUP BY dir) GROUP BY state"))
def initial_snapshot(x: Tables) -> DataFrame:
    return watch.snapshot(x.changes()).groupBy("state").agg(F.count("*").alias("dirs"))


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import artifacts as _artifacts  # noqa: E402, F401  registers its queries
