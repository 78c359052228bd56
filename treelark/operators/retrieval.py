"""Search over document records: zone-weighted BM25F, proximity, packs within a token budget, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as k
from ..functions import terms
from ..functions import text as t
from .graph import kept


def zone_tokens(docs: DataFrame, zones: list[str]) -> DataFrame:
    """(scope, zone, term), a row per token, from one scan of the text columns zones; stopwords stay in symbols only."""
    each = F.explode(F.array(*(F.struct(F.lit(z).alias("zone"), F.col(z).alias("body")) for z in zones)))
    rows = t.token_rows(docs.select("scope", each.alias("z")).select("scope", "z.zone", "z.body"), ["scope", "zone"], "body")
    return rows.where((F.col("zone") == "symbols") | ~F.col("term").isin(k.STOPWORDS))


def zone_terms(docs: DataFrame, zones: list[str]) -> DataFrame:
    """(scope, zone, term, tf). Counts are combined before the shuffle."""
    return zone_tokens(docs, zones).groupBy("scope", "zone", "term").agg(F.count("*").alias("tf"))


def zone_lengths(docs: DataFrame, zones: list[str]) -> DataFrame:
    """(scope, zone, length), also of empty zones."""
    found = zone_tokens(docs, zones).groupBy("scope", "zone").agg(F.count("*").alias("length"))
    every = docs.select("scope", F.explode(F.array(*map(F.lit, zones))).alias("zone"))
    return every.join(found, ["scope", "zone"], "left").select("scope", "zone", F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def zone_averages(lengths: DataFrame) -> DataFrame:
    """(zone, average): over all documents, also those whose zone is empty."""
    return lengths.groupBy("zone").agg(F.avg("length").alias("average"))


def _repeated(docs: DataFrame) -> bool:
    """Whether a scope is in more than one row. Only the scopes are read."""
    return not docs.where("scope IS NOT NULL").groupBy("scope").count().where("count > 1").isEmpty()


def term_counts(docs: DataFrame, zones: list[str]) -> DataFrame:
    """(term, zone, n, docs): how often a term is in a zone, and in how many scopes. Counted over many rows at once before the
    only shuffle; where scopes have several rows, their terms are brought together first."""
    if _repeated(docs):
        return zone_terms(docs, zones).groupBy("term", "zone").agg(F.sum("tf").alias("n"), F.count("scope").alias("docs"))
    found = docs.select("scope", *zones).mapInArrow(terms.counter(zones, False), "term string, zone string, n long, docs long")
    return found.groupBy("term", "zone").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def document_frequency(docs: DataFrame, zones: list[str]) -> DataFrame:
    """(term, df): scopes with the term in any zone, counted as term_counts() does."""
    if _repeated(docs):
        return zone_tokens(docs, zones).groupBy("scope", "term").count().groupBy("term").agg(F.count("scope").alias("df"))
    found = docs.select("scope", *zones).mapInArrow(terms.counter(zones, True), "term string, zone string, n long, docs long")
    return found.groupBy("term").agg(F.sum("docs").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, zones: list[str], query: str) -> DataFrame:
    """(scope, score) of documents with a positive score; repeated query tokens count repeatedly.

    Tokens are counted inside a document's row, in all and for each of the query's terms, and never become rows. What is
    left, some whole numbers per document, is written once and serves the averages and the scores; nothing is shuffled.
    """
    wanted: dict[str, int] = {}
    for w in t.plain_tokens(query):
        wanted[w] = wanted.get(w, 0) + 1
    terms = list(wanted)
    if not terms:
        return docs.select("scope", F.lit(0.0).alias("score")).where("false")
    ranged, symbols = range(len(zones)), [z == "symbols" for z in zones]
    texts = docs.select("scope", *(t.composed(F.coalesce(F.col(z), F.lit(""))).alias(f"t_{j}") for j, z in enumerate(zones)))
    texts = texts.select("*", *(t.token_parts(F.col(f"t_{j}"), symbols[j]).alias(f"p_{j}") for j in ranged))
    texts = texts.select("*", *(t.token_hits(F.col(f"t_{j}"), F.col(f"p_{j}"), terms).alias(f"h_{j}") for j in ranged))
    per = kept(
        texts.select(
            "scope", *(t.token_count(F.col(f"t_{j}"), F.col(f"p_{j}"), symbols[j]).cast("long").alias(f"dl_{j}") for j in ranged),
            *((F.size(f"h_{j}") - F.size(F.array_remove(f"h_{j}", w))).cast("long").alias(f"tf{i}_{j}") for i, w in enumerate(terms) for j in ranged),
        )
    )
    hit = lambda i: F.greatest(*(F.coalesce(F.col(f"tf{i}_{j}"), F.lit(0)) for j in range(len(zones))), F.lit(0)) > 0
    stats = per.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"dl_{j}"), F.lit(0)).alias(f"sum_{j}") for j in range(len(zones))), *(F.count_if(hit(i)).alias(f"df{i}") for i in range(len(terms))))  # one row
    rows = per.where(F.greatest(*(hit(i) for i in range(len(terms))), F.lit(False))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        part = F.lit(0.0)
        for j, z in enumerate(zones):
            tf, dl = F.coalesce(F.col(f"tf{i}_{j}"), F.lit(0)), F.coalesce(F.col(f"dl_{j}"), F.lit(0))
            average = F.when(F.col(f"sum_{j}") > 0, F.col(f"sum_{j}") / F.col("n")).otherwise(1.0)
            part = part + k.ZONE_WEIGHTS[z] * tf * (k.K1 + 1) / (tf + k.K1 * (1 - k.B + k.B * dl / average))
        score = score + wanted[w] * idf(F.col(f"df{i}"), F.col("n")) * part
    return rows.select("scope", score.alias("score")).where("score > 0")


def top(scored: DataFrame, limit: int, digits: int = 6) -> DataFrame:
    """The best by (score, scope); scores rounded first, so that the order doesn't hang on summation order."""
    return scored.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "scope").limit(limit)


def normalized(scored: DataFrame) -> DataFrame:
    """Adds norm = score / (max + 1e-9), 0 where nothing scores. The maximum is one row."""
    best = scored.agg(F.max("score").alias("best"))
    return scored.crossJoin(F.broadcast(best)).withColumn("norm", F.when(F.col("best") > 0, F.col("score") / (F.col("best") + 1e-9)).otherwise(0.0)).drop("best")


def composite(scored: DataFrame, proximity: DataFrame, must: DataFrame) -> DataFrame:
    """(scope, norm, prox, must, total, hops): text match, closeness to the seeds and inclusion by name."""
    joined = normalized(scored).join(proximity, "scope", "full").join(must.select("scope", F.lit(1.0).alias("must")), "scope", "full")
    c = {x: F.coalesce(x, F.lit(0.0)) for x in ("norm", "prox", "must")}
    return joined.select("scope", *(v.alias(n) for n, v in c.items()), (k.ALPHA * c["norm"] + k.BETA * c["prox"] + k.MUST * c["must"]).alias("total"), F.when(c["prox"] > 0, F.round(1 / c["prox"]) - 1).cast("int").alias("hops"))


def admit(candidates: DataFrame, limit: int, free: int = k.FREE_SLOTS, most: int = k.MAX_SCOPES, key: list[str] | None = None) -> DataFrame:
    """Greedy admission in rank order of candidates(scope, tokens, total, must): the first free ones come in whatever they
    cost; later ones if they fit, and one that doesn't is passed over.

    Only the first rows by rank matter, since a scope is at least one token: at most limit + free of them are folded, which
    bounds the array by the budget and not by the corpus. key: packs apart from one another.
    """
    key = key or []
    rank = Window.partitionBy(*key).orderBy(F.desc("must"), F.desc(F.round("total", 9)), F.asc("scope"))
    ranked = candidates.withColumn("rank", F.row_number().over(rank)) if key else candidates.orderBy(F.desc("must"), F.desc(F.round("total", 9)), F.asc("scope")).limit(limit + free)
    if key:
        ranked = ranked.where(F.col("rank") <= limit + free)
    row = F.struct(F.negative("must").alias("a"), F.negative(F.round("total", 9)).alias("b"), "scope", F.col("tokens").cast("long").alias("tokens"))
    packed = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("picked"))

    def step(acc, x):
        n = F.size(acc["picked"])
        ok = (n < most) & ((n < free) | (acc["used"] + x["tokens"] <= limit))
        return F.when(ok, F.struct((acc["used"] + x["tokens"]).alias("used"), F.array_append(acc["picked"], x["scope"]).alias("picked"))).otherwise(acc)

    done = packed.select(*key, F.aggregate("rows", start, step).alias("r"))
    return done.select(*key, F.col("r.used").alias("used"), F.posexplode("r.picked").alias("position", "scope"))


def truncate_sentences(text: Column, most_tokens: int) -> Column:
    """Whole sentences until the estimate reaches most_tokens; a short text as it is."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    fold = F.aggregate(parts, F.lit(""), lambda acc, s: F.when((acc != "") & (t.estimate_tokens(F.length(acc)) >= most_tokens), acc).otherwise(F.when(acc == "", s).otherwise(F.concat(acc, F.lit(" "), s))))
    return F.when(t.estimate_tokens(F.length(text)) <= most_tokens, text).otherwise(fold)


def token_cost(text: Column) -> Column:
    return F.greatest(F.lit(1), t.estimate_tokens(F.length(text)))


def render(scope: Column, summary: Column, exports: Column, decisions: Column, constraints: Column, environment: Column) -> Column:
    """A scope's short form: heading, summary, 8 exports, 3 decisions, 3 constraints and 6 variables."""
    listed = lambda title, items, n: F.when(F.size(items) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(items, 1, n), ", "), F.when(F.size(items) > n, F.concat(F.lit(" and "), (F.size(items) - n).cast("string"), F.lit(" more"))).otherwise("")))
    return F.concat_ws("\n", F.concat(F.lit("# "), scope), summary, listed("exports", exports, 8), listed("decisions", decisions, 3), listed("constraints", constraints, 3), listed("env", environment, 6))


def pack(candidates: DataFrame, root_tokens: int = k.ROOT_RESERVE, budget: int = k.BUDGET) -> DataFrame:
    """The scopes that fit beside the root: position, scope, and the tokens used."""
    return admit(candidates.where("scope <> '.'"), int((budget - root_tokens) * k.TIER_SHARE))


def excerpts(docs: DataFrame, zones: list[str], query: str) -> DataFrame:
    """(scope, zone, excerpt): the text around the earliest query token, the hit in bold, at most 160 characters."""
    words = F.array(*map(F.lit, t.plain_tokens(query))).cast("array<string>")
    each = F.explode(F.array(*(F.struct(F.lit(z).alias("zone"), F.coalesce(F.col(z), F.lit("")).alias("body")) for z in zones)))
    rows = docs.select("scope", each.alias("z")).select("scope", "z.zone", "z.body")
    places = F.filter(F.transform(words, lambda w: F.struct(F.instr(F.lower("body"), w).alias("at"), F.length(w).alias("n"), w.alias("w"))), lambda p: p["at"] > 0)
    hit = F.array_min(places)
    found = rows.withColumn("hit", hit).where("hit IS NOT NULL")
    first = F.greatest(F.col("hit.at") - 60, F.lit(1))
    before = F.col("body").substr(first, F.col("hit.at") - first)
    word = F.col("body").substr(F.col("hit.at"), F.col("hit.n"))
    after = F.col("body").substr(F.col("hit.at") + F.col("hit.n"), F.lit(100) - F.col("hit.n"))
    return found.select("scope", "zone", F.substring(F.concat(before, F.lit("**"), word, F.lit("**"), after), 1, 160).alias("excerpt"))


def search_context(docs: DataFrame, zones: list[str], query: str, fields: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Best documents with an excerpt in one of fields: scope, score (4 decimals), up to three excerpts. Which documents have
    one is told before the best are chosen; excerpts are made of these only, at most RESULT_CAP."""
    shown = [z for z in zones if fields is None or z in fields]
    words = t.plain_tokens(query)
    has = F.exists(F.array(*(F.lower(F.coalesce(F.col(z), F.lit(""))) for z in shown)).cast("array<string>"), lambda x: F.greatest(*(F.instr(x, w) for w in words), F.lit(0), F.lit(0)) > 0)
    best = bm25(docs, zones, query).join(docs.where(has).select("scope"), "scope", "left_semi").withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "scope").limit(min(limit, k.RESULT_CAP))
    best = kept(best)
    texts = docs.join(F.broadcast(best.select("scope")), "scope", "left_semi")  # RESULT_CAP rows
    by = excerpts(texts, shown, query).groupBy("scope").agg(F.slice(F.array_sort(F.collect_list(F.struct("zone", "excerpt"))), 1, 3).alias("excerpts"))
    return best.join(by, "scope").orderBy(F.desc("score"), "scope")


def byte_ceiling(rows: DataFrame, order: list[Column], key: list[str], ceiling: int = k.RESPONSE_CHARS, envelope: int = 64) -> DataFrame:
    """The longest prefix, by order within key, whose JSON stays under the ceiling. The running sum is monotone, so it is exact."""
    cost = F.length(F.to_json(F.struct(*(c for c in rows.columns if c not in key)))) + 1
    total = F.sum(cost).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_total", total + envelope).where(F.col("_total") <= ceiling).drop("_total")


def capped(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows, each with the number of all rows and whether some are left out."""
    total = rows.agg(F.count("*").alias("total_matched"))
    return rows.orderBy(*order).limit(min(limit, k.RESULT_CAP)).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_matched") > limit)


def seeds_of(docs: DataFrame, query: str | None = None, file: str | None = None, symbol: str | None = None) -> DataFrame:
    """(scope, text, must): what a search starts from: a query before a file before a symbol; none of them: nothing.

    A file takes the nearest scope that holds it; a symbol every scope whose exports have it as a part.
    """
    if query:
        return docs.sparkSession.createDataFrame([(None, query, False)], "scope string, text string, must boolean")
    if file:
        near = docs.where(t.in_scope(F.lit(t.normalize_scope(file)), F.col("scope"))).orderBy(F.desc(t.depth(F.col("scope")))).limit(1)
        return near.select("scope", F.concat_ws(" ", "summary", "exports").alias("text"), F.lit(True).alias("must"))
    if symbol:
        return docs.where(F.exists("exports", lambda x: F.contains(x, F.lit(symbol)))).select("scope", F.lit(symbol).alias("text"), F.lit(True).alias("must"))
    return docs.sparkSession.createDataFrame([], "scope string, text string, must boolean")
