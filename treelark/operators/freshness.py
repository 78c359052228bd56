"""Fingerprints of content and of meaning, the states they give, and lookups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def dir_fingerprint(files: DataFrame) -> DataFrame:
    """(dir, fingerprint): 8 hex digits over the sorted name:mtime:size of direct children(dir, name, mtime, size)."""
    line = F.concat_ws(":", "name", F.floor("mtime").cast("string"), F.col("size").cast("string"))
    return files.groupBy("dir").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256), 1, 8).alias("fingerprint"))


def file_fingerprint(content: Column) -> Column:
    """16 hex digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def changed_files(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose (mtime, size) differ from the stored ones: only these need their content read."""
    return now.join(stored.select("file", "mtime", "size"), ["file", "mtime", "size"], "left_anti")


def semantic_fingerprint(symbols: DataFrame, imports: DataFrame | None = None, scope: Column | None = None, rules: Column | None = None) -> DataFrame:
    """(scope, semantic_fingerprint): 12 hex digits over a marker, each file's exported symbols in order of kind and name,
    and its import edges; order, comments and bodies don't count, public names and edges do."""
    own = scope if scope is not None else t.dirname(F.col("file"))
    facts = symbols.where("exported").select(own.alias("scope"), F.concat_ws("|", F.lit("s"), "file", "kind", "name").alias("fact"))
    if imports is not None:
        facts = facts.unionByName(imports.select(t.dirname(F.col("from_file")).alias("scope"), F.concat_ws("|", F.lit("i"), "from_file", F.coalesce("resolved_to", "raw")).alias("fact")).distinct())
    marker = F.lit("semv1\n") if rules is None else F.concat(F.lit("semv1\n"), rules, F.lit("\n"))
    return facts.groupBy("scope").agg(F.substring(F.sha2(F.concat(marker, F.array_join(F.array_sort(F.collect_list("fact")), "\n")), 256), 1, 12).alias("semantic_fingerprint"))


def state(stored: Column, now: Column, stored_semantic: Column | None = None, semantic: Column | None = None) -> Column:
    """missing, fresh, cosmetic_stale or semantic_stale. Without an index or a stored meaning a change is cosmetic."""
    cosmetic = F.lit(True) if stored_semantic is None or semantic is None else stored_semantic.isNull() | semantic.isNull() | (stored_semantic == semantic)
    return F.when(stored.isNull(), "missing").when(stored == now, "fresh").when(cosmetic, "cosmetic_stale").otherwise("semantic_stale")


def three_state(four: Column) -> Column:
    return F.when(four.isin("cosmetic_stale", "semantic_stale"), "stale").otherwise(four)


def stale(scopes: DataFrame, semantic_only: bool = False) -> DataFrame:
    """Scopes(state) to write anew."""
    return scopes.where(F.col("state").isin(*(("semantic_stale", "missing") if semantic_only else ("cosmetic_stale", "semantic_stale", "missing"))))


def stamp(scopes: DataFrame, semantic: DataFrame) -> DataFrame:
    """scopes(scope, semantic_fingerprint) with the new stamp and what was done: updated, skipped or unchanged."""
    s = semantic.select("scope", F.col("semantic_fingerprint").alias("new"))
    action = F.when(F.col("new").isNull(), "skipped").when(F.col("new").eqNullSafe(F.col("semantic_fingerprint")), "unchanged").otherwise("updated")
    return scopes.join(s, "scope", "left").select("scope", action.alias("action"), F.coalesce("new", "semantic_fingerprint").alias("semantic_fingerprint"))


def cache_key(columns: dict[str, Column]) -> Column:
    """64 hex digits over the JSON of columns in order of name."""
    return F.sha2(t.canonical(columns), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests(key) with the cached response, null for a miss."""
    return requests.join(cache.select("key", "response"), "key", "left")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("response")), F.lit(0)).alias("bytes"))
