"""A project's questions in one place: the tools that read scope records and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as k
from .functions import text as t
from .operators import analyze, evidence, extract, freshness, graph, policy, retrieval, scan, stats
from .sources import index_store, scopes

ZONES = list(k.ZONE_WEIGHTS)


class Project:
    """A source tree with its scope records and index. Everything returned is a lazy DataFrame, unless said otherwise."""

    def __init__(self, spark: SparkSession, root: str, ignore: list[str] | None = None):
        self.spark, self.root, self.ignore = spark, root.rstrip("/"), ignore or []
        self._index: dict[str, DataFrame] | None = None

    def files(self) -> DataFrame:
        """(file, dir, name, size, mtime) of source files."""
        return scan.scan(scan.read_tree(self.spark, self.root), self.ignore)

    def texts(self) -> DataFrame:
        """(file, text) of source files."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        base = "^(?:file:)?/*" + (self.root.strip("/") + "/").replace(".", r"\.")
        return raw.select(F.regexp_replace("path", base, "").alias("file"), F.col("content").try_cast("string").alias("text")).join(self.files().select("file"), "file", "left_semi")

    def records(self) -> DataFrame:
        return scopes.read(self.spark, self.root)

    def index(self, stored: str | None = None) -> dict[str, DataFrame]:
        """The stored index, or one made from the sources."""
        if self._index is None:
            self._index = index_store.read(self.spark, stored, self.root) if stored else analyze.build_index(self.texts())
        return self._index

    # the twelve tools
    def list_contexts(self) -> DataFrame:
        return self.records().select("scope", "summary", "last_updated", "fingerprint")

    def query_context(self, scope: str, fields: list[str]) -> DataFrame:
        """Metadata and the fields asked for, of one scope; unknown fields are ignored."""
        name = t.safe_relative(scope)
        return scan.project(self.records().where(F.col("scope") == (name or "")), fields)

    def check_freshness(self) -> DataFrame:
        """(scope, state) by content fingerprint, and by meaning where both stamps are known."""
        now = freshness.dir_fingerprint(scan.read_tree(self.spark, self.root).where(F.col("name") != scopes.NAME).withColumn("mtime", F.unix_millis("mtime")))
        sem = freshness.semantic_fingerprint(self.index()["symbols"], self.index()["imports"]).withColumnRenamed("scope", "dir")
        r = self.records().select(F.col("scope").alias("dir"), F.col("fingerprint").alias("stored"), F.col("semantic_fingerprint").alias("stamp"))
        tracked = now.join(r, "dir", "left").join(sem, "dir", "left")
        return tracked.select(F.col("dir").alias("scope"), freshness.state(F.col("stored"), F.col("fingerprint"), F.col("stamp"), F.col("semantic_fingerprint")).alias("state"))

    def explain_staleness(self, scope: str) -> DataFrame:
        return self.check_freshness().where(F.col("scope") == scope).select("scope", "state", F.when(F.col("state") == "semantic_stale", "public names or imports changed").when(F.col("state") == "cosmetic_stale", "files changed, public names and imports did not").when(F.col("state") == "missing", "no record").otherwise("nothing changed").alias("reason"))

    def aggregate_evidence(self) -> DataFrame:
        e = self.records().select("scope", "evidence.test_status", "evidence.lint_status", "evidence.test_count", F.col("evidence.coverage_percent").alias("coverage"))
        return evidence.health(e)

    def check_policies(self) -> DataFrame:
        """Violations of the rules in the records. Rules are a project's few; they are read to the driver."""
        import json

        rules = [(r.scope, json.loads(x)) for r in self.records().where("rules IS NOT NULL").select("scope", "rules").collect() for x in r.rules]
        i = self.index()
        files = self.texts().withColumn("dir", t.dirname(F.col("file")))
        e = self.records().select("scope", "evidence.test_status", "evidence.lint_status", "evidence.typecheck", F.col("evidence.coverage_percent").alias("coverage"))
        if not rules:
            return self.spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in policy.VIOLATION))
        return policy.report({"imports": i["imports"], "files": files, "symbols": i["symbols"], "evidence": e}, rules)

    def search_context(self, query: str, fields: list[str] | None = None, limit: int = 10) -> DataFrame:
        return retrieval.search_context(scopes.zones(self.records()), ZONES, query, fields, limit)

    def build_context_pack(self, query: str, budget: int = k.BUDGET) -> DataFrame:
        """(position, scope, used) of the scopes that fit a token budget beside the root."""
        r = self.records()
        scored = retrieval.bm25(scopes.zones(r), ZONES, query)
        none = scored.select("scope", F.lit(0.0).alias("prox")).where("false")
        total = retrieval.composite(scored, none, none.select("scope"))
        text = retrieval.render(F.col("scope"), F.col("summary"), F.coalesce("exports", F.array().cast("array<string>")), F.coalesce(F.transform("decisions", lambda d: F.concat_ws(": ", d["what"], d["why"])), F.array().cast("array<string>")), F.coalesce("constraints", F.array().cast("array<string>")), F.coalesce("environment", F.array().cast("array<string>")))
        cost = r.select("scope", retrieval.token_cost(text).alias("tokens"))
        return retrieval.pack(total.join(cost, "scope"), budget=budget)

    def impact(self, form: str, depth: int = k.IMPACT_DEPTH, results: int = k.IMPACT_RESULTS) -> tuple[DataFrame, dict]:
        i = self.index()
        return graph.impact(i["symbols"], i["references"], i["imports"], graph.seeds(i["symbols"], form), depth, results)

    def find_definition(self, name: str, directory: str | None = None) -> DataFrame:
        return graph.find_definitions(self.index()["symbols"], name, directory=directory)

    def find_references(self, name: str) -> DataFrame:
        i = self.index()
        return graph.references_to(i["references"].withColumnRenamed("at", "use_at"), i["symbols"], name=name)

    def find_related(self, file: str) -> DataFrame:
        i = self.index()
        return graph.find_related(i["imports"], i["dir_edges"], file)

    # reports
    def stats(self) -> DataFrame:
        d = stats.dir_tokens(self.files())
        chars = self.records().select("scope", F.length(F.to_json(F.struct("*"))).alias("context_chars"))
        return stats.scope_rows(d, chars)

    def validate(self) -> DataFrame:
        """(path, finding) of every record that isn't valid."""
        return scopes.checked(self.spark, self.root).select("path", F.explode("findings").alias("finding"))

    def doctor(self) -> DataFrame:
        """(check, status): what is in place."""
        one = lambda name, df, good: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.when(good, "pass").otherwise("fail" if name == "root record" else "warn").alias("status"))
        r = self.records()
        n = F.col("n")
        return one("source files", self.files(), n > 0).unionByName(one("records", r, n > 0)).unionByName(one("root record", r.where("scope = '.'"), n > 0)).unionByName(one("valid records", self.validate(), n == 0)).unionByName(one("index", self.index()["symbols"], n > 0))

    def summaries(self) -> DataFrame:
        return extract.summaries(self.texts())
