"""The relations of a project, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items that a task joins at a time, about.
TASK_ROWS = 500_000


class Tables:
    """The tables of one directory as relations. Everything is lazy, but for a count of lineitem where its joins are spread;
    only the columns used are read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.parts = spark, root, None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def texts(self) -> DataFrame:
        """documents; a table of fewer splits than cores is spread over them, since its texts cost more to work on than to
        move. A large table has more splits than that and stays as it is."""
        d = self.table("documents")
        cores = self.spark.sparkContext.defaultParallelism
        return d if d.select("doc_id").rdd.getNumPartitions() >= cores else d.repartition(cores, "doc_id")

    def spread(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows, one a line item or fewer, hashed by a key of a join into so many parts that a task's stay of one size, where
        the session's partitions are too few for that."""
        if self.parts is None:
            self.parts = -(-self.table("lineitem").count() // TASK_ROWS)  # from the footers
        return rows.repartition(self.parts, key) if self.parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else rows

    def files(self) -> DataFrame:
        """file, dir, name, size, text, lang, doc_id."""
        d = self.table("documents")
        where = F.concat_ws("/", "source", "lang")
        return d.select(F.concat_ws("/", where, F.col("doc_id").cast("string")).alias("file"), where.alias("dir"), F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size"), "text", "lang", "source", "doc_id")

    def zones(self) -> DataFrame:
        """One document record per row: scope and its zone texts."""
        text = F.coalesce(F.col("text"), F.lit(""))
        head = F.substring_index(text, "\n", 1)
        return self.texts().select(F.col("doc_id").cast("string").alias("scope"), head.alias("summary"), F.substring(text, F.length(head) + 2, F.length(text)).alias("constraints"), F.concat_ws(" ", "source", "lang").alias("path"))

    def symbols(self) -> DataFrame:
        """id, file, name, kind, exported."""
        return self.table("part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") > 10).alias("exported"))

    def references(self) -> DataFrame:
        """symbol_id, file, line."""
        return self.table("lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"))

    def imports(self) -> DataFrame:
        """from_file, from_dir, raw, resolved_to (null: external), to_dir, line: what customers buy from suppliers."""
        line = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey", "s_name")
        nation = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        region = self.table("region").select("r_regionkey", "r_name")
        places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("dir"))
        bought = self.spread(orders, "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_nationkey")
        sold = self.spread(line, "l_orderkey").join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        joined = self.spread(sold, "l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        a, b = places.alias("a"), places.alias("b")
        placed = joined.join(a, F.col("c_nationkey") == F.col("a.n_nationkey")).join(b, F.col("s_nationkey") == F.col("b.n_nationkey"))
        to = F.concat(F.col("b.dir"), F.lit("/s"), F.col("s_suppkey").cast("string"))
        return placed.select(
            F.concat(F.col("a.dir"), F.lit("/c"), F.col("c_custkey").cast("string")).alias("from_file"), F.col("a.dir").alias("from_dir"), F.col("s_name").alias("raw"),
            F.when(F.col("l_discount") > 0, to).alias("resolved_to"), F.when(F.col("l_discount") > 0, F.col("b.dir")).alias("to_dir"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("order_key"),
        )

    def evidence(self) -> DataFrame:
        """scope, doc_id, test_status, lint_status, test_count; null statuses: no evidence."""
        d, q = self.table("documents").select("doc_id", "source", "lang", "n_chars"), self.table("labels")
        return d.join(q, "doc_id", "left").select(
            F.concat_ws("/", "source", "lang").alias("scope"), "doc_id",
            F.when(F.col("quality") == 1, "passing").when(F.col("quality") == 0, "failing").alias("test_status"),
            F.when(F.col("toxic") == 0, "clean").when(F.col("toxic") == 1, "errors").alias("lint_status"),
            F.when(F.col("quality").isNotNull(), F.col("n_chars") % 50).alias("test_count"),
            F.when(F.col("quality").isNotNull(), F.col("n_chars") % 101).cast("double").alias("coverage"),
        )

    def commits(self) -> DataFrame:
        """scope (a user), ts, seq, fingerprint (null for some), sha."""
        e = self.table("events")
        return e.select(F.col("user_id").alias("scope"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("fingerprint"), F.sha1(F.col("event_id").cast("string")).alias("sha"))

    def results(self) -> DataFrame:
        """task_id, arm, category, question, response, expected, latency, tokens of each answered turn."""
        t = self.table("conversations")
        q, a = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")), t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
        pair = q.join(a, ["conv_id", "turn"])
        words = F.filter(F.split(F.lower("question"), "[^a-z]+"), lambda w: F.length(w) >= 4)
        expected = F.slice(F.array_sort(F.array_distinct(words)), 1, 5)
        return pair.select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("task_id"),
            F.element_at(F.array(*map(F.lit, ("context", "baseline", "map", "full", "pack"))), (F.col("conv_id") % 5 + 1).cast("int")).alias("arm"),
            F.element_at(F.array(*map(F.lit, ("lookup", "change", "trace"))), (F.col("turn") % 3 + 1).cast("int")).alias("category"),
            "question", "response", expected.alias("expected"), (F.length("response") * 7 % 1000).cast("long").alias("latency_ms"), F.ceil(F.length("question") / 4).alias("input_tokens"),
        )

    def changes(self) -> DataFrame:
        """The change log: dir, ts, state, seq."""
        return self.table("events").select(F.col("user_id").alias("dir"), "ts", F.col("event_type").alias("state"), F.col("event_id").alias("seq"))


#: The same relations for DuckDB, as common table expressions by name.
SQL = {
    "files": "SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS file, source || '/' || lang AS dir, CAST(doc_id AS VARCHAR) AS name, n_chars AS size, text, lang, source, doc_id FROM documents",
    "zones": "SELECT CAST(doc_id AS VARCHAR) AS scope, split_part(coalesce(text, ''), chr(10), 1) AS summary, substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS constraints, source || ' ' || lang AS path FROM documents",
    "symbols": "SELECT p_partkey AS id, p_brand || '/' || p_type AS file, p_name AS name, p_type AS kind, p_size > 10 AS exported FROM part",
    "refs": "SELECT l_partkey AS symbol_id, CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS line FROM lineitem",
    "places": "SELECT n_nationkey, r_name || '/' || n_name AS dir FROM nation JOIN region ON n_regionkey = r_regionkey",
    "imports": "SELECT a.dir || '/c' || c_custkey AS from_file, a.dir AS from_dir, s_name AS raw, CASE WHEN l_discount > 0 THEN b.dir || '/s' || s_suppkey END AS resolved_to, CASE WHEN l_discount > 0 THEN b.dir END AS to_dir, l_linenumber AS line, l_orderkey AS order_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN places a ON c_nationkey = a.n_nationkey JOIN places b ON s_nationkey = b.n_nationkey",
    "evidence": "SELECT source || '/' || lang AS scope, d.doc_id, CASE quality WHEN 1 THEN 'passing' WHEN 0 THEN 'failing' END AS test_status, CASE toxic WHEN 0 THEN 'clean' WHEN 1 THEN 'errors' END AS lint_status, CASE WHEN quality IS NOT NULL THEN n_chars % 50 END AS test_count, CAST(CASE WHEN quality IS NOT NULL THEN n_chars % 101 END AS DOUBLE) AS coverage FROM documents d LEFT JOIN labels q ON d.doc_id = q.doc_id",
    "commits": "SELECT user_id AS scope, ts, event_id AS seq, CASE WHEN event_type <> 'view' THEN event_type END AS fingerprint, sha1(CAST(event_id AS VARCHAR)) AS sha FROM events",
    "results": "SELECT q.conv_id * 100 + q.turn AS task_id, ['context', 'baseline', 'map', 'full', 'pack'][q.conv_id % 5 + 1] AS arm, ['lookup', 'change', 'trace'][q.turn % 3 + 1] AS category, q.text AS question, a.text AS response, list_slice(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(q.text), '[^a-z]+'), lambda w: length(w) >= 4))), 1, 5) AS expected, CAST(length(a.text) * 7 % 1000 AS BIGINT) AS latency_ms, CAST(ceil(length(q.text) / 4) AS BIGINT) AS input_tokens FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn - 1 = q.turn AND q.role = 'user' AND a.role = 'assistant'",
    "changes": "SELECT user_id AS dir, ts, event_type AS state, event_id AS seq FROM events",
}


def with_(names: str, body: str) -> str:
    """A query over relations, which may name others."""
    order = [n for n in SQL if n in names.split() or (n == "places" and "imports" in names.split())]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + (", " if body.lstrip().startswith(",") else " ") + body.lstrip().lstrip(",")
