"""Operator 6, secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a maximal run of 16 or more of ``A-Za-z0-9+/_=.-`` with a letter and a digit; every one of every whole text
is judged. Features: its length, transitions between kinds of characters, coverage by dictionary words, whether it stands
in a path, and the words around it. The forest is fitted on the driver over a bounded number of labelled findings (at most
LABELLED rows; by default made by labelled(), from formats of credentials and of what is mistaken for them) and compiled
to CASE expressions, so that scoring is part of the scan's generated code: no Python, no shuffle.

Nulls and empty texts have no candidates, hence no rows; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

RUN = r"[A-Za-z0-9+/_=.\-]{16,}"
LABELLED, TREES, DEPTH, SEED, KEEP = 4000, 15, 6, 7, 0.5
BEFORE, AFTER = 48, 24
WORDS = (
    "about above access account action active address after again alpha always amount android answer apache apply april array async author auto back backup base batch before begin below beta between binary block board body bool border both bottom box branch browser buffer build button byte cache call cancel card case catch category center chain change channel char chart check child class clean clear click client clone close cloud code color column command comment commit common compare complete component compute config connect console const contact content context control convert cookie copy core count cover create current custom data database date debug default define delete demo deploy depth design detail device digest directory disable display document domain done double down download driver dummy edit editor element email empty enable encode end engine entity entry error event every example exception execute exit export extend extern factory fail false feature fetch field file filter final find first flag float folder font foo footer form format found frame free from function future game gateway general generate get github global graph grid group guide handle handler hash head header height hello help here hidden high hint home host html http icon image impl import index info init inner input insert instance integer interface internal item iterator java javascript join json june keep kernel keyboard label lambda language last layer layout left length level library license light limit line link linux list load local lock log logic login long loop machine main make manage manager map march margin mark master match math matrix media member memory menu merge message meta method minute mobile mock mode model module monitor month mouse move name native nested network never next node none normal note null number object offset online open operator option order origin output override owner package page panel param parent parse part password path pattern pause payload permission person phone picture pixel place placeholder plan platform play player plugin point policy pool port position post prefix preview price print private process product profile program project property protocol provider proxy public pull push python query queue quick random range rank rate read ready real record redirect reference region release remote remove render repeat replace report repo request require reset resolve resource response rest result return review right role root route router row rule run sample save scale scan schema scope score screen script scroll search second section secure security select self send server service session set setting setup shadow share shell shift short show side sign simple single site size sleep small snapshot socket sort source space spec split sql stack stage standard star start state static status step stop storage store stream string struct style submit success suite support switch symbol sync syntax system table target task team temp template term test text theme this thread time title today toggle tool top topic total touch trace track train transaction transform tree trigger true type unit update upload user util utils valid validate value variable vector version video view virtual visible wait watch web week width window with word work worker world wrap write xml xxxx year your zone"
).split()
POSITIVE = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth", "authorization", "bearer", "credential", "private_key", "client_secret"]
NEGATIVE = ["commit", "sha1", "sha256", "sha512", "md5", "checksum", "digest", "hash", "revision", "etag", "uuid", "guid", "fingerprint", "build", "version", "example", "sample", "dummy", "integrity", "id"]
NAMES = ("size", "turns", "covered", "digits", "uppers", "kinds", "distinct", "hexlike", "slashes", "dots", "separators", "pathlike", "assigned", "secretword", "otherword", "repeats")


def _around(words: list[str]) -> str:
    return r"(?i)(?:^|[^a-z])(?:" + "|".join(w.replace("_", "[_ -]?") for w in words) + r")(?:[^a-z]|$)"


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """The features of a candidate with the text before and after it."""
    size = F.length(value).cast("double")
    part = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    flag = lambda condition: condition.cast("double")
    long_words = "|".join(sorted((w for w in WORDS if len(w) > 3), key=lambda w: (-len(w), w)))
    return {
        "size": size,
        "turns": part("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), long_words, "")) / size,
        "digits": part("[0-9]"),
        "uppers": part("[A-Z]"),
        "kinds": sum(flag(value.rlike(p)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[+/_=.-]")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "hexlike": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "slashes": part("/"),
        "dots": part("[.]"),
        "separators": part("[_-]"),
        "pathlike": flag(value.rlike(r"^[\w.-]*/[\w./-]*$|[.][A-Za-z]{1,4}$") | before.rlike(r"[/\\:][\w.-]*$")),
        "assigned": flag(before.rlike(r"""[=:]\s*["'(]?$|(?i)bearer $""")),
        "secretword": flag(before.rlike(_around(POSITIVE)) | value.rlike(r"^(?i)(?:" + "|".join(POSITIVE) + r")[=:._-]")),
        "otherword": flag(before.rlike(_around(NEGATIVE)) | after.rlike(_around(NEGATIVE))),
        "repeats": F.regexp_count(value, F.lit(r"(.)\1\1")) / size,
    }


def labelled(n: int = LABELLED, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(before, value, after, 1 for a secret): invented findings of both kinds."""
    r = random.Random(seed)
    chars = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    hexes, b62, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    word = lambda: r.choice(WORDS)
    prose = lambda k: " ".join(word() for _ in range(k))
    out = []
    while len(out) < n:
        key, other = r.choice(POSITIVE), r.choice(NEGATIVE)
        if r.random() < 0.3:
            key, other = key.upper(), other.upper()
        assign = r.choice([' = "', "=", ": ", ': "', " = '", "='", '": "'])
        secret = r.choice([lambda: chars(hexes, 32, 32), lambda: chars(hexes, 40, 40), lambda: chars(hexes, 64, 64), lambda: chars(hexes.upper(), 40, 40), lambda: chars(b62, 20, 48), lambda: chars(b64, 40, 64) + r.choice(["", "=", "=="]), lambda: r.choice(["sk_live_", "tok-", "key_", "pat_"]) + chars(b62, 20, 36), lambda: chars(string.ascii_uppercase + string.digits, 16, 24), lambda: ".".join(chars(b62 + "_-", 12, 40) for _ in range(3))])()
        digest = r.choice([lambda: chars(hexes, 32, 32), lambda: chars(hexes, 40, 40), lambda: chars(hexes, 64, 64), lambda: "-".join(chars(hexes, k, k) for k in (8, 4, 4, 4, 12)), lambda: chars(b64, 43, 43) + "="])()
        kind = r.random()
        if kind < 0.45:
            before = r.choice([f"{prose(3)} {word()}_{key}{assign}", f"{prose(4)}\n{key}{assign}", f"{prose(2)} Authorization: Bearer ", f"export {key.upper()}=", f'{{"{key}{assign if assign[0] == chr(34) else chr(34) + ": " + chr(34)}'])
            out.append((before, secret, r.choice(['"', "'", " ", "\n", '" ' + prose(2)]), 1))
        elif kind < 0.62:
            out.append((r.choice([f"{prose(3)} {other} ", f"{prose(2)} {other}{assign}", f"{other}: "]), digest, r.choice([" " + prose(2), "\n", '"']), 0))
        elif kind < 0.72:
            value = r.choice([f"your_{key.lower()}_{word()}_{r.randint(1, 999)}", "x" * r.randint(14, 30) + str(r.randint(0, 99)), f"{word()}_{word()}_{word()}_{r.randint(1, 99)}", f"example-{word()}-{word()}-{r.randint(1, 999)}", word().upper() + word().upper() + word().upper() + "123"])
            out.append((f"{prose(2)} {key}{assign}", value.ljust(16, "0"), r.choice(['"', " ", "\n"]), 0))
        elif kind < 0.84:
            value = r.choice(["/".join(word() for _ in range(r.randint(3, 6))) + f"/{word()}{r.randint(1, 99)}.{r.choice(['py', 'ts', 'java', 'html'])}", f"{word()}.{word()}-{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}.tar.gz", f"www.{word()}{word()}{r.randint(1, 99)}.com/{word()}/{word()}"])
            out.append((r.choice([f"{prose(3)} ", f"{prose(2)} https://", f"{prose(1)} /", f"{word()}{assign}"]), value.ljust(16, "1"), " " + prose(2), 0))
        else:
            value = r.choice([f"{word()}{word().title()}{word().title()}{word().title()}{r.randint(1, 99)}", "_".join(word() for _ in range(4)) + str(r.randint(1, 9)), f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}Z", chars(string.digits, 12, 18) + word(), f"{word()}=={chars(string.digits, 8, 14)}"])
            out.append((r.choice([f"{prose(4)} ", f"{prose(2)}\n", f"{word()}{assign}"]), value.ljust(16, "2"), r.choice([" " + prose(2), "()", "\n"]), 0))
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """A forest of nested (feature, threshold, left, right) with leaf shares."""
    rng = np.random.default_rng(seed)
    width = max(1, int(np.sqrt(x.shape[1]) + 1))

    def grow(rows: np.ndarray, level: int):
        share = float(y[rows].mean())
        if level == depth or share in (0.0, 1.0) or len(rows) < 8:
            return share
        best = None
        for f in rng.choice(x.shape[1], width, replace=False).tolist():
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, hit = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            a, total = cut + 1.0, len(rows)
            pa_, pb = hit[cut] / a, (hit[-1] - hit[cut]) / (total - a)
            gini = a * pa_ * (1 - pa_) + (total - a) * pb * (1 - pb)
            k = int(gini.argmin())
            if best is None or gini[k] < best[0]:
                best = (gini[k], f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best is None:
            return share
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[left], level + 1), grow(rows[~left], level + 1))

    return [grow(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)]


def compiled(forest: list, columns: dict[str, Column]) -> Column:
    """The forest's mean share as one expression."""
    names = list(columns)

    def of(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        return F.when(columns[names[node[0]]] <= node[1], of(node[2])).otherwise(of(node[3]))

    return sum((of(t) for t in forest[1:]), of(forest[0])) / len(forest)


def train(spark, findings: list[tuple[str, str, str, int]]) -> list:
    """The forest of labelled findings, at most LABELLED of them; features by the same expressions as in the scan."""
    rows = spark.createDataFrame(findings[:LABELLED], "before string, value string, after string, label int")
    columns = features(F.col("value"), F.col("before"), F.col("after"))
    table = np.array(rows.select(*(v.cast("double").alias(k) for k, v in columns.items()), "label").collect(), float)
    return fit(table[:, :-1], table[:, -1])


@lru_cache(1)
def _default_forest(key: int):
    from pyspark.sql import SparkSession

    return train(SparkSession.active(), labelled())


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start (from 1, in characters), value, before, after of every candidate of docs(doc_id, text)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("runs")).where(F.size("runs") > 0)
    # runs come in order and no shorter run between them can hold one, so each is the next occurrence of its characters
    placed = F.expr("aggregate(runs, named_struct('at', 1, 'out', cast(array() AS array<int>)), (a, x) -> named_struct('at', locate(x, text, a.at) + length(x), 'out', array_append(a.out, locate(x, text, a.at)))).out")
    each = found.select("doc_id", "text", F.explode(F.arrays_zip(F.col("runs").alias("value"), placed.alias("start"))).alias("r"))
    start, value = F.col("r.start"), F.col("r.value")
    near = each.where(value.rlike("[A-Za-z]") & value.rlike("[0-9]"))
    first = F.greatest(start - BEFORE, F.lit(1))
    return near.select("doc_id", start.alias("start"), value.alias("value"), F.col("text").substr(first, start - first).alias("before"), F.col("text").substr(start + F.length(value), F.lit(AFTER)).alias("after"))


def scan(docs: DataFrame, forest: list | None = None, keep: float = KEEP) -> DataFrame:
    """doc_id, start, length, value_sha256, score and kept (a secret by the forest) of every candidate of docs."""
    forest = forest or _default_forest(SEED)
    columns = features(F.col("value"), F.col("before"), F.col("after"))
    named = candidates(docs).select("*", *(v.cast("double").alias(k) for k, v in columns.items()))
    score = compiled(forest, {k: F.col(k) for k in columns})
    return named.select("doc_id", F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), score.alias("score"), (score >= keep).alias("kept"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(c.documents(spark, sf_dir))
