"""Text columns: tokens, identifiers, paths, globs, rounding and canonical JSON."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as k

#: A boundary inside an identifier: underscore, camel, acronym, letter to digit and back.
IDENT_BREAK = r"_|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def _composing() -> str:
    """A pattern of ASCII letters with marks that have a composed form with them."""
    marks: dict[str, str] = {}
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        found = "".join(m for m in map(chr, range(0x300, 0x370)) if len(unicodedata.normalize("NFC", letter + m)) == 1)
        marks[found] = marks.get(found, "") + letter
    return "|".join(f"[{letters}][\u0300-\u036f]*?[{found}]" for found, letters in marks.items() if found)


COMPOSING = _composing()


def composed(text: Column) -> Column:
    """Text as tokens see it after Unicode composition: a letter that a mark composes with is no ASCII letter any more, so
    both become a separator. Native; only texts that hold combining marks are rewritten."""
    return F.when(text.rlike("[\u0300-\u036f]"), F.regexp_replace(text, COMPOSING, "\u00e9")).otherwise(text)


def split_identifier(name: Column) -> Column:
    """Lower-cased parts of an identifier, of two characters or more."""
    return F.transform(F.filter(F.split(name, IDENT_BREAK), lambda x: F.length(x) >= 2), F.lower)


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Ordered tokens: each fragment lower-cased, then the parts it has if they add anything; stopwords go."""

    def of(fragment: Column) -> Column:
        parts = split_identifier(fragment)
        more = (F.size(parts) > 1) | ((F.size(parts) == 1) & (parts[0] != F.lower(fragment)))
        return F.concat(F.array(F.lower(fragment)), F.when(more, parts).otherwise(F.array().cast("array<string>")))

    fragments = F.filter(F.split(composed(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9_]+"), lambda x: F.length(x) >= 2)
    found = F.flatten(F.transform(fragments, of))
    return found if keep_stopwords else F.filter(found, lambda x: ~x.isin(k.STOPWORDS))


#: A fragment that isn't one plain word.
STRUCTURED = r"_|[0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]"


def token_bag(text: Column, keep_stopwords: bool = False) -> Column:
    """tokens() in no order: only structured fragments, which are few, are taken apart."""
    fragments = F.filter(F.split(composed(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9_]+"), lambda x: F.length(x) >= 2)

    def parts(w: Column) -> Column:
        found = split_identifier(w)
        return F.when((F.size(found) > 1) | ((F.size(found) == 1) & (found[0] != F.lower(w))), found).otherwise(F.array().cast("array<string>"))

    more = F.flatten(F.transform(F.filter(fragments, lambda x: x.rlike(STRUCTURED)), parts))
    found = F.concat(F.transform(fragments, F.lower), more)
    return found if keep_stopwords else F.filter(found, lambda x: ~x.isin(k.STOPWORDS))


def _alone(words: list[str]) -> str:
    """A pattern of whole fragments, whatever their case."""
    return "(?i)(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")(?![A-Za-z0-9_])"


def token_parts(text: Column, keep_stopwords: bool = False) -> Column:
    """The tokens that structured fragments have beside themselves."""
    fragments = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]*?(?:_|[0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z])[A-Za-z0-9_]*"), F.lit(0))

    def parts(w: Column) -> Column:
        found = split_identifier(w)
        return F.when((F.size(found) > 1) | ((F.size(found) == 1) & (found[0] != F.lower(w))), found).otherwise(F.array().cast("array<string>"))

    more = F.flatten(F.transform(F.filter(fragments, lambda x: F.length(x) >= 2), parts))
    return more if keep_stopwords else F.filter(more, lambda x: ~x.isin(k.STOPWORDS))


def token_count(text: Column, parts: Column, keep_stopwords: bool = False) -> Column:
    """How many tokens() a composed text has, given its token_parts(): counted by patterns, without making them."""
    all_ = F.regexp_count(text, F.lit("[A-Za-z0-9_]{2,}")) + F.size(parts)
    return all_ if keep_stopwords else all_ - F.regexp_count(text, F.lit(_alone(sorted(w for w in k.STOPWORDS if len(w) > 1))))


def token_hits(text: Column, parts: Column, terms: list[str]) -> Column:
    """Those of tokens() that are among terms, none of them a stopword, and further parts; found by one pattern."""
    return F.concat(F.transform(F.regexp_extract_all(text, F.lit(_alone(terms)), F.lit(0)), F.lower), parts)


def token_rows(rows: DataFrame, keep: list[str], text: str, out: str = "term") -> DataFrame:
    """keep and one row per token of the column text, in no order: fragments are exploded first, so that plain words, nearly
    all of them, stay in generated code and only structured ones are split further. Stopwords are left in."""
    w = F.col("_w")
    fragments = rows.select(*keep, F.explode(F.split(composed(F.coalesce(F.col(text), F.lit(""))), "[^A-Za-z0-9_]+")).alias("_w")).where(F.length(w) >= 2)
    parts = split_identifier(w)
    more = (F.size(parts) > 1) | ((F.size(parts) == 1) & (parts[0] != F.lower(w)))
    each = F.when(w.rlike(STRUCTURED), F.concat(F.array(F.lower(w)), F.when(more, parts).otherwise(F.array().cast("array<string>")))).otherwise(F.array(F.lower(w)))
    return fragments.select(*keep, F.explode(each).alias(out))


def plain_tokens(text: str, keep_stopwords: bool = False) -> list[str]:
    """tokens() of a driver's string: a query, not data."""
    out = []
    for fragment in re.split(r"[^A-Za-z0-9_]+", unicodedata.normalize("NFC", text)):
        if len(fragment) < 2:
            continue
        parts = [p.lower() for p in re.split(IDENT_BREAK, fragment) if len(p) >= 2]
        out.append(fragment.lower())
        if len(parts) > 1 or (parts and parts[0] != fragment.lower()):
            out += parts
    return out if keep_stopwords else [x for x in out if x not in k.STOPWORDS]


def dirname(path: Column) -> Column:
    """The directory of a path, '.' for none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With the dot, lower-cased; empty for none or for a leading dot alone."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.when(path == ".", 0).otherwise(F.size(F.split(path, "/")))


def ancestors(path: Column) -> Column:
    """A directory, its ancestors up to the root '.', deepest first."""
    parts = F.split(path, "/")
    below = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(path == ".", F.array(F.lit("."))).otherwise(F.concat(below, F.array(F.lit("."))))


def in_scope(path: Column, scope: Column) -> Column:
    """Whether a path is a scope or lies under it."""
    return (scope == ".") | (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def normalize_scope(scope: str) -> str:
    out = re.sub(r"/{2,}", "/", re.sub(r"^(\./)+", "", scope.replace("\\", "/"))).rstrip("/")
    return out or "."


def safe_relative(path: str) -> str | None:
    """A project-relative path, or None where it is absolute or leaves the project."""
    if path.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", path):
        return None
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p in ("", "."):
            continue
        if p == "..":
            if not parts:
                return None
            parts.pop()
        else:
            parts.append(p)
    return "/".join(parts) or "."


def _braces(pattern: str) -> list[str]:
    a = pattern.find("{")
    b = pattern.find("}", a + 1)
    if a < 0 or b < 0:
        return [pattern]
    return [pattern[:a] + one + rest for one in pattern[a + 1 : b].split(",") for rest in _braces(pattern[b + 1 :])]


def glob_regex(pattern: str, braces: bool = True) -> str:
    """A whole-string regular expression for *, **, **/, ? and {a,b}; works in Java, Python and RE2."""

    def one(p: str) -> str:
        out, rest = "", p
        while rest:
            for shape, regex in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
                if rest.startswith(shape):
                    out, rest = out + regex, rest[len(shape) :]
                    break
            else:
                out, rest = out + re.escape(rest[0]), rest[1:]
        return out

    return "^(?:" + "|".join(one(p) for p in (_braces(pattern) if braces else [pattern])) + r")\z"


def matches_glob(path: Column, patterns: str | list[str]) -> Column:
    """Globs in order, the last match decides; ! negates; negated ones alone never match."""
    listed = [patterns] if isinstance(patterns, str) else list(patterns)
    out = F.lit(False)
    if all(p.startswith("!") for p in listed):
        return out
    for p in listed:
        out = F.when(path.rlike(glob_regex(p.lstrip("!") if p.startswith("!") else p)), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore rules in order, the last match decides: with a slash against the path, else against any segment."""
    out = F.lit(False)
    for raw in patterns:
        body = raw.strip().lstrip("!") if raw.strip().startswith("!") else raw.strip()
        body = normalize_scope(body).lstrip("/")
        if not body or body == "." or raw.lstrip().startswith("#"):
            continue
        regex = glob_regex(body, braces=False)
        hit = path.rlike(regex) if "/" in body else F.exists(F.split(path, "/"), lambda s: s.rlike(regex))  # noqa: B023
        out = F.when(hit, F.lit(not raw.strip().startswith("!"))).otherwise(out)
    return out


def fingerprint_ignored(name: Column, patterns: list[str]) -> Column:
    """Exact names or *.ext."""
    out = F.lit(False)
    for p in patterns:
        out = out | (F.endswith(name, F.lit(p[1:])) if p.startswith("*.") else name == p)
    return out


def round_half_up(x: Column, digits: int = 1) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def estimate_tokens(chars: Column) -> Column:
    return F.ceil(chars / k.BYTES_PER_TOKEN)


def canonical(columns: dict[str, Column]) -> Column:
    """JSON with keys in order."""
    return F.to_json(F.struct(*(columns[n].alias(n) for n in sorted(columns))))


def line_count(text: Column) -> Column:
    """Lines as split by \\n counts them; an empty text has none."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n", -1)))
