"""Text functions: tokens, identifiers, matching. Builtins where they have the meaning, Arrow otherwise."""

from __future__ import annotations

import ast
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_col(name: str) -> str:
    """A column name without spaces, commas, dots and other signs."""
    return re.sub(r"[^0-9A-Za-z_]", "", name.strip().replace(" ", "_"))


def words(c: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Lower-cased words of `least` letters or more, without stop words, letters only."""
    w = F.split(F.regexp_replace(F.lower(c), r"[^a-z\s]", ""), r"\s+")
    w = F.filter(w, lambda x: F.length(x) >= least)
    return F.array_except(w, F.array(*[F.lit(s) for s in stop])) if stop else w


def identifier(c: Column) -> Column:
    """Trimmed, title case, without spaces."""
    return F.regexp_replace(F.initcap(F.trim(c)), r"\s+", "")


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(ch for ch in unicodedata.normalize("NFD", t) if unicodedata.category(ch) != "Mn"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_list(s: pd.Series) -> pd.Series:
    """A Python list literal as an array of strings; anything else gives null. Never evaluates code."""

    def one(t):
        try:
            got = ast.literal_eval(t)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return [str(x) for x in got] if isinstance(got, (list, tuple)) else None

    return s.map(one)


def jaro(a: str, b: str) -> float:
    """Share of matching characters within half the longer length, with half a point for each transposed one."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    from_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                from_a.append(ch)
                break
    m = len(from_a)
    if not m:
        return 0.0
    from_b = [ch for ch, f in zip(b, free) if not f]
    half = sum(x != y for x, y in zip(from_a, from_b)) / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler_one(a: str | None, b: str | None, scale: float = 0.1, longest: int = 4, boost_from: float = 0.7) -> float | None:
    if a is None or b is None:
        return None
    j = jaro(a, b)
    if j <= boost_from:
        return j
    same = 0
    while same < min(longest, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + same * scale * (1 - j)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_one(x, y) for x, y in zip(a, b)], dtype=float)


#: The endings of the light English stemmer, longest first, with the least letters that must stay.
_ENDINGS = (("ations", 3), ("ation", 3), ("ments", 3), ("ment", 3), ("nesses", 3), ("ness", 3), ("ings", 3), ("ing", 3), ("ies", 2), ("ers", 3), ("ed", 3), ("er", 3), ("es", 3), ("ly", 3), ("s", 3))


def stem_word(w: str) -> str:
    for end, least in _ENDINGS:
        if w.endswith(end) and len(w) - len(end) >= least and not (end == "s" and w.endswith("ss")):
            return w[: -len(end)] + ("y" if end == "ies" else "")
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem(ws: pd.Series) -> pd.Series:
    return ws.map(lambda x: None if x is None else [stem_word(w) for w in x])


@F.pandas_udf(T.StringType())
def strip_wiki(s: pd.Series) -> pd.Series:
    """Wiki markup to plain text: links keep their label, templates, references, comments and tags go."""

    def one(t):
        if t is None:
            return None
        t = re.sub(r"<!--.*?-->|<ref[^>]*/>|<ref.*?</ref>", "", t, flags=re.S)
        while "{{" in t:
            u = re.sub(r"\{\{[^{}]*\}\}", "", t)
            if u == t:
                break
            t = u
        t = re.sub(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1", t)
        return " ".join(re.sub(r"<[^>]+>|'{2,}", "", t).split())

    return s.map(one)


def template_args(c: Column) -> Column:
    """`|key = value` pairs of a wiki template as a map; the first of equal keys counts."""
    pairs = F.transform(F.regexp_extract_all(c, F.lit(r"\|\s*([\w ]+?\s*=[^|}]*)"), 1), lambda x: F.split(x, "=", 2))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(p[0]), F.trim(p[1])))
    keys = F.array_distinct(F.transform(entries, lambda e: e[F.lit("col1")]))
    return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e[F.lit("col1")] == k), 1)))


#: The mail headers that are read.
HEADERS = (
    "Message-ID", "Date", "From", "To", "Subject", "Cc", "Mime-Version", "Content-Type", "Content-Transfer-Encoding", "Bcc",
    "X-From", "X-To", "X-cc", "X-bcc", "X-Folder", "X-Origin", "X-FileName",
)


def mail_columns(message: Column) -> dict[str, Column]:
    """One column for each header (missing: empty), the body, and whether it forwards."""
    halves = F.split(message, r"\r?\n\r?\n", 2)
    head, body = F.regexp_replace(halves[0], r"\r?\n[ \t]+", " "), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
    out = {h.lower().replace("-", "_"): F.trim(F.regexp_extract(head, rf"(?mi)^{h}:(.*)$", 1)) for h in HEADERS}
    mark = r"(?s)-{3,}\s*(?:Forwarded by|Original Message).*$"
    return out | {"content": F.btrim(F.regexp_replace(body, mark, ""), F.lit(" \t\r\n")), "if_forwarded": body.rlike(mark)}
