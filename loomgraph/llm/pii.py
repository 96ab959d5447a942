"""Personal data by bootstrapped contextual extraction.

Seed entities are what the base expressions find, and values assigned to a
credential word. Every identifier-like token is an instance, and so is every
value that is assigned to a name; a lexical pattern is the two words before a
token and its shape, or the name and sign before a value of any shape. Spark
scores the graph of patterns and instances in rounds: a pattern by the share of
its instances that are trusted, an instance by its patterns. A name that is a
credential word gives its pattern a head start of some trusted instances. The
patterns that reach a high confidence, and they alone, then mark identifiers:
broadcast while they are few, else by joins. Patterns that have only ever met
base entities add nothing and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, table, unpacked, written

KINDS = ("email", "ip", "card", "phone")
#: The kind of what only the method finds.
FOUND = "id"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Words after which a value is a credential.
_CREDENTIAL = re.compile(r"(?:token|secret|password|passwd|api[_-]?key)\Z")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z0-9_-]*+)[\x20\t]*+([=:])[\x20\t]*+[\"']?([A-Za-z0-9_./+=-]{8,}+)")
_INSTANCE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._@+/=-]{4,})[A-Za-z0-9]")
_HEX = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}")
_RUN = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|.")
#: Characters before an instance in which its two words are looked for.
REACH = 64

#: Longer tokens are compared by a hash of their shape and of themselves.
LONG = 64

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @: its domain, and the longest local part that no earlier match holds."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """The contract's four kinds, each leftmost and non-overlapping, failing matches dropped; by kind, then start."""
    found = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(m[0]) <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def shape(token: str) -> str:
    """Runs of digits and letters with their lengths (letters up to four: any more is a word's chance), other characters as they are."""
    if _HEX.fullmatch(token):
        return f"x{len(token)}"
    return "".join(f"{'d' if r[0].isdigit() else 'a' if r[0].islower() else 'A'}{min(len(r), 20) if r[0].isdigit() else min(len(r), 5)}" if r[0].isalnum() else r for r in _RUN.findall(token))


def _short(*texts: str) -> Iterator[str]:
    return (x if len(x) <= LONG else f"#{xxhash.xxh3_128_hexdigest(x)}" for x in texts)


def instances(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, token, pattern) of identifier-like tokens (six characters or more, four digits or more) and of assigned values (eight or more)."""
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            token, name = _short(m[3], m[1].lower())
            yield *m.span(3), token, f"{name} {m[2]} _"
    if not _DIGIT.search(text):
        return
    for m in _INSTANCE.finditer(text):
        token = m[0]
        if sum(c.isdigit() for c in token) >= 4:
            before = re.sub("[0-9]+", "0", text[max(0, m.start() - REACH) : m.start()].lower()).split()[-2:]
            form = shape(token)
            if len(token) > LONG:
                form, token = _short(form.ljust(LONG + 1), token)
            yield m.start(), m.end(), token, " ".join(before) + " _ " + form


def credentials(text: str) -> list[tuple[int, int]]:
    """Places of values that are assigned to a credential word: seeds."""
    return [m.span(3) for m in _ASSIGNED.finditer(text) if _CREDENTIAL.search(m[1].lower())]


def _observe():
    schema = pa.schema([("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_()), ("base", pa.bool_()), ("named", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for x in batch.column(0):
                text = x.as_py() or ""
                base = None
                for start, end, token, pattern in instances(text):
                    if base is None:
                        base, keyed = [(s, e) for _, s, e in base_spans(text)], credentials(text)
                    in_base = any(s < end and start < e for s, e in base)
                    in_keyed = any(s < end and start < e for s, e in keyed)
                    whole = any(s <= start and end <= e for s, e in base)  # nothing is left for a pattern to add
                    rows.add((pattern, token, in_base or in_keyed, whole, in_keyed and pattern.endswith(" _")))
            cols = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return run


@dataclass(frozen=True)
class Params:
    """max_patterns bounds the model that is broadcast, not the model: more are joined (patterns hold REACH + 2 * LONG + 3 characters at most: under 2 MB).

    head_start counts as so many trusted instances for the pattern of a credential word.
    """

    rounds: int = 3
    min_support: int = 3
    min_score: float = 0.7
    max_patterns: int = 5_000
    head_start: int = 3


def fit(docs: DataFrame, params: Params = Params()) -> frozenset[str] | DataFrame:
    """The patterns of high confidence, learned from all documents; a DataFrame of them where they exceed max_patterns."""
    seen = docs.select(F.col("text").cast("string")).mapInArrow(_observe(), "pattern string, instance string, seed boolean, base boolean, named boolean")
    edges = written(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min("base").alias("base"), F.max("named").alias("named")))
    trusted = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    start = F.when(F.max("named"), float(params.head_start)).otherwise(0.0)
    scored = None
    for _ in range(params.rounds):
        scored = (
            edges.join(trusted, "instance")
            .groupBy("pattern")
            .agg((F.sum("trust") + start).alias("good"), (F.count("*") + start).alias("n"), F.min("base").alias("base"))
            .select("pattern", "n", (F.col("good") / (F.col("n") + 1)).alias("score"), "good", "base")
        )
        trusted = (
            edges.join(scored.drop("base"), "pattern")
            .groupBy("instance")
            .agg(F.when(F.max("seed"), 1.0).otherwise(F.avg("score")).alias("trust"))
        )
    best = written(scored.where((F.col("good") >= params.min_support) & (F.col("score") >= params.min_score) & ~F.col("base")).select("pattern"))
    forget(edges)
    rows = best.limit(params.max_patterns + 1).collect()
    if len(rows) > params.max_patterns:
        return best
    forget(best)
    return frozenset(r[0] for r in rows)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, pattern) of each text's patterns."""
    schema = pa.schema([("key", pa.int64()), ("pattern", pa.string())])
    for batch in batches:
        rows = {(k, i[3]) for k, x in zip(batch.column(0).to_pylist(), batch.column(1)) for i in instances(x.as_py() or "")}
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), ()), schema.types)], schema=schema)


def _with_hits(docs: DataFrame, patterns: frozenset[str] | DataFrame) -> DataFrame:
    """docs with loom_hits, the patterns of the model that a row's text has: null where the model is broadcast."""
    if isinstance(patterns, frozenset):
        return docs.withColumn("loom_hits", F.lit(None).cast("array<string>"))
    key = F.xxhash64(F.col("text").cast("string"))  # texts that share a key only share more patterns of the model
    seen = docs.select(key.alias("key"), F.col("text").cast("string")).mapInArrow(_patterns, "key long, pattern string").distinct()
    hits = seen.join(patterns.hint("merge"), "pattern", "left_semi").groupBy("key").agg(F.collect_set("pattern").alias("loom_hits"))
    none = F.array().cast("array<string>")
    joined = docs.withColumn("loom_key", key).join(hits.withColumnRenamed("key", "loom_key").hint("merge"), "loom_key", "left")
    return joined.withColumn("loom_hits", F.coalesce("loom_hits", none)).drop("loom_key")


def all_spans(text: str, patterns: frozenset[str]) -> tuple[list[Span], list[Span]]:
    """(base spans, what the patterns add); an added span overlaps no other span."""
    base = base_spans(text)
    added = []
    marked = [(start, end) for start, end, _, pattern in instances(text) if pattern in patterns] if patterns else []
    if marked:
        taken = sorted((s, e) for _, s, e in base)
        for start, end in _merged(marked):
            for s, e in [*((s, e) for s, e in taken if s < end and start < e), (end, end)]:
                if any(map(str.isalnum, text[start:s])):
                    added.append((FOUND, start, s))
                start = max(start, e)
    return base, added


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _spans(model):
    names = [*(f"n_{k}" for k in KINDS), "n_id"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = model.value
        write = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        for batch in batches:
            rows = []
            for doc, x, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                base, added = all_spans(x.as_py() or "", patterns if hits is None else frozenset(hits))
                count = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((doc, *count, len(added), write(base), write(base + added)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def find(docs: DataFrame, patterns: frozenset[str] | DataFrame) -> DataFrame:
    """doc_id, counts by kind, base and spans ("kind:start:end", comma-joined) of every row's whole text.

    A null or empty text has none; repeated rows come out repeated; an empty
    table gives no rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(patterns if isinstance(patterns, frozenset) else frozenset())  # max_patterns short strings at most
    names = ", ".join(f"n_{k} long" for k in (*KINDS, "id"))
    rows = _with_hits(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), patterns)
    return rows.mapInArrow(_spans(model), f"doc_id long, {names}, base string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by the kind of its first one in brackets."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, patterns: frozenset[str] | DataFrame) -> DataFrame:
    """docs with personal data replaced in text (and n_chars, if there, counted anew).

    A null text stays null; repeated rows are treated row by row; an empty table gives no rows; columns may have any names.
    """
    few = isinstance(patterns, frozenset)
    model = docs.sparkSession.sparkContext.broadcast(patterns if few else frozenset())

    @F.pandas_udf("string")
    def clean(texts):
        found = model.value
        return texts.map(lambda t: t if t is None else redacted(t, sum(all_spans(t, found), [])))

    @F.pandas_udf("string")
    def clean_by(texts, hits):
        return texts.combine(hits, lambda t, h: t if t is None else redacted(t, sum(all_spans(t, frozenset(h)), [])))

    packed = docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))
    out = packed.withColumn("new", clean("text")) if few else _with_hits(packed, patterns).withColumn("new", clean_by("text", "loom_hits"))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return unpacked(out, "doc", docs.columns, new)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind and the spans of every document, with patterns learned from all of them; edge rows as in find()."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_id")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the documents is replaced by its kind; edge rows as in redact()."""
    return redact(docs, fit(docs))
