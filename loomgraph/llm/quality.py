"""Quality rules as learned decision lists, in DataFrame expressions only.

Text statistics are Spark SQL expressions. A bounded sample of labelled rows
gives a table of threshold-bin counts; sequential covering grows conjunctions
of thresholds on one part of it, prunes them on the other, and the ordered
list comes out as one conditional expression that Spark evaluates per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import WHITE, WHITE_RUN, table

#: The symbols that n_symbols counts, the window of repeated words, the base limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Statistics on which rules may put thresholds. None follows the length of a text: the share of distinct words, say, falls
#: with it, and a threshold learned on short texts would reject long clean ones.
FEATURES = ("symbol_ratio", "upper_ratio", "bang_ratio", "pipe_ratio", "dup_line_ratio", "repeat_ratio", "echo_ratio", "mean_word", "digit_ratio")


@dataclass(frozen=True)
class Params:
    """sample_rows bounds the labelled rows that the fit reads (they are chosen by a hash of doc_id)."""

    sample_rows: int = 20_000
    bins: int = 24
    max_rules: int = 12
    max_conditions: int = 3
    min_cover: int = 4
    min_precision: float = 0.95


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _only(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _repeat_words(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; grams: a hash for each window start."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        gaps = F.zip_with(F.slice(starts, 1, n - 1), F.slice(starts, 2, n - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x)

    def twice(order: Column) -> Column:
        last = F.size(order) - 1
        at = F.transform(
            order,
            lambda e, j: F.when(
                ((j > 0) & (order[F.greatest(j - 1, F.lit(0))]["h"] == e["h"]))
                | ((j < last) & (order[F.least(j + 1, last)]["h"] == e["h"])),
                e["i"],
            ),
        )
        return let(F.sort_array(F.filter(at, lambda x: x.isNotNull())), covered)

    order = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(order, twice)).otherwise(0).cast("long")


def _pairs(hashes: Column, step: int) -> Column:
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (all its columns) with the base counts and FEATURES, each prefixed "q_"; a null text has no words.

    Empty texts give zero counts and zero ratios; ties do not arise; repeated
    rows are counted row by row. Columns of docs named q_* are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    a = docs.withColumns({"q_words": words, "q_lines": lines})
    b = a.withColumns(
        {
            "q_n_words": F.size("q_words").cast("long"),
            "q_word_chars": F.length(F.array_join("q_words", "")).cast("long"),
            "q_n_symbols": _only(t, SYMBOLS.replace("|", r"\|").replace("&", r"\&")),
            "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_n_lines": F.size("q_lines").cast("long"),
            "q_upper": _only(t, "A-Z"),
            "q_bang": _only(t, "!"),
            "q_pipe": _only(t, r"\|"),
            "q_digit": _only(t, "0-9"),
            "q_hash": F.transform("q_words", lambda w: F.xxhash64(w)),
        }
    ).drop("q_words", "q_lines")
    after = F.greatest(F.size("q_hash") - 1, F.lit(0))
    echo = F.zip_with(F.slice("q_hash", F.lit(1), after), F.slice("q_hash", F.lit(2), after), lambda x, y: x == y)
    c = b.withColumns({"q_two": _pairs(F.col("q_hash"), 1), "q_n_echo": F.size(F.filter(echo, lambda x: x)).cast("long")}).drop("q_hash")
    d = c.withColumn("q_four", _pairs(F.col("q_two"), 2)).drop("q_two")
    e = d.withColumn("q_grams", _pairs(F.col("q_four"), 4)).drop("q_four")
    f = e.withColumn("q_n_repeat_words", _repeat_words(F.col("q_grams"))).drop("q_grams")
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return f.withColumns(
        {
            "q_symbol_ratio": per("q_n_symbols", "q_word_chars"),
            "q_upper_ratio": per("q_upper", "q_word_chars"),
            "q_bang_ratio": per("q_bang", "q_word_chars"),
            "q_pipe_ratio": per("q_pipe", "q_n_words"),
            "q_dup_line_ratio": per("q_n_dup_lines", "q_n_lines"),
            "q_repeat_ratio": per("q_n_repeat_words", "q_n_words"),
            "q_echo_ratio": per("q_n_echo", "q_n_words"),
            "q_mean_word": per("q_word_chars", "q_n_words"),
            "q_digit_ratio": per("q_digit", "q_word_chars"),
        }
    ).drop("q_upper", "q_bang", "q_pipe", "q_digit", "q_n_echo", "q_n_lines")


@dataclass(frozen=True)
class Rule:
    """All of conditions (feature, is_at_least, threshold) hold: reject."""

    conditions: tuple[tuple[str, bool, float], ...]

    def expression(self) -> Column:
        out = F.lit(True)
        for feature, at_least, cut in self.conditions:
            x = F.col(f"q_{feature}")
            out = out & ((x >= cut) if at_least else (x < cut))
        return out


def base_failed() -> Column:
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words"))


def decision_list(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, 0 where none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.expression(), k).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> list[Rule]:
    """Rules learned from at most params.sample_rows labelled documents; none where there are no labels.

    Labels that are null, documents without a label and labels without a
    document take no part; a repeated label counts as often as it occurs.
    """
    some = (
        labels.select(F.col("doc_id").alias("q_id"), F.col("quality").cast("int").alias("q_label"))
        .where("q_id is not null and q_label in (0, 1)")
        .orderBy(F.xxhash64("q_id"), "q_id", "q_label")
        .limit(params.sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("q_id"))  # sample_rows rows at most
    stats = statistics(rows).withColumn("q_base_failed", base_failed())
    # one row for each sampled document, so sample_rows rows at most reach the driver
    got = stats.select("doc_id", "q_label", "q_base_failed", *[f"q_{f}" for f in FEATURES]).collect()
    got = sorted((r for r in got if not r["q_base_failed"]), key=tuple)
    if not got:
        return []
    bad = np.array([r["q_label"] == 0 for r in got])
    values = np.array([[float(x) for x in r[3:]] for r in got])
    grown = np.array([(r["doc_id"] * 2654435761 >> 7) % 3 != 0 for r in got])
    return _cover(values, bad, grown, params)


def _cuts(column: np.ndarray, bad: np.ndarray, bins: int) -> np.ndarray:
    both = [np.quantile(column[m], np.linspace(0, 1, bins + 1)) for m in (bad, ~bad) if m.any()]
    edges = np.unique(np.concatenate(both))
    return (edges[1:] + edges[:-1]) / 2


def _cover(values: np.ndarray, bad: np.ndarray, grown: np.ndarray, p: Params) -> list[Rule]:
    """Sequential covering: grow by FOIL gain, prune by (p - n) / (p + n), take off what is covered, repeat."""
    masks, names = [], []
    for f, name in enumerate(FEATURES):
        for cut in _cuts(values[:, f], bad, p.bins):
            for at_least in (True, False):
                masks.append(values[:, f] >= cut if at_least else values[:, f] < cut)
                names.append((name, at_least, float(cut)))
    rules: list[Rule] = []
    if not masks:
        return rules
    table_ = np.array(masks)
    left = np.ones(len(bad), bool)
    while len(rules) < p.max_rules and (left & bad).sum() >= p.min_cover:
        now, chosen = left & grown, []
        while len(chosen) < p.max_conditions and (now & ~bad).any():
            pos, neg = (now & bad).sum(), (now & ~bad).sum()
            p1 = (table_ & (now & bad)).sum(1)
            n1 = (table_ & (now & ~bad)).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(pos / (pos + neg)))
            gain = np.where(p1 >= p.min_cover, gain, -np.inf)
            best = int(np.nanargmax(np.where(np.isfinite(gain), gain, -1e300)))
            if not gain[best] > 1e-9:
                break
            chosen.append(best)
            now = now & table_[best]
        if not chosen:
            break
        held = left & ~grown

        def worth(conditions: list[int], rows: np.ndarray) -> float:
            hit = rows & table_[conditions].all(0)
            x, y = (hit & bad).sum(), (hit & ~bad).sum()
            return (x - y) / (x + y) if x + y else -1.0

        keep = max((chosen[:k] for k in range(1, len(chosen) + 1)), key=lambda c: (worth(c, held), -len(c)))
        hit = left & table_[keep].all(0)
        good_hits, bad_hits = (hit & ~bad).sum(), (hit & bad).sum()
        if bad_hits < p.min_cover or bad_hits / (bad_hits + good_hits) < p.min_precision:
            keep = chosen
            hit = left & table_[keep].all(0)
            good_hits, bad_hits = (hit & ~bad).sum(), (hit & bad).sum()
            if bad_hits < p.min_cover or bad_hits / (bad_hits + good_hits) < p.min_precision:
                break
        rules.append(Rule(tuple(names[k] for k in keep)))
        left &= ~hit
    return rules


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the statistics, q_base_failed, q_rule (the first rule that rejects, else 0) and q_kept."""
    out = statistics(docs).withColumn("q_base_failed", base_failed()).withColumn("q_rule", decision_list(rules))
    return out.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_rule") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; edge rows as in statistics(): a null or empty text fails the base limits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select(
        "doc_id",
        *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.col("q_rule").alias("rule"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the base limits reject go; columns stay, whatever they are called.

    A null or empty text has no words and is rejected; a null doc_id is judged
    like any other; repeated rows are judged row by row; an empty table gives no
    rows, and without labels the base limits alone decide.
    """
    rules = fit(docs, table(spark, sf_dir, "labels"))
    packed = docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))
    # the pin keeps the filter above the statistics: pushed below, it would compute them again inside the predicate
    judged = judge(packed, rules).withColumn("q_pin", F.monotonically_increasing_id())
    return judged.where("q_kept and q_pin >= 0").select("doc.*")
