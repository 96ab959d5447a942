"""URL filters: rules first, then naive Bayes over segmented host and path words.

Host labels are often words run together. A unigram Viterbi pass splits every
run of letters into dictionary words; multinomial naive Bayes, trained on
all different hosts and paths with hosts that hold a seed word as the block
class, scores the segmented tokens of host and path (of two letters or more). A
rule that fits always overrides it.

A dictionary of few words is broadcast. A larger one stays a table: every
different run of letters meets the words among its own stretches by a join, is
split with those alone, and tokens meet their weights by a join; both ways give
the same verdicts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, table, written

#: The contract's rules (host, path, action).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Words of the hosts that train the block class.
SEED_WORDS = (
    "spam", "pills", "casino", "viagra", "porn", "xxx", "sex", "adult", "escort", "gambling", "poker", "bet", "bets", "betting", "loans",
    "payday", "malware", "phishing", "warez", "crack", "torrent", "replica", "jackpot", "clickbait", "ads", "adserver", "track", "tracker", "tracking",
)
#: Common words that dictionaries of any table start with, each with the weight of one sighting.
COMMON_WORDS = (
    "farm", "cheap", "best", "free", "online", "shop", "store", "buy", "sale", "deal", "deals", "news", "blog", "www", "mail", "home", "page",
    "web", "site", "world", "city", "the", "my", "your", "and", "for", "of", "in", "to", "health", "money", "game", "games", "play", "win", "live",
    "video", "photo", "book", "music", "travel", "food", "school", "science", "example", "com", "net", "org", "html", "index", "en", "de", "fr", "es",
)


@dataclass(frozen=True)
class Params:
    """vocabulary bounds the words of the model that is broadcast (of at most longest letters each), not the model: beyond it joins do the same.

    prior is the log odds of block before any token; the classes count alike, as seed words show few of the hosts to block.
    """

    vocabulary: int = 50_000
    longest: int = 24
    smoothing: float = 1.0
    unknown: float = 0.05
    prior: float = 0.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its action) of the longest rule that fits, else nulls."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(action)
    return name, action


def letters(host: Column, path: Column) -> Column:
    """Runs of letters of host and path, lower-cased."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", host, path)), r"[^\p{L}]+"), lambda w: w != "")


def dictionary_words(host: Column, path: Column) -> Column:
    """Words of the path, and of host labels that signs divide; a label in one run may be several words, so it is no evidence."""
    split = lambda x: F.filter(F.split(F.lower(x), r"[^\p{L}]+"), lambda w: w != "")
    labels = F.filter(F.transform(F.split(host, r"\."), split), lambda ws: F.size(ws) > 1)
    return F.concat(F.flatten(labels), split(path))


def segment(word: str, cost: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The cheapest split of word into dictionary words; letters that no word covers cost `unknown` each and stay together."""
    n = len(word)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            c = best[i] + cost.get(word[i:j], unknown * (j - i) if j - i == 1 else math.inf)
            if c < best[j] - 1e-12:
                best[j], back[j] = c, i
    cuts, j = [], n
    while j:
        cuts.append((back[j], j))
        j = back[j]
    out: list[str] = []
    loose = ""
    for i, j in reversed(cuts):
        if j - i == 1 and word[i:j] not in cost:
            loose += word[i:j]
        else:
            if loose:
                out.append(loose)
                loose = ""
            out.append(word[i:j])
    return [*out, loose] if loose else out


@dataclass(frozen=True)
class Model:
    """total: the weight of all dictionary words. words: cost of each word by name, or a table (w, n). weight: of each token, or a table (token, weight)."""

    total: float
    unknown: float
    longest: int
    words: dict[str, float] | DataFrame
    weight: dict[str, float] | DataFrame
    other: float
    prior: float


def _segmenter(cost: dict[str, float], unknown: float, longest: int):
    return lru_cache(100_000)(lambda word: tuple(segment(word, cost, unknown, longest)))


def _token(t: str, known) -> str:
    return t if t in known else "?"


def _split_runs(runs: DataFrame, model_words: dict[str, float] | DataFrame, total: float, unknown: float, longest: int) -> DataFrame:
    """(run, tokens) of distinct runs (run); a token that is no dictionary word is "?"."""
    if isinstance(model_words, dict):
        held = runs.sparkSession.sparkContext.broadcast(model_words)  # vocabulary words at most

        @F.pandas_udf("array<string>")
        def split(found):
            import pandas as pd

            cut = _segmenter(held.value, unknown, longest)
            return pd.Series([[_token(t, held.value) for t in cut(w) if len(t) > 1] for w in found], dtype=object)

        return runs.withColumn("tokens", split("run"))
    size = F.length("run")
    starts = F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)))
    stretches = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.least(F.lit(longest), size - i + 1), F.lit(2))), lambda n: F.substring(F.col("run"), i, n))))
    asked = runs.select("run", F.explode(F.array_distinct(stretches)).alias("w"))
    own = asked.join(model_words.hint("merge"), "w").groupBy("run").agg(F.collect_list(F.struct("w", "n")).alias("words"))  # of a run's own stretches

    @F.pandas_udf("array<string>")
    def split_by(found, words):
        import pandas as pd

        out = []
        for w, some in zip(found, words):
            cost = {r["w"]: -math.log(r["n"] / total) for r in some} if some is not None else {}
            out.append([_token(t, cost) for t in segment(w, cost, unknown, longest) if len(t) > 1])
        return pd.Series(out, dtype=object)

    return runs.join(own.hint("merge"), "run", "left").select("run", split_by("run", "words").alias("tokens"))


def fit(pages: DataFrame, p: Params = Params()) -> Model:
    """Word counts and class counts over all urls; the driver gets `vocabulary` words and two counts of each at most, beyond that a few sums."""
    spark = pages.sparkSession
    url = F.col("url").cast("string")
    # unigram counts over different hosts and paths: one busy host must not drown the rest
    places = pages.select(host_of(url).alias("h"), path_of(url).alias("p")).distinct()
    seen = places.select(F.explode(dictionary_words(F.col("h"), F.col("p"))).alias("w")).where(F.length("w").between(2, p.longest))
    base = spark.createDataFrame([(w,) for w in dict.fromkeys((*SEED_WORDS, *COMMON_WORDS))], "w string")
    words = seen.unionByName(base).groupBy("w").agg(F.count("*").cast("double").alias("n"))
    few = words.count() <= p.vocabulary
    words = words if few else written(words)
    total = float(words.agg(F.sum("n")).first()[0])
    unknown = -math.log(p.unknown / total)
    cost = {r["w"]: -math.log(r["n"] / total) for r in words.collect()} if few else words
    # each host and path of words trains once, however many pages it has: one busy host must not stand for a class
    rows = places.select(letters(F.col("h"), F.col("p")).alias("words"), letters(F.col("h"), F.lit("")).alias("host")).distinct()
    runs = rows.select(F.explode("words").alias("run")).distinct()
    tokens = written(_split_runs(runs, cost, total, unknown, p.longest))
    own = rows.withColumn("row", F.monotonically_increasing_id())
    own = written(own.select("row", F.explode("words").alias("run"), "host").select("row", "run", F.array_contains("host", F.col("run")).alias("in_host")))
    each = own.join(tokens, "run").select("row", "in_host", F.explode("tokens").alias("token"))
    bad = each.groupBy("row").agg(F.max(F.col("in_host") & F.col("token").isin(*SEED_WORDS)).alias("bad"))
    counted = each.join(bad, "row").groupBy("token").agg(F.sum(F.col("bad").cast("double")).alias("b"), F.sum((~F.col("bad")).cast("double")).alias("g"))
    counted = written(counted)
    forget(own)
    sums = counted.agg(F.sum("b"), F.sum("g"), F.max(F.when(F.col("token") == "?", F.col("b"))), F.max(F.when(F.col("token") == "?", F.col("g")))).first()
    kinds = (len(cost) if few else words.count()) + 1
    sizes = [(x or 0.0) + p.smoothing * kinds for x in sums[:2]]
    score = lambda b, g: math.log((b + p.smoothing) / sizes[0]) - math.log((g + p.smoothing) / sizes[1])
    other = score(sums[2] or 0.0, sums[3] or 0.0)
    if few:
        weight = {r["token"]: score(r["b"], r["g"]) for r in counted.collect()}
    else:
        weight = counted.select("token", (F.log((F.col("b") + p.smoothing) / sizes[0]) - F.log((F.col("g") + p.smoothing) / sizes[1])).alias("weight"))
    return Model(total, unknown, p.longest, cost, weight, other, p.prior)


def _scores(urls: DataFrame, model: Model) -> DataFrame:
    """(url, tokens, score) of distinct urls (url, words), by joins."""
    runs = urls.select(F.explode("words").alias("run")).distinct()
    tokens = _split_runs(runs, model.words, model.total, model.unknown, model.longest)
    each = urls.select("url", F.posexplode("words").alias("at", "run")).join(tokens.hint("merge"), "run").select("url", "at", F.posexplode("tokens").alias("k", "token"))
    weighed = each.join(model.weight.hint("merge"), "token", "left").withColumn("weight", F.coalesce("weight", F.lit(model.other)))
    return weighed.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "k", "token"))), lambda r: r["token"]).alias("tokens"), (F.sum("weight") + model.prior).alias("score"))


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """pages with u_host, u_path, u_rule, u_tokens, u_score (log odds of block) and u_verdict.

    A null url, or one without ://, has empty host and path and no tokens, fits
    no rule and is allowed. Repeated rows are judged
    row by row; an empty table gives no rows; columns named u_* are replaced.
    """
    url = F.col("url").cast("string")
    out = pages.withColumns({"u_host": host_of(url), "u_path": path_of(url)})
    name, action = fitting_rule(F.col("u_host"), F.col("u_path"), rules)
    if isinstance(model.words, dict):
        held = pages.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("tokens array<string>, score double")
        def scored(words):
            import pandas as pd

            m = held.value
            cut = _segmenter(m.words, m.unknown, m.longest)
            found = [[_token(t, m.words) for w in ws for t in cut(w) if len(t) > 1] for ws in words]
            return pd.DataFrame({"tokens": found, "score": [m.prior + sum(m.weight.get(t, m.other) for t in ts) for ts in found]})

        out = out.withColumn("u_out", scored(letters(F.col("u_host"), F.col("u_path"))))
    else:
        distinct = pages.select(url.alias("url")).distinct().select("url", letters(host_of(F.col("url")), path_of(F.col("url"))).alias("words"))
        told = _scores(distinct, model).select(F.col("url").alias("u_to"), F.struct("tokens", "score").alias("u_out"))
        out = out.join(told.hint("merge"), url == F.col("u_to"), "left").drop("u_to")
        out = out.withColumn("u_out", F.coalesce("u_out", F.struct(F.array().cast("array<string>").alias("tokens"), F.lit(model.prior).alias("score"))))
    return out.withColumns(
        {
            "u_rule": name,
            "u_tokens": F.col("u_out.tokens"),
            "u_score": F.col("u_out.score"),
            "u_verdict": F.coalesce(action, F.when(F.col("u_out.score") > 0, "block").otherwise("allow")),
        }
    ).drop("u_out")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; edge rows as in judge()."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, fit(pages))
    return out.select("page_id", *[F.col(f"u_{c}").alias(c) for c in ("host", "path", "rule", "verdict")], F.concat_ws(" ", "u_tokens").alias("tokens"))
