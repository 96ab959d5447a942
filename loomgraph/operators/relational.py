"""Preprocessing of raw tables into node and edge tables."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import union
from loomgraph.operators.storage import cut


def dense_ids(df: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    """df with ids 0..n-1 in the order of keys, without sorting in one task.

    Rows are range-partitioned by keys and numbered inside each partition; a
    table of one row a partition gives the offsets. The numbered rows are
    written first: a new range sample, or tied keys that change places when a
    block is made again, would not fit offsets taken before.
    """
    placed = cut(_numbered(df, *keys))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n")).collect()  # a row a partition
    offset, offsets = 0, {}
    for r in sorted(sizes):
        offsets[r["__part"]] = offset
        offset += r["__n"]
    pairs = [F.lit(x) for kv in offsets.items() for x in kv]
    base = F.create_map(*pairs)[F.col("__part")] if pairs else F.lit(0)
    return placed.withColumn(name, (F.col("__row") + base).cast("long")).drop("__part", "__row")


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """df in ranges of keys, sorted, with the range (__part) and the row in it (__row)."""
    order = [F.col(k).asc_nulls_last() for k in keys]
    mid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    return mid.withColumns({"__part": F.shiftright("__mid", 33), "__row": F.col("__mid").bitwiseAND((1 << 33) - 1)}).drop("__mid")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """The exact quantiles of a numeric column, interpolated between neighbours; None without values.

    Values are counted (a partial aggregation), ranges of them sorted and
    summed; only the ranges that hold an asked place are looked into, so no
    task holds more than its range and the driver a row a range.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = cut(_numbered(counted, "__v"))
    sizes = sorted(tuple(r) for r in placed.groupBy("__part").agg(F.sum("__n"), F.count("*")).collect())
    total = sum(n for _, n, _ in sizes)
    if not total:
        return None
    wanted: dict[int, set[int]] = {}  # by range, the places in it
    low: dict[int, int] = {}
    at = 0
    places = {int(f(share * (total - 1))) for share in shares for f in (math.floor, math.ceil)}
    for part, n, _ in sizes:
        low[part] = at
        wanted[part] = {x for x in places if at <= x < at + n}
        at += n
    found: dict[int, float] = {}
    for part, some in wanted.items():
        if some:
            upto = F.sum("__n").over(Window.orderBy("__row"))
            rows = placed.where(F.col("__part") == part).withColumn("__upto", upto + low[part])
            hit = F.array(*[F.lit(x) for x in sorted(some)])
            rows = rows.select("__v", F.explode(F.filter(hit, lambda x: (x < F.col("__upto")) & (x >= F.col("__upto") - F.col("__n")))).alias("at"))
            found |= {r["at"]: r["__v"] for r in rows.collect()}  # two places a quantile at most
    out = []
    for share in shares:
        x = share * (total - 1)
        a, b = found[math.floor(x)], found[math.ceil(x)]
        out.append(a + (b - a) * (x - math.floor(x)))
    return out


def renumber(edges: DataFrame, column: str, nodes: DataFrame, key: str, id_: str = "id") -> DataFrame:
    """edges with column replaced by the id of the node whose key it holds; edges without such a node go."""
    ids = nodes.select(F.col(key).alias("__key"), F.col(id_).alias("__id"))
    return edges.join(ids, F.col(column) == F.col("__key")).withColumn(column, F.col("__id")).drop("__key", "__id")


def existing_ends(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes; the ids of a type are distinct, so semi joins say it."""
    s, d = src_nodes.select(F.col("id").alias("src")), dst_nodes.select(F.col("id").alias("dst"))
    return edges.join(s, "src", "left_semi").join(d, "dst", "left_semi")


def frequent(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Rows whose key occurs more than so often."""
    often = df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > more_than).select(key)
    return df.join(often, key, "left_semi")


def top_values(df: DataFrame, column: str, k: int) -> list:
    """The k commonest values, ties in value order: a list of k at most."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), column).limit(k).collect()
    return [r[0] for r in rows]


def one_hot(df: DataFrame, column: str, values: list, prefix: str = "feat_") -> DataFrame:
    from loomgraph.functions.text import safe_col

    return df.withColumns({safe_col(f"{prefix}{v}"): F.coalesce(F.col(column) == F.lit(v), F.lit(False)) for v in values})


def multi_hot(df: DataFrame, column: str, values: list, prefix: str = "feat_") -> DataFrame:
    from loomgraph.functions.text import safe_col

    return df.withColumns({safe_col(f"{prefix}{v}"): F.coalesce(F.array_contains(column, v), F.lit(False)) for v in values})


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def rare_labels(df: DataFrame, key: str, labels: str, tolerance: float = 0.05, least_categories: int = 10, most: int | None = None, rare: str = "Rare") -> DataFrame:
    """(key, labels) with rare labels replaced by one: a label stays if its share of all label occurrences reaches tolerance.

    With least_categories labels or fewer all stay; `most` keeps that many of the commonest.
    """
    flat = df.select(key, F.explode(labels).alias("label"))
    counts = flat.groupBy("label").agg(F.count("*").alias("n"))
    stats = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).first()
    keep = counts if (stats["kinds"] or 0) <= least_categories else counts.where(F.col("n") >= tolerance * (stats["total"] or 0))
    if most is not None:
        keep = keep.orderBy(F.desc("n"), "label").limit(most)
    named = flat.join(keep.select("label", F.lit(True).alias("kept")), "label", "left")
    named = named.withColumn("label", F.when(F.col("kept"), F.col("label")).otherwise(rare))
    return named.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias(labels))


def melt(df: DataFrame, ids: list[str], values: list[str], names_to: str = "metric", values_to: str = "value") -> DataFrame:
    return df.unpivot(ids, values, names_to, values_to)


def _grams(c: Column, size: int = 3) -> Column:
    """The different stretches of `size` characters of c in lower case."""
    low = F.lower(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (size - 1), F.lit(1))), lambda k: F.substring(low, k, F.lit(size))))


def containing(left: DataFrame, right: DataFrame, left_name: str, right_name: str, size: int = 3) -> DataFrame:
    """Distinct pairs of names of which one contains the other, in lower case.

    What lies in a name shares the name's grams: the shorter side asks with its
    first gram, so the join is on grams and only pairs that share one are
    compared. Names shorter than a gram ask with all of themselves and are met
    by the grams of their own length. An empty name is contained in none.
    """

    def half(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
        asked = short.where(F.length(s) > 0).withColumn("__g", F.substring(F.lower(F.col(s)), 1, size))
        held = union(long.withColumn("__g", F.explode(_grams(F.col(t), k))) for k in range(1, size + 1)).distinct()
        return asked.join(held, "__g").where(F.lower(F.col(t)).contains(F.lower(F.col(s)))).select(left_name, right_name)

    return half(left, left_name, right, right_name).unionByName(half(right, right_name, left, left_name)).distinct()


def _best_in_blocks(left_name: str, right_name: str):
    from loomgraph.functions.text import jaro_winkler_one

    schema = pa.schema([(left_name, pa.string()), (right_name, pa.string()), ("score", pa.float64())])

    def run(names: pa.Table, titles: pa.Table) -> pa.Table:
        rows = []
        right = sorted(titles.column(right_name).to_pylist())
        for a in names.column(left_name).to_pylist() if right else ():
            score, b = max(((jaro_winkler_one(a, b), b) for b in right), key=lambda x: x[0])  # the first of equal ones
            rows.append((a, b, score))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), schema.types)], schema=schema)

    return run


def fuzzy_match(left: DataFrame, right: DataFrame, left_name: str, right_name: str, block: int = 2000) -> DataFrame:
    """Each left name's best right name by Jaro-Winkler: among those that contain it or lie in it, else among all.

    Both sides are vocabularies of titles; null names take no part. Names
    without any containing one are a query set against all of the right side:
    blocks of either side meet, and a block gives one row a name.
    """
    from loomgraph.functions.text import jaro_winkler

    names, titles = (df.select(c).where(F.col(c).isNotNull()).distinct() for df, c in ((left, left_name), (right, right_name)))
    near = containing(names, titles, left_name, right_name)
    scored = near.withColumn("score", jaro_winkler(F.col(left_name), F.col(right_name)))
    rest = cut(names.join(near.select(left_name).distinct(), left_name, "left_anti"))
    rows, cols = (max(1, -(-df.count() // block)) for df in (rest, titles))
    a = rest.withColumns({"__a": F.pmod(F.xxhash64(left_name), F.lit(rows)).cast("int"), "__b": F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))})
    b = titles.withColumns({"__b": F.pmod(F.xxhash64(right_name), F.lit(cols)).cast("int"), "__a": F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))})
    other = a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInArrow(_best_in_blocks(left_name, right_name), f"{left_name} string, {right_name} string, score double")
    return first_by(scored.unionByName(other), [left_name], F.desc("score"), F.asc(right_name))
