"""Queries over raw tables: joins, aggregates, arrays, text, ids, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import text as TX
from loomgraph.functions.hashing import md5_number
from loomgraph.operators import relational as R
from loomgraph.plans.registry import H, query
from loomgraph.sources.fixture import load


@query("SELECT c_name, c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS id FROM customer")
def dense_ids_customers(spark, sf_dir):
    """Dense ids in key order, numbered in every partition at once."""
    return R.dense_ids(load(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", "c_custkey")


@query("SELECT p_brand, min(p_partkey) AS first, row_number() OVER (ORDER BY p_brand) - 1 AS id FROM part GROUP BY 1")
def dense_ids_after_dedupe(spark, sf_dir):
    """Ids of deduplicated keys, the kept row chosen by key."""
    p = load(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("first"))
    return R.dense_ids(R.first_by(p, ["p_brand"], F.asc("first")), "p_brand")


@query("SELECT l_orderkey, l_partkey, dense_rank() OVER (ORDER BY l_partkey) - 1 AS local FROM lineitem")
def local_renumbering(spark, sf_dir):
    """Unique values with the inverse index of every row."""
    batch = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    ids = R.dense_ids(batch.select("l_partkey").distinct(), "l_partkey", name="local")
    return batch.join(ids, "l_partkey").select("l_orderkey", "l_partkey", "local")


@query(
    "SELECT o_orderkey AS src, s.id AS dst, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_name) - 1 AS id FROM supplier) s ON l_suppkey = s_suppkey GROUP BY 1, 2"
)
def renumber_edges(spark, sf_dir):
    """Both ends replaced by surrogate ids."""
    s = R.dense_ids(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("id"))
    e = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return R.renumber(R.renumber(e, "src", o, "key"), "dst", s, "s_suppkey").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_name AS src_name, n_name AS dst_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def name_lookup_chain(spark, sf_dir):
    """J2."""
    c, n, r = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    out = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).where("r_name <> 'ASIA'")
    return out.select(F.col("c_name").alias("src_name"), F.col("n_name").alias("dst_name")).distinct()


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def referential_filter(spark, sf_dir):
    """Edges both of whose ends exist, by semi joins."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    p = load(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    e = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    return R.existing_ends(e, o, p).select("src", "dst", "l_linenumber")


@query("SELECT c_custkey AS id, coalesce(n, 0) AS n, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_feature_attach(spark, sf_dir):
    """J4."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return c.join(o, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT a.n_name AS src, b.n_name AS dst FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
def self_join_names(spark, sf_dir):
    """J5."""
    n = load(spark, sf_dir, "nation")
    s, t = n.alias("s"), n.alias("t")
    return s.join(t, F.col("t.n_nationkey") == F.col("s.n_nationkey") + 1, "left").select(F.col("s.n_name").alias("src"), F.col("t.n_name").alias("dst"))


@query("SELECT p_brand, p_type, p_partkey FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 HAVING count(*) > (SELECT count(*) / 6 FROM part))")
def having_frequent_parts(spark, sf_dir):
    """J6, A2."""
    p = load(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey")
    return R.frequent(p, "p_type", p.count() // 6)  # whole counts exceed a sixth where they exceed its floor


@query("SELECT c_custkey AS src, l_suppkey AS dst, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def edge_path_join(spark, sf_dir):
    """J7."""
    o, c, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer"), load(spark, sf_dir, "lineitem")
    j = o.join(c, o.o_custkey == c.c_custkey).join(li, li.l_orderkey == o.o_orderkey, "left")
    return j.groupBy(F.col("c_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT DISTINCT p_type AS left_name FROM part), b AS (SELECT DISTINCT p_name AS right_name FROM part),
    s AS (SELECT left_name, right_name FROM a JOIN b ON contains(lower(right_name), lower(left_name)) OR contains(lower(left_name), lower(right_name))),
    r AS (SELECT left_name, right_name FROM a, b WHERE left_name NOT IN (SELECT left_name FROM s)), c AS (SELECT * FROM s UNION ALL SELECT * FROM r),
    j AS (SELECT *, jaro_winkler_similarity(left_name, right_name) AS score FROM c)
    SELECT left_name, right_name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_name ORDER BY score DESC, right_name) AS rn FROM j) WHERE rn = 1"""
)
def fuzzy_match(spark, sf_dir):
    """Part types against part names."""
    p = load(spark, sf_dir, "part")
    out = R.fuzzy_match(p.select(F.col("p_type").alias("left_name")), p.select(F.col("p_name").alias("right_name")), "left_name", "right_name")
    return out.select("left_name", "right_name", F.round("score", 6).alias("score"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type")
def value_histogram(spark, sf_dir):
    """A1, I4."""
    return load(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand", "p_type")


@query(
    "SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ',') AS words, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types FROM part GROUP BY 1"
)
def keyword_sets(spark, sf_dir):
    """A3, A4: arrays collected, flattened and made distinct."""
    g = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(F.split("p_name", " ")).alias("w"), F.collect_set("p_type").alias("t"))
    return g.select("p_brand", F.array_join(F.array_sort(F.array_distinct(F.flatten("w"))), ",").alias("words"), F.array_join(F.array_sort("t"), ",").alias("types"))


@query("SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM orders")
def global_statistics(spark, sf_dir):
    """A7."""
    v = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("sd"))


@query("SELECT k AS z, coalesce(n, 0) AS n, round(coalesce(s, 0), 2) AS s FROM range(12) r(k) LEFT JOIN (SELECT c_nationkey % 12 AS z, count(*) AS n, sum(c_acctbal) AS s FROM customer WHERE c_nationkey % 12 <> 5 GROUP BY 1) ON z = k")
def scatter_sums(spark, sf_dir):
    """A10: sums and sizes of every cluster, empty ones too."""
    c = load(spark, sf_dir, "customer").withColumn("z", (F.col("c_nationkey") % 12).cast("long")).where("z <> 5").groupBy("z").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"))
    k = spark.range(12).select(F.col("id").alias("z"))
    return k.join(c, "z", "left").select("z", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("s"))


@query(
    """WITH l AS (SELECT p_brand AS key, unnest(string_split(p_name, ' ')) AS label FROM part), c AS (SELECT label, count(*) AS n FROM l GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
    k AS (SELECT label FROM c, t WHERE n >= 0.06 * total OR (SELECT count(*) FROM c) <= 10)
    SELECT key, array_to_string(list_sort(list(DISTINCT CASE WHEN label IN (SELECT label FROM k) THEN label ELSE 'Rare' END)), ',') AS labels FROM l GROUP BY 1"""
)
def rare_label_encode(spark, sf_dir):
    """A17, F13, U2."""
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.split("p_name", " ").alias("labels"))
    return R.rare_labels(p, "key", "labels", 0.06).select("key", F.array_join("labels", ",").alias("labels"))


@query(
    """WITH g AS (SELECT o_orderpriority AS model, o_orderstatus AS dataset, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1, 2),
    m AS (SELECT model, dataset, 'mean' AS metric, mean AS value FROM g UNION ALL SELECT model, dataset, 'sd', sd FROM g)
    SELECT model, metric, round(max(value) FILTER (dataset = 'F'), 3) AS "F", round(max(value) FILTER (dataset = 'O'), 3) AS "O", round(max(value) FILTER (dataset = 'P'), 3) AS "P" FROM m GROUP BY 1, 2"""
)
def melt_pivot_results(spark, sf_dir):
    """Mean and deviation per group, melted and pivoted."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("dataset"))
    m = R.melt(o.agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd")), ["model", "dataset"], ["mean", "sd"])
    return m.groupBy("model", "metric").pivot("dataset", ["F", "O", "P"]).agg(F.round(F.max("value"), 3))


@query("SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type, round(arg_max(value, event_id), 6) AS last_value FROM events GROUP BY 1")
def group_last_value(spark, sf_dir):
    """A19."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("last_type"), F.round(F.max_by("value", "event_id"), 6).alias("last_value")
    )


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 5")
def topk_keywords(spark, sf_dir):
    """The commonest words, ties in order (a top-k report)."""
    w = load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(5)


@query("SELECT p_partkey, contains(' ' || p_name || ' ', ' ring ') AS feat_ring, contains(' ' || p_name || ' ', ' gear ') AS feat_gear, p_type = 'STANDARD' AS feat_STANDARD FROM part")
def multi_hot_features(spark, sf_dir):
    """P7, P8."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type", F.split("p_name", " ").alias("words"))
    return R.one_hot(R.multi_hot(p, "words", ["ring", "gear"]), "p_type", ["STANDARD"]).drop("p_type", "words")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'Other' END AS segment, CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal < 0 THEN -1 ELSE 0 END AS vote FROM customer WHERE c_name LIKE '%1%' AND c_acctbal IS NOT NULL")
def predicates_and_mapping(spark, sf_dir):
    """P2-P5, P9, X2."""
    c = load(spark, sf_dir, "customer").where("c_name LIKE '%1%'").where(F.col("c_acctbal").isNotNull())
    known = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    vote = F.when(F.col("c_acctbal") > 5000, 1).when(F.col("c_acctbal") < 0, -1).otherwise(0)
    return c.select("c_custkey", F.when(known, F.col("c_mktsegment")).otherwise("Other").alias("segment"), vote.alias("vote"))


@query(
    "SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS num FROM pages WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(url, 'utm_source=') AND (regexp_matches(url, '/(en|de)/') OR regexp_matches(url, '[.]html$'))"
)
def regex_cascade(spark, sf_dir):
    """P6, F2."""
    p = load(spark, sf_dir, "pages")
    u = F.col("url")
    p = p.where(u.rlike("^https?://") & ~u.rlike("utm_source=") & (u.rlike("/(en|de)/") | u.rlike("[.]html$")))
    return p.select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("num"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    """F6, P10."""
    e = load(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS name, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem)")
def unpivot_votes(spark, sf_dir):
    """F8: a wide matrix as rows."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return R.melt(li, ["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "name", "value")


@query("SELECT DISTINCT id FROM (SELECT l_orderkey AS id FROM lineitem UNION ALL SELECT l_partkey FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem)")
def id_pool_union(spark, sf_dir):
    """U1."""
    li = load(spark, sf_dir, "lineitem")
    pick = lambda c: li.select(F.col(c).alias("id"))
    return pick("l_orderkey").union(pick("l_partkey")).union(pick("l_suppkey")).distinct()


@query(
    "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w IN ('ring', 'gear', 'bolt')), ',') AS found FROM part"
)
def vocabulary_intersection(spark, sf_dir):
    """U2, X5."""
    vocabulary = F.array(*map(F.lit, ("ring", "gear", "bolt")))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_intersect(F.split("p_name", " "), vocabulary), ",").alias("found"))


@query(
    "SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS ident, array_to_string(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z\\s]', '', 'g'), ' '), lambda w: len(w) >= 4), ' ') AS words FROM part"
)
def text_normalise(spark, sf_dir):
    """F1, F3, F4, X4, X6."""
    return load(spark, sf_dir, "part").select("p_partkey", TX.identifier(F.col("p_type")).alias("ident"), F.array_join(TX.words(F.col("p_name"), 4), " ").alias("words"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+')) AS word FROM documents WHERE lang = 'en') WHERE len(word) >= 3 AND word NOT IN ('the', 'and', 'for') GROUP BY 1")
def token_counts(spark, sf_dir):
    """words of all English documents, counted."""
    d = load(spark, sf_dir, "documents").where("lang = 'en'")
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z\s]", ""), r"\s+"), lambda x: (F.length(x) >= 3) & ~x.isin("the", "and", "for"))
    return d.select(F.explode(w).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS parts, row_number() OVER (ORDER BY " + H.format("CAST(l_orderkey AS VARCHAR)") + ", l_orderkey) % 7 AS r FROM lineitem WHERE l_orderkey < 0 GROUP BY 1")
def empty_input(spark, sf_dir):
    """An aggregate over no rows keeps its columns."""
    li = load(spark, sf_dir, "lineitem").where("l_orderkey < 0").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("parts"))
    return li.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(md5_number("l_orderkey"), "l_orderkey")).cast("long") % 7)


@query("SELECT " + H.format("CAST(o_orderkey AS VARCHAR)") + " % 97 AS bucket, count(*) AS n FROM orders GROUP BY 1")
def hash_buckets(spark, sf_dir):
    """W16."""
    return load(spark, sf_dir, "orders").groupBy(F.pmod(md5_number("o_orderkey"), F.lit(97)).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size // 10 AS bucket, p_size % 2 = 0 AS mask, dense_rank() OVER (ORDER BY p_brand) - 1 AS part FROM part")
def masks_and_partitions(spark, sf_dir):
    """A mask, a value bucket and a numbered partition of each row."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    ids = R.dense_ids(p.select("p_brand").distinct(), "p_brand", name="part")
    return p.join(ids, "p_brand").select("p_partkey", F.expr("cast(p_size div 10 as int)").alias("bucket"), (F.col("p_size") % 2 == 0).alias("mask"), "part")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2")
def keep_white_columns(spark, sf_dir):
    """Only the columns of a white list."""
    from loomgraph.operators.transforms import keep_columns

    n = load(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r").where("r <> 2")
    return keep_columns(n, ["n_nationkey", "n_name", "absent"])


@query("SELECT c_custkey, CAST(trim(x) AS VARCHAR) AS item FROM (SELECT c_custkey, unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS x FROM customer)")
def parse_literal_lists(spark, sf_dir):
    """List literals in text, parsed and never evaluated."""
    c = load(spark, sf_dir, "customer")
    raw = F.concat(F.lit("['"), "c_mktsegment", F.lit("', "), F.col("c_nationkey").cast("string"), F.lit("]"))
    return c.select("c_custkey", F.explode(TX.parse_list(raw)).alias("item"))


_STEM = " ".join(
    f"WHEN ends_with(w, '{end}') AND length(w) - {len(end)} >= {least}{chr(32) + 'AND NOT ends_with(w, ' + chr(39) + 'ss' + chr(39) + ')' if end == 's' else ''} THEN left(w, length(w) - {len(end)}){' || ' + chr(39) + 'y' + chr(39) if end == 'ies' else ''}"
    for end, least in TX._ENDINGS
)


@query(f"WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT CASE {_STEM} ELSE w END AS stem, count(*) AS n FROM w GROUP BY 1")
def stemmed_words(spark, sf_dir):
    """Stems of part names."""
    p = load(spark, sf_dir, "part").select(F.explode(TX.stem(F.split("p_name", " "))).alias("stem"))
    return p.groupBy("stem").agg(F.count("*").alias("n"))
