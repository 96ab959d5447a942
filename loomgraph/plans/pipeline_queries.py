"""End-to-end queries: the preprocessing pipeline, embeddings of text and nodes, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as TX
from loomgraph.functions.vectors import Combine
from loomgraph.operators import clustering as C
from loomgraph.operators import embeddings as E
from loomgraph.operators import sampling as S
from loomgraph.operators.communities import label_propagation
from loomgraph.operators.relational import dense_ids
from loomgraph.operators.storage import cut
from loomgraph.plans import pipeline as P
from loomgraph.plans.registry import EDGES_SQL, USERS_SQL, query
from loomgraph.sources.fixture import canonical, interactions, load

_NORM = f"""{EDGES_SQL}, t AS (SELECT ts FROM nodes UNION ALL SELECT ts FROM edges UNION ALL SELECT ts FROM edges), q AS (SELECT CAST(trunc(quantile_cont(ts, 0.025)) AS BIGINT) AS lo, CAST(trunc(quantile_cont(ts, 0.975)) AS BIGINT) AS hi FROM t WHERE ts <> -1)"""


@query(
    f"""WITH {_NORM}, e AS (SELECT rel, CASE WHEN ts = -1 THEN -1 ELSE least(greatest(ts, lo), hi) - lo END AS ts FROM edges, q)
    SELECT rel, count(*) AS n, CAST(sum(ts) AS BIGINT) AS s FROM (SELECT * FROM e UNION ALL SELECT 'rev_' || rel, ts FROM e) GROUP BY 1"""
)
def preprocess_pipeline(spark, sf_dir):
    """Splits, reverse relations and normalised times in their order."""
    g = P.prepare(canonical(spark, sf_dir)).graph
    return g.all_edges("timestamp_from").groupBy("rel").agg(F.count("*").alias("n"), F.sum("timestamp_from").alias("s"))


_EVEN = "CASE WHEN ts = -1 THEN -1 ELSE least(greatest(ts, lo), hi) - lo END AS ts"


@query(
    f"""WITH {_NORM}, ne AS (SELECT src, dst, {_EVEN} FROM gedges, q), nn AS (SELECT type, gid, {_EVEN} FROM gnodes, q), b AS (SELECT min(ts) AS lo, max(ts) + 1 AS hi FROM (SELECT ts FROM nn UNION ALL SELECT ts FROM ne) WHERE ts <> -1),
    snaps AS (SELECT CAST(floor(lo + i * ((hi - lo) / 5.0)) AS BIGINT) AS s FROM b, range(5) r(i)), tt AS (SELECT src AS node, ts FROM ne UNION ALL SELECT dst, ts FROM ne UNION ALL SELECT gid, ts FROM nn),
    f AS (SELECT gid, type, coalesce(min(x.ts), -1) AS ts FROM nn LEFT JOIN (SELECT * FROM tt WHERE ts <> -1) x ON x.node = gid GROUP BY 1, 2),
    l AS (SELECT type, 1 + CAST(-1 < f.ts AS INT) + (SELECT count(*) FROM snaps WHERE s < f.ts) AS label FROM f)
    SELECT type, CAST(label AS BIGINT) AS label, count(*) AS n FROM l GROUP BY 1, 2"""
)
def pipeline_snapshot_labels(spark, sf_dir):
    """G13, G14 after G17."""
    return P.snapshot_labels(P.prepare(canonical(spark, sf_dir))).groupBy("type", "label").agg(F.count("*").alias("n"))


def _users(spark, sf_dir):
    e = interactions(spark, sf_dir)
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct(), e


@query()
def community_detection_eval(spark, sf_dir):
    """Topological and temporal embeddings combined, clustered, and all measures of the result."""
    n, e = _users(spark, sf_dir)
    topo = E.word2vec(S.walk(n, e, 8, 2), 8)
    seeds = e.groupBy(F.col("src").alias("node")).agg(F.min("timestamp_from").alias("ts")).withColumn("walk_id", F.col("node"))
    tempo = E.word2vec(S.temporal_walk(seeds, e, 6, 86400).select("walk_id", "walk"), 8)
    both = cut(topo.join(tempo.select("id", F.col("z").alias("t")), "id").select("id", Combine.CONCAT.of(F.col("z"), F.col("t")).alias("z")))
    model = C.fit_dpmm(both, "z", C.Params(clusters=3, rounds=8))
    z = C.assign(both.withColumnRenamed("z", "v"), model, "v").select("id", F.col("z").cast("long").alias("z"))
    found = cut(label_propagation(n, e, 3))
    names = dense_ids(found.select("label").distinct(), "label", name="k")
    labels = found.join(names, "label").select("id", F.col("k").alias("label"))
    return P.evaluate(e, both, z, labels)


@query()
def text_embedding(spark, sf_dir):
    """Sentence vectors by hashed words and inverse document frequency."""
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    d = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", TX.words(F.col("text"), 3).alias("words"))
    tf = HashingTF(numFeatures=64, inputCol="words", outputCol="tf").transform(d)
    return IDF(inputCol="tf", outputCol="v").fit(tf).transform(tf).select("doc_id", F.round(F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, x: a + x), 3).alias("mass"))


@query(f"WITH {USERS_SQL} SELECT src AS id, count(*) AS n FROM ue GROUP BY 1")
def combine_outputs(spark, sf_dir):
    """The mean of two outputs of each node (its number of edges twice)."""
    _, e = _users(spark, sf_dir)
    z = e.groupBy(F.col("src").alias("id")).agg(F.array(F.count("*").cast("double")).alias("z"))
    return P.combine_outputs(z, z).select("id", F.col("z")[0].cast("long").alias("n"))


@query("SELECT n_nationkey, 'user' || n_nationkey || '@enron.com' AS sender, 'r' || n_regionkey || '@x.com' AS receiver, n_name AS subject, 'Hello ' || n_name AS content, n_nationkey % 2 = 0 AS if_forwarded FROM nation")
def mail_headers(spark, sf_dir):
    """Headers, body and forwarded part of mail texts."""
    n = load(spark, sf_dir, "nation")
    tail = F.when(F.col("n_nationkey") % 2 == 0, F.lit("\n\n----- Forwarded by X\nold text")).otherwise(F.lit(""))
    m = F.concat(F.lit("Message-ID: <1>\nFrom: user"), F.col("n_nationkey").cast("string"), F.lit("@enron.com\nTo: r"), F.col("n_regionkey").cast("string"), F.lit("@x.com\nSubject: "), F.col("n_name"), F.lit("\nX-Folder: inbox\n\nHello "), F.col("n_name"), tail)
    c = TX.mail_columns(m)
    out = n.select("n_nationkey", c["from"].alias("sender"), c["to"].alias("receiver"), c["subject"].alias("subject"), c["content"].alias("content"), c["if_forwarded"].alias("if_forwarded"))
    return out.where("sender like '%enron%'")


@query("SELECT p_partkey, p_brand || ' ' || p_type AS plain, CAST(p_size AS VARCHAR) AS size FROM part")
def wiki_clean(spark, sf_dir):
    """markup removed and a template's arguments read."""
    p = load(spark, sf_dir, "part")
    raw = F.concat(F.lit("{{Infobox part | size = "), F.col("p_size").cast("string"), F.lit(" | kind = x}}[[Brand|"), F.col("p_brand"), F.lit("]] '''"), F.col("p_type"), F.lit("'''<ref>n</ref>"))
    return p.select("p_partkey", TX.strip_wiki(raw).alias("plain"), TX.template_args(raw)["size"].alias("size"))
