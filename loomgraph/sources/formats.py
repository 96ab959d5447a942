"""Readers and writers of raw formats. Every reader takes a path that Spark opens, so remote stores work too."""

from __future__ import annotations

import io
import json as json_
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import TemporalGraph, edge_name, union

#: Above these sizes a drawing export is skipped.
MOST_NODES, MOST_EDGES = 20_000, 100_000


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t\t\t") -> DataFrame:
    """Separated text with a given schema; the separator may have several characters."""
    return spark.read.csv(path, schema=schema, sep=sep)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header and doubled quotes, over several lines if quoted; without schema the types are inferred."""
    return spark.read.csv(path, schema=schema, header=True, inferSchema=schema is None, quote='"', escape='"', multiLine=True)


def with_source(df: DataFrame, marks: dict[str, str]) -> DataFrame:
    """A boolean column for each (name, text in the path of the file that a row came from)."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[path.contains(text).alias(name) for name, text in marks.items()])


def json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema)


def keyed_lines(spark: SparkSession, path: str, key: str = r"([^/]+)\.txt$", glob: str = "*.txt") -> DataFrame:
    """(key, value): lines of text files, the key taken from the file's name."""
    t = spark.read.option("pathGlobFilter", glob).text(path)
    return t.select(F.regexp_extract(F.col("_metadata.file_path"), key, 1).alias("key"), "value")


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, message): every file under path as one text."""
    t = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("message"))


def linked_json(spark: SparkSession, path: str) -> DataFrame:
    """(episode, kind, src_name, dst_name, weight) of files of nodes[] and links[] whose ends are places in nodes."""
    d = json(spark, path, "nodes array<struct<name string>>, links array<struct<source long, target long, value double>>")
    name = F.col("_metadata.file_path")
    d = d.select(F.regexp_extract(name, r"episode-(\d+)", 1).cast("int").alias("episode"), F.regexp_extract(name, r"episode-\d+-([a-z]+)", 1).alias("kind"), "nodes", F.explode("links").alias("l"))
    at = lambda c: F.get("nodes", F.col(f"l.{c}").cast("int"))["name"]
    return d.select("episode", "kind", at("source").alias("src_name"), at("target").alias("dst_name"), F.col("l.value").alias("weight"))


def adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines `node neighbour neighbour ...`; lines that start with # are notes."""
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    return t.select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.explode(F.slice(parts, 2, 1 << 30)).alias("d")).select("src", F.col("d").cast("long").alias("dst"))


def labels(spark: SparkSession, path: str, multi: bool = False) -> DataFrame:
    """(node, labels) or (node, label) of `node<tab>label` lines; of several single labels the smallest counts."""
    t = spark.read.csv(path, schema="node long, label long", sep="\t")
    if multi:
        return t.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return t.groupBy("node").agg(F.min("label").alias("label"))


def write_embeddings(df: DataFrame, path: str) -> None:
    """Lines `id<tab>f1 f2 ...` of (id, z)."""
    df.select(F.concat_ws("\t", F.col("id").cast("string"), F.array_join(F.transform("z", lambda x: x.cast("string")), " "))).write.mode("overwrite").text(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, schema="id long, f string", sep="\t")
    return t.select("id", F.transform(F.split("f", " "), lambda x: x.cast("double")).alias("z"))


def matrix_edges(df: DataFrame, name: str, src: str, dst: str) -> dict:
    """A bipartite matrix given as (row, col) cells: its relation and the transposed one."""
    e = df.select(F.col("row").cast("long").alias("src"), F.col("col").cast("long").alias("dst"))
    return {(src, name, dst): e, (dst, f"rev_{name}", src): e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}


def citation_graph(nodes: DataFrame, cites: DataFrame, node: str = "Paper", relation: str = "CITES") -> TemporalGraph:
    """A graph of one type from frames of a citation benchmark: nodes (id and any attributes), cites (src, dst), taken both ways, without loops and repeats."""
    e = cites.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return TemporalGraph({node: nodes}, {(node, relation, node): both})


def write_drawing(graph: TemporalGraph, path: str) -> bool:
    """Nodes and edges as CSV for drawing tools, unless the graph is too large to draw."""
    n, m = sum(c for _, c in graph.counts()), graph.all_edges("src").count()
    if n > MOST_NODES or m > MOST_EDGES:
        return False
    graph.all_nodes("id").write.mode("overwrite").csv(f"{path}/nodes", header=True)
    for kind, e in graph.edges.items():
        e.select("src", "dst").write.mode("overwrite").csv(f"{path}/{edge_name(kind)}", header=True)
    return True


def append_run(df: DataFrame, path: str) -> None:
    """A (metric, value) frame added to a log of runs."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def _npy_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("z", pa.list_(pa.float64()))])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
            x = x.reshape(len(x), -1) if x.ndim else x.reshape(1, 1)
            for a in range(0, len(x), 10_000):
                part = x[a : a + 10_000].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(part.tolist(), schema.types[2])], schema=schema)


def npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """(file, place, z): rows of NumPy files; a file is read by one task, so large results come in several files."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return t.mapInArrow(_npy_rows, "file string, place long, z array<double>")


def external_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(embeddings (id, z), assignments (id, z), means (z, mean)) from embeddings.npy, assignments.npy and means.npy under path; None for what is not there."""
    rows = npy(spark, path)
    name = F.regexp_extract("file", r"([^/]+)\.npy$", 1)
    got = rows.withColumn("name", name)
    there = {r[0] for r in got.select("name").distinct().collect()}  # three names at most
    one = lambda n: got.where(F.col("name") == n) if n in there else None
    e, a, m = one("embeddings"), one("assignments"), one("means")
    if e is None:
        raise ValueError(f"no embeddings.npy under {path}")
    return (
        e.select(F.col("place").alias("id"), "z"),
        a.select(F.col("place").alias("id"), F.col("z")[0].cast("long").alias("z")) if a is not None else None,
        m.select(F.col("place").alias("z"), F.col("z").alias("mean")) if m is not None else None,
    )


def write_npy(spark: SparkSession, path: str, x: np.ndarray) -> None:
    """A small array (centres, a test's vectors) as a NumPy file in any store that Spark writes."""
    held = io.BytesIO()
    np.save(held, x)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(held.getvalue())
    out.close()


def write_graphml(graph: TemporalGraph, path: str) -> bool:
    """The graph as one GraphML text for drawing tools, unless it is too large to draw (the bound makes one sorted task enough)."""
    n, m = sum(c for _, c in graph.counts()), graph.all_edges("src").count()
    if n > MOST_NODES or m > MOST_EDGES:
        return False
    line = lambda df, order, text: df.select(F.lit(order).alias("o"), text.alias("value"))
    spark = next(iter(graph.nodes.values())).sparkSession
    ends = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "o int, value string")
    parts = [line(x, 1, F.format_string(f'<node id="{t}-%d"/>', "id")) for t, x in graph.nodes.items()]
    parts += [line(e, 2, F.format_string(f'<edge source="{s}-%d" target="{d}-%d" label="{r}"/>', "src", "dst")) for (s, r, d), e in graph.edges.items()]
    union([ends, *parts]).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)
    return True


def write_matrix(df: DataFrame, path: str, vector: str = "z") -> None:
    """(id, vector) as CSV with a header id, x_0, x_1 and so on."""
    width = df.select(F.max(F.size(vector))).first()[0] or 0
    df.select("id", *[F.col(vector)[i].alias(f"x_{i}") for i in range(width)]).write.mode("overwrite").csv(path, header=True)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, header=True, inferSchema=True)
    return t.select(F.col("id").cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in t.columns if c != "id"]).alias("z"))


def write_config(spark: SparkSession, path: str, **settings) -> None:
    """Settings as lines `name: value`, which YAML readers take."""
    lines = [(f"{k}: {json_.dumps(v)}",) for k, v in sorted(settings.items())]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)
