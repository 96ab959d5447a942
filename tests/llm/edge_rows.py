"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, extra clashing columns."""

LONG = "word tail " * 40_000
COPY = " ".join(f"copy{i}" for i in range(80))


def rows():
    return [
        (1, COPY, "en", "a", 1), (2, COPY, "en", "a", 1), (2, COPY, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0),
        (None, "no id here at all", "en", "b", 3), (5, LONG, "en", "c", len(LONG)), (6, "é 漢字 \x0b\x0c tab\tnew\nline", "fr", "c", 9), (7, " \n\t ", "en", "c", 4),
        (8, "<|endoftext|> mail a@b.co, +1 (555) 555-0100, 10.1.2.3, 4111 1111 1111 1111", "en", "c", 60),
    ]


def documents(spark, some=None):
    df = spark.createDataFrame(rows() if some is None else some, "doc_id long, text string, lang string, source string, n_chars long")
    # names that clash with what operators use inside
    from pyspark.sql import functions as F

    for c in ("rid", "fp", "block", "raw", "ids", "kind", "component_id", "spans", "root", "slot", "h_host", "quality"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return documents(spark, []).limit(0)
