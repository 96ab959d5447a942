"""Vector similarities and distances over array columns, in double precision and whole-stage code."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def normalised(v: Column, eps: float = 1e-8) -> Column:
    """v over its length, which counts eps at least."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / length)


def outer(a: Column, b: Column) -> Column:
    """The outer product, row after row."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x.cast("double") * y.cast("double"))))


class Metric(Enum):
    """similarity() grows and distance() falls as vectors come nearer.

    compat=True gives DOTP the Euclidean meaning that the engine this replaces had in effect.
    """

    L1 = "L1"
    L2 = "L2"
    COSINE = "COSINE"
    DOTP = "DOTP"

    def similarity(self, a: Column, b: Column, compat: bool = False) -> Column:
        if self is Metric.L1:
            return -l1(a, b)
        if self is Metric.L2 or compat and self is Metric.DOTP:
            return -l2(a, b)
        return cosine(a, b) if self is Metric.COSINE else dot(a, b)

    def distance(self, a: Column, b: Column, compat: bool = False) -> Column:
        return -self.similarity(a, b, compat)

    @property
    def mllib(self) -> str:
        """The distance measure that Spark's own k-means takes."""
        return "cosine" if self is Metric.COSINE else "euclidean"


class Combine(Enum):
    """How two embeddings of a node become one."""

    ADD = "ADD"
    MULT = "MULT"
    CONCAT = "CONCAT"

    def of(self, a: Column, b: Column) -> Column:
        if self is Combine.CONCAT:
            return F.concat(a, b)
        if self is Combine.ADD:
            return F.zip_with(a, b, lambda x, y: x + y)
        return F.zip_with(a, b, lambda x, y: x * y)
