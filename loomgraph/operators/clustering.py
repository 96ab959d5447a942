"""Clustering of vectors: k-means with a given start, and Dirichlet-process Gaussian mixtures with splits and merges.

Points stay in Spark; each round sends small parameters out and brings one row of sufficient statistics a cluster back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.special import digamma, lgamma, logsumexp, mvlgamma
from loomgraph.functions.vectors import Metric


def nearest(points: DataFrame, centres: list[list[float]], vector: str = "embedding", metric: Metric = Metric.L2) -> DataFrame:
    """points with z, the nearest of a handful of centres (ties: the first), as one expression."""
    found = F.array_min(F.array(*[F.struct(metric.distance(F.col(vector), F.array(*map(F.lit, c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]))
    return points.withColumn("z", found["k"])


def lloyd(points: DataFrame, centres: list[list[float]], rounds: int, vector: str = "embedding") -> list[list[float]]:
    """Centres after so many rounds from a given start; an empty cluster keeps its centre. A round is one aggregation."""
    centres = [list(map(float, c)) for c in centres]
    for _ in range(rounds):
        z = nearest(points, centres, vector)
        rows = z.select("z", F.posexplode(vector).alias("i", "v")).groupBy("z", "i").agg(F.avg(F.col("v").cast("double")).alias("m")).collect()  # k times d numbers
        for r in rows:
            centres[r["z"]][r["i"]] = r["m"]
    return centres


def kmeans(points: DataFrame, k: int, vector: str = "embedding", metric: Metric = Metric.L2, seed: int = 1, rounds: int = 100) -> DataFrame:
    """points with z by Spark's own k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, featuresCol="__v", predictionCol="z", seed=seed, maxIter=rounds, distanceMeasure=metric.mllib).fit(data)
    return model.transform(data).drop("__v")


def _first_component(points: DataFrame, vector: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(points with __x, their place on the first principal component, as an array of one; the component; the mean)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from loomgraph.operators.metrics import vector_mean

    data = points.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=1, inputCol="__v", outputCol="__p").fit(data)
    mean = np.array(points.agg(vector_mean(F.col(vector)).alias("m")).first()[0], float)
    axis = np.array(model.pc.toArray(), float)[:, 0]
    shift = float(mean @ axis)  # Spark projects without centring
    one = model.transform(data).withColumn("__x", F.transform(vector_to_array("__p"), lambda x: x - shift)).drop("__v", "__p")
    return one, axis, mean


def kmeans_1d(points: DataFrame, k: int, vector: str = "embedding", seed: int = 1) -> DataFrame:
    """points with z by k-means on their first principal component."""
    one, _, _ = _first_component(points, vector)
    return kmeans(one, k, "__x", seed=seed).drop("__x")


def kmeans_1d_centres(points: DataFrame, k: int, vector: str = "embedding", seed: int = 1) -> list[list[float]]:
    """The centres of k-means on the first principal component, mapped back to the space of the vectors, in their order on it."""
    one, axis, mean = _first_component(points, vector)
    rows = kmeans(one, k, "__x", seed=seed).groupBy("z").agg(F.avg(F.col("__x")[0]).alias("c")).orderBy("c").collect()  # k rows
    return [(mean + r["c"] * axis).tolist() for r in rows]


def initial_assignment(points: DataFrame, k: int, how: str, vector: str = "embedding", key: str = "vec_id", seed: int = 1, z_init: str | None = None) -> DataFrame:
    """points with z, a first cluster for each: random (by md5 of the key), kmeans, kmeans1d, or z_init, the name of a column that holds it."""
    from loomgraph.functions.hashing import bucket

    if how == "random":
        return points.withColumn("z", bucket(k, key, F.lit(seed)).cast("int"))
    if how == "kmeans":
        return kmeans(points, k, vector, seed=seed)
    if how == "kmeans1d":
        return nearest(points, kmeans_1d_centres(points, k, vector, seed), vector)
    if how == "z_init" and z_init:
        return points.withColumn("z", F.col(z_init).cast("int"))
    raise ValueError(f"no initial assignment {how!r}")


def gaussian_mixture(points: DataFrame, k: int, vector: str = "embedding", seed: int = 1) -> DataFrame:
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    out = GaussianMixture(k=k, featuresCol="__v", predictionCol="z", probabilityCol="__r", seed=seed).fit(data).transform(data)
    return out.withColumn("r", vector_to_array("__r")).drop("__v", "__r")


@dataclass
class Stats:
    """Counts, means and covariances of clusters."""

    n: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def of(n, s, ss, reg: float) -> Stats:
        safe = np.maximum(n, 1e-12)[:, None]
        mean = s / safe
        cov = ss / safe[:, :, None] - mean[:, :, None] * mean[:, None, :]
        return Stats(n, mean, cov + reg * np.eye(s.shape[1]))

    @staticmethod
    def merged(parts: list[Stats]) -> Stats:
        """Each parts entry's clusters together as one: moments match."""
        n = np.array([p.n.sum() for p in parts])
        mean = np.array([(p.n[:, None] * p.mean).sum(0) / max(p.n.sum(), 1e-12) for p in parts])
        cov = np.array(
            [sum(w * (c + np.outer(m - mu, m - mu)) for w, m, c in zip(p.n, p.mean, p.cov)) / max(p.n.sum(), 1e-12) for p, mu in zip(parts, mean)]
        )
        return Stats(n, mean, cov)


def pooled(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of batches' (n, sum, sum of outer products)."""
    return tuple(np.sum([p[i] for p in parts], axis=0) for i in range(3))


@dataclass
class DirichletPrior:
    """Stick-breaking weights: a = 1 + N_k, b = alpha + what comes after."""

    alpha: float

    def posterior(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return 1.0 + n, self.alpha + np.append(np.cumsum(n[::-1])[::-1][1:], 0.0)

    def log_weights(self, n: np.ndarray) -> np.ndarray:
        a, b = self.posterior(n)
        both = digamma(a + b)
        return digamma(a) - both + np.append(0.0, np.cumsum(digamma(b) - both)[:-1])


@dataclass
class WishartPrior:
    """Normal-Wishart: mean mu, strength kappa, nu degrees of freedom, scale psi."""

    mu: np.ndarray
    kappa: float
    nu: float
    psi: np.ndarray

    def posterior(self, s: Stats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d = len(self.mu)
        kappa, nu = self.kappa + s.n, self.nu + s.n
        mean = (self.kappa * self.mu + s.n[:, None] * s.mean) / kappa[:, None]
        gap = s.mean - self.mu
        scatter = s.n[:, None, None] * s.cov + (self.kappa * s.n / kappa)[:, None, None] * gap[:, :, None] * gap[:, None, :]
        return kappa, nu, mean, (self.psi + scatter) / (nu + d + 2)[:, None, None]

    def most_likely(self, s: Stats) -> tuple[np.ndarray, np.ndarray]:
        """The means and covariances of highest posterior density of each cluster."""
        _, _, mean, cov = self.posterior(s)
        return mean, cov

    def marginal(self, s: Stats) -> np.ndarray:
        """Log marginal likelihood of each cluster's points."""
        d = len(self.mu)
        kappa, nu, _, cov = self.posterior(s)
        psi = cov * (nu + d + 2)[:, None, None]
        return (
            -s.n * d / 2 * np.log(np.pi) + mvlgamma(nu / 2, d) - mvlgamma(self.nu / 2, d)
            + self.nu / 2 * np.linalg.slogdet(self.psi)[1] - nu / 2 * np.linalg.slogdet(psi)[1] + d / 2 * (np.log(self.kappa) - np.log(kappa))
        )


def lower_bound(prior: WishartPrior, sticks: DirichletPrior, s: Stats, entropy: float = 0.0) -> float:
    """Entropy of the assignments, less the log normalisers of the Wishart and stick posteriors, less half the dimension times the sum of log kappa."""
    d = len(prior.mu)
    kappa, nu, _, cov = prior.posterior(s)
    log_det = np.linalg.slogdet(cov * (nu + d + 2)[:, None, None])[1]
    wishart = -(nu / 2 * -log_det + nu * d / 2 * np.log(2) + mvlgamma(nu / 2, d))
    a, b = sticks.posterior(s.n)
    stick = lgamma(a + b) - lgamma(a) - lgamma(b)
    return float(entropy - wishart.sum() - stick.sum() - 0.5 * d * np.log(kappa).sum())


def log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """[points, clusters] log Gaussian densities through the Cholesky factors of the precisions."""
    out = np.empty((len(x), len(mean)))
    for k, (m, c) in enumerate(zip(mean, cov)):
        half = np.linalg.inv(np.linalg.cholesky(c))
        y = (x - m) @ half.T
        out[:, k] = -0.5 * (y * y).sum(1) - 0.5 * x.shape[1] * np.log(2 * np.pi) + np.log(np.diag(half)).sum()
    return out


@dataclass
class Params:
    clusters: int = 2
    alpha: float = 1.0
    kappa: float = 1.0
    nu_extra: float = 1.0
    reg: float = 1e-6
    rounds: int = 20
    tol: float = 1e-4
    min_split: int = 6
    merge_neighbours: int = 3
    mutate_every: int = 4
    seed: int = 3


@dataclass
class Mixture:
    mean: np.ndarray
    cov: np.ndarray
    log_weight: np.ndarray
    n: np.ndarray
    bound: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return log_density(x, self.mean, self.cov) + self.log_weight


def _moments(model: Mixture, halves: np.ndarray, cuts: np.ndarray):
    """Per-task sufficient statistics of hard clusters, each in two parts: its points on either side of a cut on its main axis."""
    k, d = model.mean.shape
    schema = pa.schema([("c", pa.int32()), ("n", pa.float64()), ("s", pa.list_(pa.float64())), ("ss", pa.list_(pa.float64())), ("ll", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, ll = np.zeros(2 * k), np.zeros((2 * k, d)), np.zeros((2 * k, d, d)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).to_pylist(), float)
            score = model.scores(x)
            ll += float(logsumexp(score, 1).sum())
            z = score.argmax(1)
            side = ((x - model.mean[z]) * halves[z]).sum(1) > cuts[z]
            for c in np.unique(2 * z + side):
                part = x[2 * z + side == c]
                n[c] += len(part)
                s[c] += part.sum(0)
                ss[c] += part.T @ part
        rows = range(2 * k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(n), pa.array([s[c].tolist() for c in rows], schema.types[2]), pa.array([ss[c].ravel().tolist() for c in rows], schema.types[3]), pa.array([ll] + [0.0] * (2 * k - 1))],
            schema=schema,
        )

    return run


def _gather(points: DataFrame, vector: str, model: Mixture, halves: np.ndarray, cuts: np.ndarray):
    k, d = model.mean.shape
    got = points.select(F.col(vector).cast("array<double>")).mapInArrow(_moments(model, halves, cuts), "c int, n double, s array<double>, ss array<double>, ll double")
    one = got.select("c", "n", "ll", F.posexplode(F.concat("s", "ss")).alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("ll").alias("ll")).collect()  # 2k (d + d * d) numbers
    n, flat, ll = np.zeros(2 * k), np.zeros((2 * k, d + d * d)), 0.0
    for r in one:
        flat[r["c"], r["i"]] = r["v"]
        n[r["c"]] = r["n"]
        ll = ll + r["ll"] if r["i"] == 0 else ll
    return n, flat[:, :d], flat[:, d:].reshape(2 * k, d, d), ll


def accepts(log_ratio: float, rng: np.random.Generator) -> bool:
    return log_ratio > 0 or np.exp(log_ratio) > rng.random()


def fit_dpmm(points: DataFrame, vector: str = "embedding", p: Params = Params(), mutate: bool = True, start_from: DataFrame | None = None, on_round=None) -> Mixture:
    """A Dirichlet-process mixture by hard expectation maximisation with Metropolis-Hastings splits and merges in turn.

    A split divides a cluster into its two parts on the main axis of its covariance (two-means on it, refined every round); a merge joins near clusters.
    start_from: points with z (initial_assignment) whose clusters are the start, else means along the main axis are.
    on_round is called with (round, model, bound) after every round.
    """
    rng = np.random.default_rng(p.seed)
    d, total = points.agg(F.max(F.size(vector)), F.count("*")).first()
    start = Mixture(np.zeros((1, d)), np.eye(d)[None], np.zeros(1), np.ones(1))
    n, s, ss, _ = _gather(points, vector, start, np.ones((1, d)), np.zeros(1))
    whole = Stats.of(np.array([n.sum()]), s.sum(0)[None], ss.sum(0)[None], p.reg)
    prior = WishartPrior(whole.mean[0], p.kappa, d + p.nu_extra, np.diag(np.sqrt(np.diag(whole.cov[0]))))
    sticks = DirichletPrior(p.alpha)
    axis = np.linalg.eigh(whole.cov[0])[1][:, -1] * np.sqrt(np.linalg.eigvalsh(whole.cov[0])[-1])
    at = np.linspace(-1, 1, p.clusters) if p.clusters > 1 else np.zeros(1)
    model = Mixture(whole.mean + at[:, None] * axis, np.repeat(whole.cov, p.clusters, 0), np.full(p.clusters, -np.log(p.clusters)), np.full(p.clusters, total / p.clusters))
    if start_from is not None:
        model = _started(start_from, vector, prior, sticks, p)
    kind, middles = 0, None
    for step in range(p.rounds):
        halves = np.linalg.eigh(model.cov)[1][:, :, -1]
        # two-means on the main axis, a round of it with every round of the mixture: the cut is half way between the parts' means
        cuts = np.zeros(len(model.n)) if middles is None else ((middles - model.mean) * halves).sum(1)
        n, s, ss, ll = _gather(points, vector, model, halves, cuts)
        model.bound.append(ll / max(total, 1))
        if on_round:
            on_round(step, model, model.bound[-1])
        sub = Stats.of(n, s, ss, p.reg)
        k = len(model.n)
        full = Stats.of(n.reshape(k, 2).sum(1), s.reshape(k, 2, d).sum(1), ss.reshape(k, 2, d, d).sum(1), p.reg)
        groups = [np.array([2 * c, 2 * c + 1]) for c in range(k) if full.n[c] > 1] or [np.arange(2 * k)]
        parts_ = sub.mean.reshape(k, 2, d)
        middles = np.where((sub.n.reshape(k, 2).min(1) > 0)[:, None], parts_.mean(1), full.mean)
        settled = len(model.bound) > 1 and abs(model.bound[-1] - model.bound[-2]) < p.tol
        if mutate and (settled or step % p.mutate_every == p.mutate_every - 1) and step < p.rounds - 2:
            groups = _split(groups, sub, prior, p, rng) if kind % 2 == 0 else _merge(groups, sub, prior, p, rng)
            kind += 1
            middles = None
        elif settled and not mutate:
            break
        pick = lambda idx: Stats(sub.n[idx], sub.mean[idx], sub.cov[idx])
        now = Stats.merged([pick(g) for g in groups])
        order = np.argsort(-now.n, kind="stable")
        now = Stats(now.n[order], now.mean[order], now.cov[order])
        if middles is not None:
            alive = np.flatnonzero(full.n > 1)
            middles = middles[alive][order] if len(alive) == len(order) else None
        _, _, mean, cov = prior.posterior(now)
        model = Mixture(mean, cov + p.reg * np.eye(d), sticks.log_weights(now.n), now.n, model.bound)
    return model


def _started(points: DataFrame, vector: str, prior: WishartPrior, sticks: DirichletPrior, p: Params) -> Mixture:
    """The model of given clusters (z), largest first."""
    from loomgraph.operators.metrics import vector_mean

    v = F.col(vector).cast("array<double>")
    outer = F.flatten(F.transform(v, lambda x: F.transform(v, lambda y: x * y)))
    rows = points.groupBy("z").agg(F.count("*").alias("n"), vector_mean(v).alias("m"), vector_mean(outer).alias("q")).orderBy(F.desc("n"), "z").collect()  # k (d + d * d) numbers
    d = len(prior.mu)
    n = np.array([float(r["n"]) for r in rows])
    mean, second = np.array([r["m"] for r in rows], float), np.array([r["q"] for r in rows], float).reshape(-1, d, d)
    now = Stats.of(n, mean * n[:, None], second * n[:, None, None], p.reg)
    _, _, mean, cov = prior.posterior(now)
    return Mixture(mean, cov + p.reg * np.eye(d), sticks.log_weights(n), n)


def fit_best(points: DataFrame, vector: str = "embedding", p: Params = Params(), n_init: int = 3, mutate: bool = True) -> Mixture:
    """Of n_init fits with different seeds the one of the highest bound."""
    return max((fit_dpmm(points, vector, replace(p, seed=p.seed + i), mutate) for i in range(n_init)), key=lambda m: m.bound[-1])


def _part(sub: Stats, idx: np.ndarray) -> Stats:
    return Stats.merged([Stats(sub.n[idx], sub.mean[idx], sub.cov[idx])])


def _split(groups, sub: Stats, prior: WishartPrior, p: Params, rng) -> list[np.ndarray]:
    out = []
    for g in groups:
        if len(g) == 2 and (sub.n[g] >= p.min_split).all():
            parts = [_part(sub, g[:1]), _part(sub, g[1:])]
            whole = _part(sub, g)
            ratio = np.log(p.alpha) + sum(lgamma(x.n)[0] + prior.marginal(x)[0] for x in parts) - lgamma(whole.n)[0] - prior.marginal(whole)[0]
            if accepts(ratio, rng):
                out += [g[:1], g[1:]]
                continue
        out.append(g)
    return out


def _merge(groups, sub: Stats, prior: WishartPrior, p: Params, rng) -> list[np.ndarray]:
    full = [_part(sub, g) for g in groups]
    mean = np.array([f.mean[0] for f in full])
    far = ((mean[:, None] - mean[None]) ** 2).sum(-1)
    pairs = sorted((far[i, j], i, int(j)) for i in range(len(groups)) for j in np.argsort(far[i])[1 : p.merge_neighbours + 1] if i != j)
    used: set[int] = set()
    out = []
    for _, i, j in pairs:
        if i in used or j in used:
            continue
        both = np.concatenate([groups[i], groups[j]])
        whole = _part(sub, both)
        ratio = lgamma(whole.n)[0] + prior.marginal(whole)[0] - np.log(p.alpha) - sum(lgamma(full[x].n)[0] + prior.marginal(full[x])[0] for x in (i, j))
        if accepts(ratio, rng):
            out.append(both)
            used |= {i, j}
    return out + [g for i, g in enumerate(groups) if i not in used]


def assign(points: DataFrame, model: Mixture, vector: str = "embedding") -> DataFrame:
    """points with z, the most likely cluster, and r, the responsibilities."""

    @F.pandas_udf("z int, r array<double>")
    def score(v):
        import pandas as pd

        s = model.scores(np.array(v.tolist(), float))
        r = np.exp(s - logsumexp(s, 1)[:, None])
        return pd.DataFrame({"z": s.argmax(1).astype(np.int32), "r": list(r)})

    return points.withColumn("__o", score(F.col(vector).cast("array<double>"))).withColumns({"z": F.col("__o.z"), "r": F.col("__o.r")}).drop("__o")


def synthetic_gmm(spark, n: int, dim: int = 2, k: int = 15, seed: int = 0) -> DataFrame:
    """(id, embedding, label): n points around k means on a grid, each from its own random numbers."""
    side = int(np.ceil(k ** (1 / dim)))
    means_ = F.array(*[F.array(*[F.lit(float((c // side**j) % side) * 4) for j in range(dim)]) for c in range(k)])
    label = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int")
    number = lambda j, s: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j), F.lit(s)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    normal = lambda j: F.sqrt(-2 * F.log(number(j, 1))) * F.cos(2 * np.pi * number(j, 2))
    return spark.range(n).withColumn("label", label).select("id", F.array(*[means_[F.col("label")][j] + 0.5 * normal(j) for j in range(dim)]).alias("embedding"), "label")


def plane(points: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str | None = None) -> DataFrame:
    """(key, x, y, label): points on their first two principal components, as drawing tools take them."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    out = PCA(k=2, inputCol="__v", outputCol="__p").fit(data).transform(data).withColumn("__p", vector_to_array("__p"))
    return out.select(key, F.col("__p")[0].alias("x"), F.col("__p")[1].alias("y"), *([label] if label else []))
