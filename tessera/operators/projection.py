"""Layouts (inventory I1-I7, I9, I11-I13, E10): PCA, t-SNE, UMAP, alignment, refits."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import catalog, columns, vectors
from tessera.plans.ship import ensure
from tessera.schemas import Degenerate, RaggedDimensions, TooFewSamples

INCREMENTAL_SHARE = 0.02
MIN_PCA, MIN_UMAP, MIN_PAIRS = 4, 32, 4
#: Layouts that are fitted on the driver hold at most this many vectors.
MAX_DRIVER = 50_000


class Cancelled(Exception):
    pass


class Projector(Protocol):
    """``id, v`` -> ``id, x, y, z``."""

    name: str

    def fit_transform(self, data: DataFrame) -> DataFrame: ...

    def params_json(self) -> str: ...


def check(data: DataFrame, least: int) -> tuple[int, int]:
    """Number and width of the vectors, or a typed error."""
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if facts["n"] < least:
        raise TooFewSamples(f"{facts['n']} vectors, {least} are needed")
    if facts["lo"] != facts["hi"]:
        raise RaggedDimensions(f"widths from {facts['lo']} to {facts['hi']}")
    return facts["n"], facts["lo"]


def _partials(data: DataFrame, width: int, mean: np.ndarray | None) -> tuple[int, np.ndarray]:
    """Rows and sum of the vectors, or with a mean the sum of centred outer products: one row of
    partial sums a partition, added up by column."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(width if mean is None else width * width)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(np.float64)
                n += len(x)
                total += x.sum(axis=0) if mean is None else ((x - mean).T @ (x - mean)).ravel()
        yield pd.DataFrame({"n": [n] * len(total), "i": np.arange(len(total)), "s": total})

    ensure(data.sparkSession)
    sums = data.select("v").mapInPandas(work, "n long, i int, s double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").toArrow()
    return (sums["n"][0].as_py() if len(sums) else 0), sums["s"].to_numpy()


def covariance(data: DataFrame) -> DataFrame:
    """Upper triangle ``i, j, cov`` (n-1) of ``v``, by a centred second pass (D7): one row of
    partial sums for each partition, whatever the number of vectors."""
    width = data.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    n, total = _partials(data, width, None)
    if n < 2:
        return data.sparkSession.createDataFrame([], "i int, j int, cov double")
    outer = _partials(data, width, total / n)[1].reshape(width, width) / (n - 1)
    return data.sparkSession.createDataFrame([(i, j, float(outer[i, j])) for i in range(width) for j in range(i, width)], "i int, j int, cov double")


def principal_axes(cov: np.ndarray, k: int = 2) -> np.ndarray:
    """Largest axes first; one with almost no variance is zero; the component of largest
    magnitude is positive (E10)."""
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    values, axes = values[order], axes[:, order].T.copy()
    if values[0] <= 0:
        raise Degenerate("the vectors do not vary")
    for value, axis in zip(values, axes, strict=True):
        if value / values[0] <= 1e-9:
            axis[:] = 0
        elif axis[np.argmax(np.abs(axis))] < 0:
            axis *= -1
    return axes


@dataclass
class Pca:
    name: str = "pca"

    def fit(self, data: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n, width = check(data, MIN_PCA)
        _, total = _partials(data, width, None)
        mean = total / n
        _, outer = _partials(data, width, mean)
        return mean, principal_axes(outer.reshape(width, width) / (n - 1))

    def fit_transform(self, data: DataFrame) -> DataFrame:
        mean, axes = self.fit(data)
        centred = F.zip_with(scalar.doubles(F.col("v")), F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
        x, y = (scalar.dot(F.col("c"), F.array(*map(F.lit, a.tolist()))) for a in axes)
        return data.select("id", centred.alias("c")).select("id", x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))

    def params_json(self) -> str:
        return json.dumps({"axes": 2})


def reduce_rows(x: np.ndarray, k: int) -> np.ndarray:
    """PCA by the covariance or, where there are fewer rows than columns, by the Gram matrix (I4)."""
    c = x - x.mean(axis=0)
    if x.shape[1] <= k:
        return c
    if x.shape[1] <= len(x):
        _, axes = np.linalg.eigh(c.T @ c)
        return c @ axes[:, ::-1][:, :k]
    values, left = np.linalg.eigh(c @ c.T)
    return left[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))


def _on_driver(data: DataFrame) -> tuple[list[int], np.ndarray]:
    n, _ = check(data, 0)
    if n > MAX_DRIVER:
        raise ValueError(f"{n} vectors: a layout of more than {MAX_DRIVER} is fitted by PCA")
    rows = data.select("id", "v").orderBy("id").toArrow()
    return rows["id"].to_pylist(), np.array(rows["v"].to_pylist(), np.float64)


def tsne(x: np.ndarray, dims: int = 2, perplexity: float = 12.0, epochs: int = 1000, seed: int = 0) -> np.ndarray:
    """Exact t-SNE (van der Maaten 2008) with early exaggeration and momentum."""
    n = len(x)
    if n < 2:
        return np.zeros((n, dims))
    perplexity = min(perplexity, max(1.0, (n - 1) / 3 - 1))
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)[None, :], 0)
    p = np.zeros((n, n))
    for i in range(n):
        row = np.delete(d[i], i)
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            w = np.exp(-(row - row.min()) * beta)
            q = w / w.sum()
            entropy = -(q * np.log(np.maximum(q, 1e-300))).sum()
            if abs(entropy - np.log(perplexity)) < 1e-5:
                break
            if entropy > np.log(perplexity):
                low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, step, gains = rng.normal(0, 1e-4, (n, dims)), np.zeros((n, dims)), np.ones((n, dims))
    rate = max(n / 12.0, 50.0)
    for t in range(epochs):
        num = 1 / (1 + np.maximum((y * y).sum(1)[:, None] - 2 * y @ y.T + (y * y).sum(1)[None, :], 0))
        np.fill_diagonal(num, 0)
        g = ((12 if t < 250 else 1) * p - np.maximum(num / num.sum(), 1e-12)) * num
        grad = 4 * (g.sum(axis=1)[:, None] * y - g @ y)
        gains = np.maximum(np.where(np.sign(grad) != np.sign(step), gains + 0.2, gains * 0.8), 0.01)
        step = (0.5 if t < 250 else 0.8) * step - rate * gains * grad
        y = y + step
        y -= y.mean(axis=0)
    return y


@dataclass
class Tsne:
    """Default layout (I5); not distributable, so it is bounded by MAX_DRIVER vectors."""

    perplexity: float = 12.0
    epochs: int = 1000
    seed: int = 0
    name: str = "tsne"

    def fit_transform(self, data: DataFrame) -> DataFrame:
        check(data, MIN_PCA)
        ids, x = _on_driver(data)
        y = tsne(reduce_rows(x, 30), 2, self.perplexity, self.epochs, self.seed)
        return data.sparkSession.createDataFrame([(i, float(a), float(b), 0.0) for i, (a, b) in zip(ids, y, strict=True)], "id long, x double, y double, z double")

    def params_json(self) -> str:
        return json.dumps({"perplexity": self.perplexity, "theta": 0.5, "epochs": self.epochs})

    def colours(self, data: DataFrame) -> DataFrame:
        """A three-dimensional fit scaled to 0..1 for each channel; grey for fewer than four."""
        ids, x = _on_driver(data)
        c = np.full((len(ids), 3), 0.5)
        if len(ids) >= MIN_PCA:
            y = tsne(reduce_rows(x, 30), 3, self.perplexity, self.epochs, self.seed)
            span = y.max(axis=0) - y.min(axis=0)
            c = np.where(span > 0, (y - y.min(axis=0)) / np.where(span > 0, span, 1), 0.5)
        return data.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in zip(ids, c, strict=True)], "id long, r double, g double, b double")


@dataclass
class Umap:
    """UMAP (McInnes 2018) over an exact cosine neighbour graph, refused where that graph falls
    apart (I7)."""

    neighbours: int = 15
    epochs: int = 300
    min_dist: float = 0.1
    seed: int = 0
    name: str = "umap"

    def fit_transform(self, data: DataFrame) -> DataFrame:
        n, _ = check(data, MIN_UMAP)
        k = min(self.neighbours, n - 1)
        graph = vectors.nearest(data, data, k, "cosine")
        edges = graph.select(F.col("query_id").alias("src"), F.col("id").alias("dst"))
        if vectors.n_components(data.select("id"), edges) > 1:
            raise Degenerate("the neighbour graph is not connected")
        ids, _ = _on_driver(data)
        at = {v: i for i, v in enumerate(ids)}
        rows = graph.select("query_id", "id", "score").toArrow().to_pandas()
        i, j, d = rows["query_id"].map(at).to_numpy(), rows["id"].map(at).to_numpy(), np.maximum(1 - rows["score"].to_numpy(), 0)
        y = self._layout(n, i, j, d, k)
        return data.sparkSession.createDataFrame([(v, float(a), float(b), 0.0) for v, (a, b) in zip(ids, y, strict=True)], "id long, x double, y double, z double")

    def _layout(self, n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
        rho = np.full(n, np.inf)
        np.minimum.at(rho, i, d)
        low, high, sigma = np.zeros(n), np.full(n, np.inf), np.ones(n)
        for _ in range(64):
            total = np.bincount(i, np.exp(-np.maximum(d - rho[i], 0) / np.maximum(sigma[i], 1e-9)), n)
            more = total > np.log2(k)
            high, low = np.where(more, sigma, high), np.where(more, low, sigma)
            sigma = np.where(np.isinf(high), sigma * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
        w = np.zeros((n, n), np.float32)
        w[i, j] = np.exp(-np.maximum(d - rho[i], 0) / np.maximum(sigma[i], 1e-9))
        w = w + w.T - w * w.T
        a, b = 1.577, 0.895  # the curve for a minimal distance of 0.1
        rng = np.random.default_rng(self.seed)
        y = rng.uniform(-10, 10, (n, 2))
        heads, tails = np.nonzero(w)
        weight = w[heads, tails]
        for t in range(self.epochs):
            rate = 1 - t / self.epochs
            on = rng.random(len(heads)) < weight / weight.max()
            h, q = heads[on], tails[on]
            diff = y[h] - y[q]
            d2 = (diff**2).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
            np.add.at(y, h, np.clip(pull[:, None] * diff, -4, 4) * rate)
            other = rng.integers(0, n, len(h) * 5)
            h5 = np.repeat(h, 5)
            diff = y[h5] - y[other]
            d2 = (diff**2).sum(1)
            push = 2 * b / ((0.001 + d2) * (1 + a * d2**b))
            np.add.at(y, h5, np.clip(push[:, None] * diff, -4, 4) * rate * (h5 != other)[:, None])
        return y - y.mean(axis=0)

    def params_json(self) -> str:
        return json.dumps({"neighbours": self.neighbours, "epochs": self.epochs, "minDist": self.min_dist})


# -- alignment ----------------------------------------------------------------------------------


@dataclass
class Alignment:
    """Similarity transform of a plane; ``reflected`` by the determinant of its rotation."""

    rotation: np.ndarray = field(default_factory=lambda: np.eye(2))
    scale: float = 1.0
    source: np.ndarray = field(default_factory=lambda: np.zeros(2))
    target: np.ndarray = field(default_factory=lambda: np.zeros(2))
    pairs: int = 0

    @property
    def reflected(self) -> bool:
        return bool(np.linalg.det(self.rotation) < 0)

    def apply(self, points: DataFrame) -> DataFrame:
        m = self.rotation * self.scale
        x, y = F.col("x") - float(self.source[0]), F.col("y") - float(self.source[1])
        nx = x * float(m[0, 0]) + y * float(m[0, 1]) + float(self.target[0])
        ny = x * float(m[1, 0]) + y * float(m[1, 1]) + float(self.target[1])
        return points.withColumns({"x": nx, "y": ny})


def procrustes(new: DataFrame, old: DataFrame) -> Alignment:
    """Best similarity of two layouts over their common ids; identity for fewer than four.

    Centroids, variance and the cross sums are one aggregation; the rest is a 2x2 SVD.
    """
    both = new.select("id", "x", "y").join(old.select("id", F.col("x").alias("u"), F.col("y").alias("w")), "id")
    mean = both.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in "xyuw")).first()
    n = mean["n"]
    if n < MIN_PAIRS:
        return Alignment(pairs=n)
    x, y, u, w = (F.col(c) - F.lit(mean[c]) for c in "xyuw")
    s = both.agg(F.sum(x * x + y * y).alias("v"), F.sum(x * u).alias("xu"), F.sum(x * w).alias("xw"), F.sum(y * u).alias("yu"), F.sum(y * w).alias("yw")).first()
    if not s["v"] or not np.isfinite(s["v"]):
        return Alignment(pairs=n)
    left, sizes, right = np.linalg.svd(np.array([[s["xu"], s["xw"]], [s["yu"], s["yw"]]]))
    return Alignment(right.T @ left.T, float(sizes.sum() / s["v"]), np.array([mean["x"], mean["y"]]), np.array([mean["u"], mean["w"]]), n)


# -- refits ---------------------------------------------------------------------------------------


def plan(total: int, placed: int | None) -> tuple[str, int]:
    """``up_to_date``, ``incremental`` or ``full`` and the number of newcomers."""
    if placed is None:
        return "full", total
    new = max(total - placed, 0)
    if new == 0:
        return "up_to_date", 0
    return ("incremental" if new / total < INCREMENTAL_SHARE else "full"), new


def fan_out(rows: DataFrame, fitted: DataFrame, extent: float) -> DataFrame:
    """Coordinates of all samples from those of their distinct vectors: the first has them
    exactly, the others moved a little (I13, C15)."""
    placed = catalog.representatives(rows, "vector_id", "sample_id").join(fitted.withColumnRenamed("id", "vector_id"), "vector_id")
    dx, dy = scalar.jitter(F.col("sample_id"), F.lit(extent))
    first = F.col("sample_id") == F.col("representative")
    colours = [c for c in ("r", "g", "b") if c in fitted.columns]
    return placed.select("sample_id", F.when(first, F.col("x")).otherwise(F.col("x") + dx).alias("x"), F.when(first, F.col("y")).otherwise(F.col("y") + dy).alias("y"), F.col("z"), *colours)


@dataclass
class Refit:
    outcome: str
    algorithm: str | None
    run_id: int | None
    alignment: Alignment | None
    relative_displacement: float | None
    placed: int


def refit(store: catalog.Store, projector: Projector, now: int, fallback: Projector | None = None, colours: bool = False, align: bool = True, force_full: bool = False, cancelled=lambda: False) -> Refit:
    """Plan, fit, fan out, align, write and activate a layout.

    The new layout is written before the pointer moves; a failure leaves the active one as it
    is.  Any error of the projector but a cancellation goes to the fallback.
    """
    samples, vector, runs, points = (store.read(t) for t in ("samples", "vectors", "projection_runs", "projections"))
    rows = catalog.embedded(samples)
    total = rows.count()
    active = runs.where("is_active").select("id").first()
    placed = None if active is None else points.where(F.col("run_id") == active["id"]).count()
    kind, new = ("full", total) if force_full else plan(total, placed)
    if kind == "up_to_date":
        return Refit(kind, None, active["id"], None, None, 0)
    if kind == "incremental":
        mine = points.where(F.col("run_id") == active["id"])
        anchors = mine.join(rows, "sample_id").join(vector, "vector_id").select(F.col("sample_id").alias("id"), "v", "x", "y")
        fresh = vectors.newcomers(rows, points, active["id"]).join(vector, "vector_id").select(F.col("sample_id").alias("id"), "v")
        found = vectors.place(fresh, anchors).withColumnRenamed("id", "sample_id")
        store.write({"projections": catalog.set_points(points, active["id"], found)})
        return Refit(kind, None, active["id"], None, None, new)
    data = rows.select("vector_id").distinct().join(vector, "vector_id").select(F.col("vector_id").alias("id"), "v")
    try:
        used, fitted = projector, projector.fit_transform(data)
    except Cancelled:
        raise
    except Exception:
        if fallback is None:
            raise
        used, fitted = fallback, fallback.fit_transform(data)
    if colours and isinstance(projector, Tsne):
        fitted = fitted.join(projector.colours(data), "id")
    box = columns.bounding_box(fitted).first()
    layout = fan_out(rows, fitted, float(box["diagonal"] or 0.0))
    alignment, moved = None, None
    if align and active is not None:
        old = points.where(F.col("run_id") == active["id"])
        alignment = procrustes(layout.withColumnRenamed("sample_id", "id"), old.withColumnRenamed("sample_id", "id"))
        layout = alignment.apply(layout)
        moved = columns.displacement(layout, old).first()["relative"]
    if cancelled():
        raise Cancelled
    runs, run_id = catalog.begin_run(runs, used.name, json.loads(used.params_json()), total, now)
    points = catalog.set_points(points, run_id, layout)
    runs, points = catalog.activate(runs, points, run_id, now)
    store.write({"projections": points, "projection_runs": runs})
    return Refit(kind, used.name, run_id, alignment, moved, total)
