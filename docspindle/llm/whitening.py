"""Embedding whitening by a tall-skinny QR: no covariance of the data is formed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, share, value_of

#: Results of partitions that are merged in one task.
FAN_IN = 64
#: Bytes of models (sums and components of each vector length) that are sent to every executor.
MODEL_BYTES = 64 << 20
#: x is floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: |floor(64 c)| stops here, so that sums over four thousand million rows stay exact.
MOST = 1 << 31


def _vectors(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x - OFFSET as longs) for each length of vector in a batch."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        if d:
            x = flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)
            yield int(d), at, np.clip(np.floor(SCALE * x), -MOST, MOST).astype("i8")


def _merged(parts: DataFrame, merge: Callable[[list[bytes], list[int]], bytes]) -> DataFrame:
    """One row (dim, part 0, n, state) for each length, merged FAN_IN by FAN_IN up a tree."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN_IN, "n": pdf["n"].sum(), "state": [merge(pdf["state"].tolist(), pdf["n"].tolist())]})

    parts = materialise(parts)
    while True:
        last = parts.agg(F.max("part")).first()[0]
        if not last:
            return parts
        up = F.expr(f"part div {FAN_IN}").alias("up")
        parts = materialise(parts.groupBy("dim", up).applyInPandas(step, "dim int, part long, n long, state binary"))


def _partials(start: Callable[[int], object], take: Callable[[object, int, np.ndarray], object]):
    """A pass over vectors that keeps one state for each length and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, states, counts = TaskContext.get().partitionId(), {}, {}
        for b in batches:
            for d, at, x in _vectors(b.column(0)):
                states[d] = take(states.get(d, start(d)), d, x)
                counts[d] = counts.get(d, 0) + len(at)
        dims = list(states)
        yield pa.RecordBatch.from_arrays(
            [pa.array(dims, pa.int32()), pa.array([part] * len(dims), pa.int64()), pa.array([counts[d] for d in dims], pa.int64()), pa.array([states[d].tobytes() for d in dims], pa.binary())],
            ["dim", "part", "n", "state"],
        )

    return run


_PART = "dim int, part long, n long, state binary"


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """(n * x - total) / n: the numerator is exact."""
    return (n * x - total) / n


def _moments(w: np.ndarray) -> np.ndarray:
    """Rows [mean; centred products] of w."""
    mean = w.mean(0)
    return np.vstack([mean, (w - mean).T @ (w - mean)])


def _joined(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Means and centred products of two sets of n and m rows as those of one."""
    step = b[0] - a[0]
    return np.vstack([a[0] + step * (m / (n + m)), a[1:] + b[1:] + np.outer(step, step) * (n * m / (n + m))])


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """id, component, n, deviation (decimal), whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are dropped. An entry c
    becomes x = floor(64 c) + 1,000,000 (64 c is held within 2^31). Rows are centred by
    exact integer sums; each partition reduces its rows to a triangular factor R by QR,
    batch by batch, factors are merged in a tree, and the last one's singular values s
    and right vectors give eigenvalues s^2 / n and components. So small eigenvalues keep
    their precision, and a task holds a batch and two factors.

    A row comes once for each component, up to `components` of them (or the length of the
    vector). deviation is the exact sum of (n x - S)^2. identity_error is measured: all
    whitened rows are centred, multiplied and merged in a tree again.

    Vectors of different lengths are fitted apart, each length as a table of its own; empty
    vectors have no components, so no rows. Components without variance (fewer rows than
    dimensions, or equal rows) are whitened to 0, explain 0, and count in identity_error
    as 1. Repeated rows and null ids are rows like others; other columns are not read; an empty
    table gives an empty result. The models of all lengths, 8 * length * (components + 2)
    bytes each, go to all executors; more than MODEL_BYTES of them are refused.
    """
    spark = vectors.sparkSession
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(fine)
    only = rows.select("v")

    sums = _merged(
        only.mapInArrow(_partials(lambda d: np.zeros(d, "i8"), lambda s, d, x: s + x.sum(0)), _PART),
        lambda states, _: np.sum([np.frombuffer(s, "i8") for s in states], 0).tobytes(),
    )
    if sums.filter("n > 0").agg(F.coalesce(F.sum(F.col("dim") * 8 * (components + 2)), F.lit(0))).first()[0] > MODEL_BYTES:
        raise ValueError("vectors have too many different lengths, or are too long")
    totals = {r["dim"]: (r["n"], np.frombuffer(r["state"], "i8")) for r in sums.collect()}
    known = share(spark, totals)

    def square(r: np.ndarray, d: int, x: np.ndarray) -> np.ndarray:
        n, total = value_of(known)[d]
        r = np.linalg.qr(np.vstack([r, _centred(x, n, total)]), "r")
        # Factors are squares, so that their bytes tell the length.
        return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r

    def both(states: list[bytes], _) -> bytes:
        out = np.frombuffer(states[0])
        d = round(len(out) ** 0.5)
        out = out.reshape(d, d)
        for s in states[1:]:
            out = np.linalg.qr(np.vstack([out, np.frombuffer(s).reshape(d, d)]), "r")
        return out.tobytes()

    factors = _merged(only.mapInArrow(_partials(lambda d: np.zeros((0, d)), square), _PART), both)
    models = {}
    for r in factors.toLocalIterator():
        d, n = r["dim"], r["n"]
        s, right = np.linalg.svd(np.frombuffer(r["state"]).reshape(d, d))[1:]
        k = min(components, d)
        held = s[:k] > s[0] * max(d, 2) * np.finfo("f8").eps
        scale = np.where(held, n**0.5 / np.where(held, s[:k], 1), 0)
        # V * scale, and each component's share of the trace.
        models[d] = (*totals[d], np.ascontiguousarray(right[:k].T * scale), np.where(held, s[:k] ** 2, 0) / max((s**2).sum(), np.finfo("f8").tiny))
    model = share(spark, models)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, states, counts, known = TaskContext.get().partitionId(), {}, {}, value_of(model)
        for b in batches:
            for d, at, x in _vectors(b.column(0)):
                n, total, to, _ = known[d]
                own, m = _moments(_centred(x, n, total) @ to), counts.get(d, 0)
                states[d] = _joined(states[d], m, own, len(at)) if m else own
                counts[d] = m + len(at)
        dims = list(states)
        yield pa.RecordBatch.from_arrays(
            [pa.array(dims, pa.int32()), pa.array([part] * len(dims), pa.int64()), pa.array([counts[d] for d in dims], pa.int64()), pa.array([states[d].tobytes() for d in dims], pa.binary())],
            ["dim", "part", "n", "state"],
        )

    def together(states: list[bytes], counts: list[int]) -> bytes:
        # k * (k + 1) doubles
        k = int((len(states[0]) / 8 + 0.25) ** 0.5)
        out, n = np.frombuffer(states[0]).reshape(k + 1, k), counts[0]
        for s, m in zip(states[1:], counts[1:]):
            out, n = _joined(out, n, np.frombuffer(s).reshape(k + 1, k), m), n + m
        return out.tobytes()

    errors = {}
    for r in _merged(only.mapInArrow(checked, _PART), together).toLocalIterator():
        k = min(components, r["dim"])
        errors[r["dim"]] = float(np.abs(np.frombuffer(r["state"]).reshape(k + 1, k)[1:] / r["n"] - np.eye(k)).max())
    error = share(spark, errors)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, off = value_of(model), value_of(error)
        for b in batches:
            for d, at, x in _vectors(b.column(1)):
                n, total, to, explained = known[d]
                k, diff = to.shape[1], n * x - total
                if float(np.abs(diff).max(initial=0)) ** 2 * d < 2**62:
                    deviation = (diff * diff).sum(1).astype("U")
                else:  # as whole numbers of any size
                    deviation = np.array([str(sum(y * y for y in row)) for row in diff.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at.repeat(k))), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(at))), pa.array(np.full(len(at) * k, n)),
                        pa.array(deviation.repeat(k).tolist(), pa.string()), pa.array((diff / n @ to).ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(len(at) * k, off[d])),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(out, f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return made.withColumnRenamed("id", id_col).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
