"""Timed regions, and the performance models of the kernels."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from .dtypes import DType


@dataclass
class Region:
    times: list[float] = field(default_factory=list)
    models: dict[str, Callable[[float], float]] = field(default_factory=dict)

    def summary(self) -> dict[str, float]:
        t, late = self.times, self.times[10:]
        if not t:
            return {"calls": 0}
        out = {"calls": len(t), "min": min(t), "max": max(t), "avg": sum(t) / len(t), "acc": sum(t), "avg_without_first_10": sum(late) / len(late) if late else float("nan")}
        return out | {k: f(out["avg"]) for k, f in self.models.items()}


class Timings:
    def __init__(self) -> None:
        self.regions: dict[str, Region] = {}

    @contextmanager
    def region(self, name: str, spark=None, **models: Callable[[float], float]):
        if spark is not None:
            spark.sparkContext.setJobGroup(name, name)
        t = time.perf_counter()
        try:
            yield
        finally:
            r = self.regions.setdefault(name, Region())
            r.times.append(time.perf_counter() - t)
            r.models.update(models)

    def report(self) -> str:
        return "\n".join(f"{k}: " + ", ".join(f"{n} {v:.4g}" for n, v in r.summary().items()) for k, r in self.regions.items())


def spmv_flops(
    nnz: int, k: int, dtype: DType = DType.D, nrows: int = 0, accumulate: bool = True, scale: bool = False, shift: bool = False, axpby: bool = False, dots: int = 0, chain: bool = False, matrix: DType | None = None
) -> float:
    """An entry and column take 2 flops, 8 if matrix and vector (dtype) are complex, 4 if one of them is; and what the fused options add."""
    pair = (dtype.is_complex, (matrix or dtype).is_complex)
    add, mul = (2, 6) if pair[0] else (1, 1)
    each = {2: 8, 1: 4, 0: 2}[sum(pair)]
    f = nnz * k * each - (0 if accumulate else nrows * k * add)
    per_row = scale * mul + shift * (add + mul) + axpby * (add + mul) + dots * (add + mul) + chain * (add + 2 * mul)
    return f + nrows * k * per_row


def gflops(flops: float) -> Callable[[float], float]:
    return lambda t: flops / 1e9 / t


def gbytes(words: int, nrows: int, k: int, dtype: DType = DType.D) -> Callable[[float], float]:
    """words is 3 for axpy and axpby, 4 for axpbypcz, 2 for scale, 1 for dot (2 if its operands differ)."""
    return lambda t: words * dtype.size * nrows * k / 1e9 / t


def gemm_flops(m: int, n: int, k: int, dtype: DType = DType.D, alpha: bool = False, beta: bool = False) -> float:
    return (8 if dtype.is_complex else 2) * m * n * k + (alpha + 2 * beta) * m * n


def gemm_bytes(m: int, n: int, k: int, dtype: DType = DType.D, beta: bool = False) -> float:
    """Bytes that a product of m x k and k x n moves; with beta the result is read too."""
    return dtype.size * ((2 if beta else 1) * m * n + m * k + n * k)


def bandwidths(spark, n: int = 1_000_000, rounds: int = 3) -> dict[str, float]:
    """GB/s of load, store, copy, update and triad over n doubles that executors hold, the best of some rounds. What is counted are 1, 1, 2, 2 and 3 words a number."""
    x = spark.range(n).select(F.col("id").alias("i"), F.rand(1).alias("a"), F.rand(2).alias("b")).persist()
    x.count()
    put = lambda df: df.write.format("noop").mode("overwrite").save()
    runs = {
        "load": (1, lambda: x.agg(F.sum("a")).first()),
        "store": (1, lambda: put(spark.range(n).select(F.lit(1.0).alias("a")))),
        "copy": (2, lambda: put(x.select("a"))),
        "update": (2, lambda: put(x.select((F.col("a") * 1.5).alias("a")))),
        "triad": (3, lambda: put(x.select((F.col("a") + 1.5 * F.col("b")).alias("a")))),
    }
    out = {}
    for name, (words, run) in runs.items():
        times = []
        for _ in range(rounds):
            t = time.perf_counter()
            run()
            times.append(time.perf_counter() - t)
        out[name] = 8e-9 * words * n / min(times)
    x.unpersist()
    return out


class Transfers:
    """Bytes that executors read from input and move between stages, by named region."""

    def __init__(self, spark) -> None:
        self.sc, self.regions = spark.sparkContext._jsc.sc(), {}

    def _now(self) -> tuple[int, int, int]:
        self.sc.listenerBus().waitUntilEmpty()
        found = self.sc.statusStore().executorList(False)
        each = [found.apply(k) for k in range(found.size())]
        return tuple(sum(getattr(e, f)() for e in each) for f in ("totalInputBytes", "totalShuffleWrite", "totalShuffleRead"))

    @contextmanager
    def region(self, name: str):
        before = self._now()
        try:
            yield
        finally:
            got = self.regions.setdefault(name, [0, 0, 0])
            self.regions[name] = [a + y - x for a, x, y in zip(got, before, self._now(), strict=True)]

    def report(self) -> str:
        return "\n".join(f"{k}: read {r}, sent {w}, received {g} bytes" for k, (r, w, g) in self.regions.items())
