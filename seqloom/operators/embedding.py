"""Embedding of a nearest-neighbour graph: fuzzy weights as a plan, layout of a bounded graph in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut, release

MAX_NODES = 200_000


def fuzzy_weights(edges: DataFrame, steps: int = 40) -> DataFrame:
    """``src, dst, weight``: exp(-(d - rho) / sigma), with sigma such that a node's weights add up to log2 of their number; symmetric as a + b - ab.

    A node's neighbours are few (k), so they are handled as one array.
    """
    near = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("distance", "dst"))).alias("n")).select("src", F.transform("n", lambda x: x["distance"]).alias("d"), F.transform("n", lambda x: x["dst"]).alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, to = batch.column("d"), batch.column("to").flatten()
            size = np.diff(d.offsets.to_numpy())
            # one row of a matrix for each node; places that a node has no neighbour for weigh nothing
            has = np.arange(size.max(initial=0)) < size[:, None]
            gap = np.full(has.shape, np.inf)
            gap[has] = d.flatten().to_numpy()
            gap -= gap.min(1, initial=np.inf)[:, None]
            widest = np.where(has, gap, 0).max(1, initial=0)
            low, high, want = np.full(len(size), 1e-12), np.maximum(widest, 1e-6) * 1e3, np.maximum(np.log2(np.maximum(size, 1)), 1e-3)
            for _ in range(steps):
                sigma = (low + high) / 2
                less = np.exp(-gap / sigma[:, None]).sum(1) < want
                low, high = np.where(less, sigma, low), np.where(less, high, sigma)
            weight = np.exp(-gap / np.maximum(high, 1e-12)[:, None])[has]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("src").to_numpy(), size)), to, pa.array(weight)], ["src", "dst", "w"])

    one = near.mapInArrow(run, "src long, dst long, w double")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w").withColumn("w", F.col("w")))
    # at most two weights of a pair, one of each direction
    return both.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count("w") > 1, F.exp(F.sum(F.ln("w")))).otherwise(0.0)).alias("weight"))


def layout(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, dims: int, seed: int = 42, epochs: int = 150, b: float = 1.5, negatives: int = 5) -> np.ndarray:
    """Positions of n nodes: linked ones attract, sampled others repel, similarity 1 / (1 + d^(2b))."""
    rng = np.random.default_rng(seed)
    # start from smoothed noise: a few steps of averaging over neighbours spread along the graph's slow directions
    x = rng.normal(size=(n, dims))
    degree = np.maximum(np.bincount(src, weights=weight, minlength=n), 1e-12)
    for _ in range(30):
        y = np.zeros_like(x)
        np.add.at(y, src, x[dst] * weight[:, None])
        x = x * 0.5 + 0.5 * y / degree[:, None]
        x -= x.mean(0)
        q, _ = np.linalg.qr(x)
        x = q * np.sqrt(n)
    x *= 10 / max(np.abs(x).max(), 1e-12)
    for e in range(epochs):
        rate = 1.0 - e / epochs
        take = rng.random(len(src)) < weight / max(weight.max(initial=0), 1e-12)
        i, j = src[take], dst[take]
        diff = x[i] - x[j]
        square = (diff * diff).sum(1)
        pull = -2 * b * np.power(np.maximum(square, 1e-9), b - 1) / (1 + np.power(square, b))
        move = np.zeros_like(x)
        np.add.at(move, i, np.clip(pull[:, None] * diff, -4, 4))
        i = np.repeat(i, negatives)
        j = rng.integers(0, n, len(i))
        diff = x[i] - x[j]
        square = (diff * diff).sum(1)
        push = 2 * b / ((0.001 + square) * (1 + np.power(square, b)))
        np.add.at(move, i, np.where((i != j)[:, None], np.clip(push[:, None] * diff, -4, 4), 0))
        x += rate * np.clip(move, -4, 4) / 4
    return x


def embed(weights: DataFrame, dims: int, seed: int = 42) -> DataFrame:
    """``id, vec`` of every node of ``src, dst, weight``. The graph is laid out in one task: at most MAX_NODES nodes, else an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        ids, at = np.unique(np.concatenate((pdf.src, pdf.dst)), return_inverse=True)
        if len(ids) > MAX_NODES:
            raise ValueError(f"{len(ids)} nodes in one layout; at most {MAX_NODES} are allowed")
        x = layout(len(ids), at[: len(pdf)], at[len(pdf) :], pdf.weight.to_numpy(), dims, seed)
        return pd.DataFrame({"id": ids, "vec": list(x)})

    return weights.select("src", "dst", "weight").groupBy().applyInPandas(run, "id long, vec array<double>")


def embed_with_retry(build: Callable[[int], DataFrame], k: int, dims: int, tries: int = 5, step: int = 10) -> DataFrame:
    """Embeds the graph ``build(k)``; where a node gets no finite place, again with *step* more neighbours, on the same nodes."""
    for n in range(tries):
        out = cut(embed(fuzzy_weights(build(k + n * step)), dims))
        if out.where(F.exists("vec", lambda v: F.isnan(v))).isEmpty():
            return out
        release(out)
    raise ValueError("the graph could not be embedded")
