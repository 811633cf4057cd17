"""Columns and kernels on nucleotide sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.arrays import let, total

BASES = "ACGT"


def normalised(seq: Column) -> Column:
    """Upper case without white space, every letter but A, C, G, T as N; null stays null."""
    return F.regexp_replace(F.upper(F.regexp_replace(seq, r"\s", "")), "[^ACGT]", "N")


def only_bases(text: Column) -> Column:
    """The letters A, C, G, T of a text, in order."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


@lru_cache(maxsize=8)
def dictionary(k: int = 4) -> tuple[tuple[str, ...], np.ndarray]:
    """Canonical k-mers in lexicographic order, and for every k-mer code (base 4) the index of its canonical one."""
    words = ["".join(w) for w in product(BASES, repeat=k)]
    flip = str.maketrans("ACGT", "TGCA")
    lesser = [min(w, w[::-1].translate(flip)) for w in words]
    names = tuple(sorted(set(lesser)))
    at = {w: i for i, w in enumerate(names)}
    return names, np.array([at[w] for w in lesser], np.int64)


def kmer_dictionary(spark: SparkSession, k: int = 4) -> DataFrame:
    """``kmer_id, kmer`` of the canonical k-mers (136 for k = 4), built from the four bases."""
    base = spark.createDataFrame([(b,) for b in BASES], "b string")
    words = base.select(F.col("b").alias("w"))
    for _ in range(k - 1):  # 4^k rows, k is small and fixed
        words = words.crossJoin(F.broadcast(base)).select(F.concat("w", "b").alias("w"))
    names = words.select(canonical(F.col("w")).alias("kmer")).distinct()
    ids = {w: i for i, w in enumerate(dictionary(k)[0])}
    return names.select(F.create_map(*[x for w, i in ids.items() for x in (F.lit(w), F.lit(i))])[F.col("kmer")].alias("kmer_id"), "kmer")


def count_kmers(texts: pa.Array, k: int = 4) -> np.ndarray:
    """Counts of the canonical k-mers of every sequence, windows with any other letter left out: one row per sequence."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    names, canon = dictionary(k)
    n = len(texts)
    _, offsets, body = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[: n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body is not None else np.zeros(0, np.uint8)
    if len(data) < k:
        return np.zeros((n, len(names)), np.int64)
    code = np.full(256, 4, np.uint8)
    for i, b in enumerate(BASES):
        code[ord(b)] = code[ord(b.lower())] = i
    code = code[data]
    windows = len(data) - k + 1
    word, bad = np.zeros(windows, np.int32), np.zeros(windows, bool)
    for i in range(k):
        part = code[i : i + windows]
        word = word * 4 + part
        bad |= part == 4
    owner = np.repeat(np.arange(n), np.diff(edges))
    bad |= owner[:windows] != owner[k - 1 :]
    keep = ~bad
    return np.bincount(owner[:windows][keep] * len(names) + canon[word[keep]], minlength=n * len(names)).reshape(n, len(names))


def kmer_table(contigs: DataFrame, key: str, seq: str, k: int = 4) -> DataFrame:
    """``key, counts``: the dense k-mer counts of each contig, without a shuffle and without a row per base.

    Null and too short sequences have zero counts.
    """
    kind = contigs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(dictionary(k)[0])
        for batch in batches:
            counts = count_kmers(batch.column("seq").fill_null(""), k)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], ["key", "counts"])

    slim = contigs.select(F.col(key).alias("key"), F.col(seq).cast("string").alias("seq"))
    return slim.mapInArrow(run, f"key {kind.simpleString()}, counts array<bigint>").withColumnRenamed("key", key)


def long_counts(table: DataFrame, key: str, k: int = 4) -> DataFrame:
    """``key, kmer, n`` of the k-mers that occur."""
    names = F.array(*map(F.lit, dictionary(k)[0]))
    each = table.select(key, F.posexplode("counts").alias("i", "n")).where("n > 0")
    return each.select(key, F.get(names, F.col("i")).alias("kmer"), "n")


def frequencies(counts: Column) -> Column:
    """Counts over their sum; null (not NaN) for a contig without any k-mer."""
    every = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return let(every, lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)))


def log_ratio(freqs: Column, pseudo: float = 0.0) -> Column:
    """ln(x / arithmetic row mean), with *pseudo* added to every value first; ln(0) is minus infinity.

    Null for null or empty vectors; NaN where the mean is 0.
    """
    low, nan = F.lit(float("-inf")), F.lit(float("nan"))
    moved = F.transform(freqs, lambda x: x + pseudo) if pseudo else freqs
    ratio = let(
        total(moved) / F.size(freqs),
        lambda mean: F.transform(moved, lambda x: F.when(mean == 0, nan).when(x == 0, low).otherwise(F.ln(x / mean))),
    )
    return F.when(F.size(freqs) > 0, ratio)


def kmer_size(n_columns: Column) -> Column:
    """The k-mer size that a table of so many columns was made with."""
    return F.round(F.log(4.0, n_columns.cast("double"))).cast("int")


# fixed values: two odd 64-bit multipliers
MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
WINDOWS = 1 << 18


def mixed(codes: np.ndarray) -> np.ndarray:
    """Well-spread unsigned 64-bit hashes of k-mer codes."""
    h = codes * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(29))


def sketch_of(data: np.ndarray, k: int, scale: float) -> tuple[int, np.ndarray]:
    """The k-mers of a sequence's bytes without other letters, and their distinct kept hashes, sorted; in time proportional to the length."""
    code = np.full(256, 4, np.uint8)
    for i, b in enumerate(BASES):
        code[ord(b)] = i
    # up to 31 letters a code is the k-mer as a number; beyond, letters are weighed by powers of an odd number
    base = 4 if k <= 31 else MIX_B
    powers = np.cumprod(np.array([1] + [base] * (k - 1), np.uint64), dtype=np.uint64)
    top = np.uint64(int(scale * float(1 << 63)))
    n, kept = 0, [np.zeros(0, np.uint64)]
    for at in range(0, len(data) - k + 1, WINDOWS):
        part = code[data[at : at + WINDOWS + k - 1]]
        windows = len(part) - k + 1
        forward, back, bad = np.zeros(windows, np.uint64), np.zeros(windows, np.uint64), np.zeros(windows, bool)
        for i in range(k):
            letter = part[i : i + windows]
            bad |= letter == 4
            wide = letter.astype(np.uint64)
            forward += wide * powers[k - 1 - i]
            back += (np.uint64(3) - wide) * powers[i]
        n += windows - int(bad.sum())
        h = mixed(np.minimum(forward, back)[~bad])
        kept.append(np.unique(h[(h >> np.uint64(1)) < top]))
    return n, np.unique(np.concatenate(kept).astype(np.int64))


def scaled_sketch(contigs: DataFrame, key: str, seq: str, k: int = 31, scale: float = 0.1) -> DataFrame:
    """``key, seq_length, n_kmers, hashes``: the distinct canonical k-mer hashes in the lowest *scale* of the hash range, sorted.

    Hashes are unsigned 64-bit, kept as longs; shifted right by one they compare as
    such. Each contig is hashed within its row, so nothing is shuffled. A null
    sequence is an empty one.
    """
    kind = contigs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch_of(np.frombuffer((x or "").encode(), np.uint8), k, scale) for x in batch.column("seq").to_pylist()]
            edges = np.concatenate(([0], np.cumsum([len(h) for _, h in found]))).astype(np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([h for _, h in found]) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq_length"), pa.array([n for n, _ in found], pa.int64()), hashes], ["key", "seq_length", "n_kmers", "hashes"])

    text = F.coalesce(normalised(F.col(seq)), F.lit(""))
    slim = contigs.select(F.col(key).alias("key"), text.alias("seq")).select("key", "seq", F.length("seq").alias("seq_length"))
    return slim.mapInArrow(run, f"key {kind}, seq_length int, n_kmers bigint, hashes array<bigint>").withColumnRenamed("key", key)
