"""Splitting oversized texts at natural boundaries, by byte ranges.

A text is looked at in byte ranges with halos, never as a whole: each range's
worker finds where its range really begins and ends (the first safe cut at or
after the nominal edge; both neighbours see the same halo, so they agree) and
counts its tokens. The boundary table is stitched by prefix sums per text,
which tells the texts above the limit and each range's token offset; the pieces
of those are then made range by range, by offset. A range is
``limit * longest token`` bytes, so a text of several ranges always exceeds the
limit, and a text of fewer bytes than the limit never does.

Cuts fall, within the last half of a piece's room, on the last line end, else
sentence end, else word end, else any word end before, else on a character. (A
range's end is a cut too, so a text of many ranges has a shorter piece there.)
Each piece repeats the last ``overlap`` tokens of the one before, up to three
more where a character would be torn. A piece is encoded again on its own and
cut earlier if it then exceeds the limit.

Defined results: null and empty texts have no pieces; where a halo has no safe
cut, the range ends at a character; repeated ids with equal texts give repeated
pieces; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.tokens import DEFAULT_TOKENIZER, encoder, longest_token, safe_cuts

BOUNDS = "doc_id long, range_no long, start_byte long, end_byte long, n_tokens long"
PIECES = "doc_id long, range_no long, piece_no int, start_byte long, end_byte long, token_start long, n_tokens int, text string"


def _edge(data: np.ndarray, nominal: int, halo: int) -> int:
    """Where a range really begins: the first safe cut in the halo, else the next character."""
    seen = data[max(nominal - 1, 0) : nominal + halo]
    cuts = safe_cuts(seen)
    if len(cuts):
        return max(nominal - 1, 0) + int(cuts[0])
    while nominal < len(data) and data[nominal] & 0xC0 == 0x80:
        nominal += 1
    return nominal


def _span(data: np.ndarray, lead: int, size: int, first: bool, last: bool, halo: int) -> tuple[int, int]:
    begin = 0 if first else _edge(data, lead, halo)
    return begin, len(data) if last else _edge(data, lead + size, halo)


def _levels(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How natural a cut at each token end is: 3 line, 2 sentence, 1 word, 0 character, -1 inside a character."""
    before = data[np.maximum(at - 1, 0)]
    after = np.where(at < len(data), data[np.minimum(at, len(data) - 1)], 10)
    line = (before == 10) | (after == 10) | (after == 13)
    gap = (after == 32) | ((after >= 9) & (after <= 13))
    ends = gap & np.isin(before, np.frombuffer(b".!?", np.uint8))
    word = gap | (before == 32) | ((before >= 9) & (before <= 13))
    return np.where(line, 3, np.where(ends, 2, np.where(word, 1, np.where((after & 0xC0) == 0x80, -1, 0))))


def cut_tokens(data: np.ndarray, offsets: np.ndarray, begin: int, limit: int, overlap: int, recount) -> Iterator[tuple[int, int, int]]:  # noqa: ANN001
    """Pieces of the tokens from *begin* on, as (first token, end token, tokens on its own); tokens before are only repeated."""
    n, level = len(offsets) - 1, _levels(data, offsets)

    def whole(t: int) -> int:
        while t > 0 and level[t] < 0:
            t -= 1
        return t

    at = begin
    while at < n:
        start = whole(max(0, at - overlap)) if at else 0
        room = min(n, start + limit)
        while True:
            end = room
            if room < n or level[room] < 0:
                low = max(at, start + limit // 2)
                for window in (level[low + 1 : room + 1], level[at + 1 : room + 1]):
                    if len(window) and window.max() > 0:
                        end = room - int(np.argmax(window[::-1] == window.max()))
                        break
                else:
                    end = max(whole(room), at + 1)
            size = recount(offsets[start], offsets[end])
            if size <= limit or end <= at + 1:
                break
            room = min(end - 1, room - (size - limit))
            room = max(room, at + 1)
        yield start, end, size
        at = end


def _texts(docs: DataFrame, doc_id: str, text: str, limit: int, size: int, halo: int) -> DataFrame:
    """Ranges with halos of the texts of more bytes than *limit*: doc_id, range_no, lead, base, is_last, slice."""
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw")).where(F.octet_length("raw") > limit)
    last = F.floor((F.octet_length("raw") - 1) / F.lit(size))
    return raw.withColumn("last", last).select("doc_id", "raw", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("range_no")).select(
        "doc_id", "range_no",
        F.least(F.lit(halo).cast("long"), F.col("range_no") * size).alias("lead"),
        F.greatest(F.lit(0).cast("long"), F.col("range_no") * size - halo).alias("base"),
        (F.col("range_no") == F.col("last")).alias("is_last"),
        F.expr(f"substring(raw, cast(greatest(0L, range_no * {size} - {halo}) + 1 as int), cast(least({halo}L, range_no * {size}) + {size + halo} as int))").alias("slice"),
    )


def file_ranges(spark: SparkSession, paths: DataFrame, size: int, halo: int) -> DataFrame:
    """Ranges of giant files: *paths* (``doc_id, path, n_bytes``; a path or an address of a file system that Arrow knows), read by seeking."""
    last = F.floor((F.greatest(F.col("n_bytes"), F.lit(1)) - 1) / F.lit(size))
    plan = paths.where("n_bytes > 0").withColumn("last", last).select("doc_id", "path", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("range_no"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                lead = min(halo, r.range_no * size)
                base = r.range_no * size - lead
                system, path = FileSystem.from_uri(r.path)
                with system.open_input_file(path) as f:
                    f.seek(base)
                    piece = f.read(lead + size + (0 if r.range_no == r.last else halo))
                yield pd.DataFrame({"doc_id": [r.doc_id], "range_no": [r.range_no], "lead": [lead], "base": [base], "is_last": [r.range_no == r.last], "slice": [piece]})

    return plan.repartition(spark.sparkContext.defaultParallelism * 4).mapInPandas(read, "doc_id long, range_no long, lead long, base long, is_last boolean, slice binary")


def sizes(limit: int, overlap: int, tokenizer: str) -> tuple[int, int]:
    """Bytes of a range, and of a halo that surely holds *overlap* tokens after a safe cut."""
    longest = longest_token(tokenizer)
    return limit * longest, overlap * longest + 4096


def boundary_table(ranges: DataFrame, limit: int, overlap: int, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Where each range begins and ends, and its tokens."""
    size, halo = sizes(limit, overlap, tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)[0]
        for pdf in batches:
            out = []
            for d, k, lead, base, last, raw in zip(pdf.doc_id, pdf.range_no, pdf.lead, pdf.base, pdf.is_last, pdf.slice, strict=True):
                a, b = _span(np.frombuffer(raw, np.uint8), lead, size, k == 0, last, halo)
                out.append((d, k, base + a, base + b, len(enc.encode_ordinary(bytes(raw[a:b]).decode("utf-8", "replace")))))
            yield pd.DataFrame(out, columns=["doc_id", "range_no", "start_byte", "end_byte", "n_tokens"])

    return ranges.mapInPandas(run, BOUNDS)


def stitch(bounds: DataFrame, limit: int) -> DataFrame:
    """Ranges of the texts of more than *limit* tokens, each with the tokens before it and of the whole text."""
    whole = W.partitionBy("doc_id")
    before = whole.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    return bounds.select(
        "*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_offset"), F.sum("n_tokens").over(whole).alias("doc_tokens")
    ).where(F.col("doc_tokens") > limit)


def emit(ranges: DataFrame, stitched: DataFrame, limit: int, overlap: int, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The pieces of the stitched ranges."""
    size, halo = sizes(limit, overlap, tokenizer)
    wanted = ranges.join(stitched.select("doc_id", "range_no", "token_offset"), ["doc_id", "range_no"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, length = encoder(tokenizer)

        def encode(part: bytes) -> list[int]:
            return enc.encode_ordinary(part.decode("utf-8", "replace"))

        for pdf in batches:
            out = []
            for d, k, lead, base, last, raw, offset in zip(pdf.doc_id, pdf.range_no, pdf.lead, pdf.base, pdf.is_last, pdf.slice, pdf.token_offset, strict=True):
                raw = bytes(raw)
                data = np.frombuffer(raw, np.uint8)
                a, b = _span(data, lead, size, k == 0, last, halo)
                if b <= a:
                    continue
                lead_cuts = safe_cuts(data[:a])
                whole = next(i for i in range(a + 1) if i == a or data[i] & 0xC0 != 0x80)
                low = int(lead_cuts[0]) if len(lead_cuts) else whole
                ids = encode(raw[low:a]), encode(raw[a:b])
                if k and len(ids[0]) < overlap:
                    # no safe cut far enough back: the halo's first character is as good a start for what is only repeated
                    low, ids = whole, (encode(raw[whole:a]), ids[1])
                offsets = low + np.concatenate(([0], np.cumsum(length[np.array(ids[0] + ids[1], np.int64)])))
                view, begin = data[:b], len(ids[0])
                for n, (s, e, own) in enumerate(cut_tokens(view, offsets, begin, limit, overlap, lambda x, y, raw=raw: len(encode(raw[x:y])))):
                    x, y = int(offsets[s]), int(offsets[e])
                    out.append((d, k, n, base + x, base + y, offset + s - begin, own, raw[x:y].decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["doc_id", "range_no", "piece_no", "start_byte", "end_byte", "token_start", "n_tokens", "text"])

    return wanted.mapInPandas(run, PIECES)


def oversized(docs: DataFrame, limit: int = 2048, overlap: int = 64, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The stitched boundary table of the texts of more than *limit* tokens."""
    size, halo = sizes(limit, overlap, tokenizer)
    return stitch(boundary_table(_texts(docs, doc_id, text, limit, size, halo), limit, overlap, tokenizer), limit)


def split(docs: DataFrame, limit: int = 2048, overlap: int = 64, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The pieces of every text of more than *limit* tokens."""
    size, halo = sizes(limit, overlap, tokenizer)
    ranges = _texts(docs, doc_id, text, limit, size, halo)
    return emit(ranges, stitch(boundary_table(ranges, limit, overlap, tokenizer), limit), limit, overlap, tokenizer)
