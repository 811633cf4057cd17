"""Rows that fail to parse: structural indexing of delimited lines.

Every line is looked at as bytes in numpy: a mask of the quotes, its prefix
parity from the line's start, and from these the delimiters (tabs of even
parity) and the record ends (line feeds of even parity). Count and type checks
then make each line a valid row or a row with a reason. No Python code runs
per line, apart from the header lines.

Defined results: a null line is an empty line. A line whose file has no row in
the register, or a null ``n_samples``, fails ``column_count``. A null
``line_no`` is not 1. Repeated rows of the register count once (the largest
``n_samples``). A length of more than 18 digits is valid; it is kept as digits in
``long_len``, and ``contig_len`` is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, TAB, CR, LF = 34, 9, 13, 10
PLAIN = r"^[0-9]{1,300}(\.[0-9]{1,300})?$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PARSED = (
    "line_id long, file_id long, line_no int, reason string, names array<string>, contig string,"
    " contig_len long, long_len string, avg_depth double, depths array<double>, variances array<double>"
)


def record_ends(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) of the records of a delimited byte buffer: line feeds outside quotes."""
    outside = (np.cumsum(data == QUOTE) & 1) == 0
    ends = np.flatnonzero((data == LF) & outside)
    return ends if len(ends) and ends[-1] == len(data) - 1 or not len(data) else np.append(ends, len(data))


def index_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each line's quoting is broken, and its delimiters as (position, line)."""
    quotes = data == QUOTE
    seen = np.concatenate(([0], np.cumsum(quotes)))
    broken = ((seen[ends] - seen[starts]) & 1) == 1

    def lines_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = np.searchsorted(starts, at, "right") - 1
        inside = (line >= 0) & (at < ends[line])
        return at[inside], line[inside]

    at, line = lines_of(np.flatnonzero(quotes))
    if len(at):
        opening = ((seen[at] - seen[starts[line]]) & 1) == 0
        first, last = at == starts[line], at + 1 == ends[line]
        before, after = data[np.maximum(at - 1, 0)], data[np.minimum(at + 1, len(data) - 1)]
        fine = np.where(opening, first | (before == TAB) | (before == QUOTE), last | (after == TAB) | (after == QUOTE))
        broken[line[~fine]] = True
    at, line = lines_of(np.flatnonzero(data == TAB))
    even = ((seen[at] - seen[starts[line]]) & 1) == 0
    return broken, at[even], line[even]


def _fields(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as trimmed strings, without enclosing quotes and with single inner ones."""
    quoted = (end - begin >= 2) & (data[np.minimum(begin, max(len(data) - 1, 0))] == QUOTE) if len(data) else np.zeros(len(begin), bool)
    begin, end = begin + quoted, end - quoted
    edges = np.empty(2 * len(begin), np.int32)
    edges[0::2], edges[1::2] = begin, end
    # elements take turns: a field, then the bytes between it and the next
    both = pa.Array.from_buffers(pa.utf8(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    fields = both.take(pa.array(np.arange(0, len(edges) - 1, 2)))
    if quoted.any():
        fields = pc.replace_substring(fields, '""', '"')
    return pc.utf8_trim(fields, " ")


def _numbers(fields: pa.Array) -> np.ndarray:
    """Doubles, NaN where a field is no finite decimal number of at least 0."""
    plain = pc.match_substring_regex(fields, PLAIN)
    out = pc.cast(pc.if_else(plain, fields, None), pa.float64()).to_numpy(zero_copy_only=False).astype(float)
    rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    if len(rest):
        odd = fields.take(pa.array(rest))
        fits = pc.match_substring_regex(odd, NUMBER).to_numpy(zero_copy_only=False)
        out[rest[fits]] = [float(x) for x in odd.filter(pa.array(fits)).to_pylist()]
    out[~(np.isfinite(out) & (out >= 0))] = np.nan
    return out


def sample_name(field: str) -> str:
    """The sample that a header field names: after the last slash, without ``.bam``."""
    return field.rpartition("/")[2].replace(".bam", "")


def _header(fields: list[str]) -> list[str] | None:
    """The sample names of a header line, None if they are no good."""
    names = [sample_name(x) for x in fields[3::2]]
    if "" in names or len(set(names)) < len(names) or [sample_name(x) for x in fields[4::2]] != [f"{x}-var" for x in names]:
        return None
    return names


def parse_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Columns line_id, file_id, line_no, raw_line, n_samples to the columns of PARSED."""
    raw = pc.fill_null(pc.cast(batch.column("raw_line"), pa.utf8()), "")
    n = len(raw)
    _, offsets, body = raw.buffers()
    edges = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[: edges[-1]] if body is not None and edges[-1] else np.zeros(0, np.uint8)
    starts, ends = edges[:-1], edges[1:].copy()
    if len(data):
        ends -= (ends > starts) & (data[np.maximum(ends - 1, 0)] == CR)
    broken, at, line = index_lines(data, starts, ends)
    count = np.bincount(line, minlength=n) + 1
    wanted = pc.fill_null(batch.column("n_samples"), -2).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + 3
    reason = np.full(n, None, object)
    reason[count != wanted] = "column_count"
    reason[broken] = "quoting"
    kept = np.flatnonzero(reason == None)  # noqa: E711
    names = np.full(n, None, object)
    fields, value = pa.array([], pa.utf8()), np.zeros(0)
    at_name, sizes, odd, even = np.full(n, -1), np.zeros(n, np.int64), np.zeros(0), np.zeros(0)
    if len(kept):
        keep = np.zeros(n, bool)
        keep[kept] = True
        cuts = at[keep[line]]
        owner = np.repeat(np.arange(len(kept)), count[kept])
        first = np.concatenate(([0], np.cumsum(count[kept])[:-1]))
        is_first = np.zeros(len(owner), bool)
        is_first[first] = True
        begin, end = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
        begin[is_first], begin[~is_first] = starts[kept], cuts + 1
        is_last = np.roll(is_first, -1)
        end[is_last], end[~is_last] = ends[kept], cuts
        fields = _fields(data, begin, end)
        number = np.arange(len(owner)) - first[owner]
        head = pc.equal(batch.column("line_no"), 1).fill_null(False).to_numpy(zero_copy_only=False)[kept]
        value = _numbers(fields)
        empty = pc.equal(fields, "").to_numpy(zero_copy_only=False)
        whole = pc.and_(pc.match_substring_regex(fields, "^[0-9]+$"), pc.invert(pc.match_substring_regex(fields, "^0+$")))
        good = np.where(number == 0, ~empty, np.where(number == 1, whole.to_numpy(zero_copy_only=False), ~np.isnan(value)))
        fine = np.logical_and.reduceat(good, first)
        for k in np.flatnonzero(head):
            names[kept[k]] = _header(fields.slice(first[k], count[kept[k]]).to_pylist())
            fine[k] = names[kept[k]] is not None
        reason[kept[~fine]] = "value"
        body = fine & ~head
        at_name[kept[body]] = first[body]
        sizes[kept[body]] = (count[kept[body]] - 3) // 2
        inside = body[owner] & (number >= 3)
        odd, even = value[inside & (number % 2 == 1)], value[inside & (number % 2 == 0)]
    none = at_name < 0
    edges = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())

    def column(shift: int) -> pa.Array:
        return fields.take(pa.array(at_name + shift, pa.int64(), mask=none))

    digits = column(1)
    short = pc.less(pc.utf8_length(digits), 19)
    length, long_length = pc.cast(pc.if_else(short, digits, None), pa.int64()), pc.if_else(short, None, digits)
    average = pa.array(value, pa.float64()).take(pa.array(at_name + 2, pa.int64(), mask=none))
    depths, variances = (pa.ListArray.from_arrays(edges, pa.array(x, pa.float64()), mask=pa.array(none)) for x in (odd, even))
    return pa.RecordBatch.from_arrays(
        [
            *(pc.cast(batch.column(c), t) for c, t in (("line_id", pa.int64()), ("file_id", pa.int64()), ("line_no", pa.int32()))),
            pa.array(reason, pa.string()), pa.array(names, pa.list_(pa.string())), column(0), length, long_length, average, depths, variances,
        ],
        ["line_id", "file_id", "line_no", "reason", "names", "contig", "contig_len", "long_len", "avg_depth", "depths", "variances"],
    )


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Every line with either a ``reason`` or its parsed values (columns of PARSED).

    *lines*: ``line_id, file_id, line_no, raw_line``; *files*: ``file_id,
    n_samples``; further columns are ignored, whatever their names.
    """
    register = files.where("file_id is not null").groupBy("file_id").agg(F.max("n_samples").cast("long").alias("n_samples"))
    sized = lines.select("line_id", "file_id", "line_no", "raw_line").join(register, "file_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield parse_batch(batch)

    return sized.mapInArrow(run, PARSED)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("line_id", "file_id", "line_no", "reason")


def coverage_rows(parsed: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One row per valid line and sample. ``sample_name`` is null where the file's own header was rejected.

    *headers* are the parsed first lines, so that not all lines are parsed again for them.
    """
    heads = (parsed if headers is None else headers).where("names is not null").groupBy("file_id").agg(F.min_by("names", "line_id").alias("names"))
    body = parsed.where("reason is null and depths is not null").select(
        "line_id", "file_id", "contig", "contig_len", "long_len", "avg_depth",
        F.posexplode(F.arrays_zip(F.col("depths").alias("mean"), F.col("variances").alias("var"))).alias("k", "pair"),
    )
    return body.join(heads, "file_id", "left").select(
        "line_id", "file_id", "contig", "contig_len", "long_len", "avg_depth",
        (F.col("k") + 1).alias("sample_no"), F.get("names", F.col("k")).alias("sample_name"),
        F.col("pair.mean").alias("mean_depth"), F.col("pair.var").alias("var_depth"),
    )
