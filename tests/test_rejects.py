import math
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.operators import rejects as R

LINES = "line_id long, file_id long, line_no int, raw_line string"


def plain_fields(line):
    """Fields of a line read letter by letter, None if its quoting is broken."""
    line = line[:-1] if line.endswith("\r") else line
    out, at = [], 0
    while True:
        if at < len(line) and line[at] == '"':
            at, text = at + 1, ""
            while True:
                if at >= len(line):
                    return None
                if line[at] == '"' and line[at + 1 : at + 2] == '"':
                    text, at = text + '"', at + 2
                elif line[at] == '"':
                    at += 1
                    break
                else:
                    text, at = text + line[at], at + 1
            if at < len(line) and line[at] != "\t":
                return None
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            text, at = line[at:end], end
            if '"' in text:
                return None
        out.append(text)
        if at >= len(line):
            return out
        at += 1


def plain_reason(line, line_no, n_samples):
    fields = plain_fields(line or "")
    if fields is None:
        return "quoting"
    if n_samples is None or len(fields) != 3 + 2 * n_samples:
        return "column_count"
    fields = [f.strip(" ") for f in fields]
    if line_no == 1:
        names = [f.split("/")[-1].replace(".bam", "") for f in fields[3:]]
        first, second = names[0::2], names[1::2]
        bad = "" in first or len(set(first)) < len(first) or [f"{x}-var" for x in first] != second
        return "value" if bad else None

    def number(x):
        return re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", x) and math.isfinite(float(x)) and float(x) >= 0

    fine = fields[0] and re.fullmatch(r"[0-9]+", fields[1]) and int(fields[1]) >= 1 and all(map(number, fields[2:]))
    return None if fine else "value"


def batch(rows):
    names = ["line_id", "file_id", "line_no", "raw_line", "n_samples"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


FIELD = st.one_of(st.text('ab" \t1.é', max_size=4), st.sampled_from(["1", "0", "2.5", "1e3", "-1", "nan", "1e999", '"a\tb"', '"x""y"', '""', "+.5", "7.", " 3 "]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(FIELD, min_size=1, max_size=7), st.sampled_from([1, 2, None]), st.sampled_from([0, 1, 2, None]), st.booleans()), max_size=6))
def test_reasons_equal_those_of_a_plain_reader(lines):
    rows = [(i, 0, no, "\t".join(f) + "\r" * cr, n) for i, (f, no, n, cr) in enumerate(lines)]
    got = R.parse_batch(batch(rows)).column("reason").to_pylist()
    assert got == [plain_reason(raw, no, n) for _, _, no, raw, n in rows]


def test_values_and_names(spark):
    head = "contigName\tcontigLen\ttotalAvgDepth\t/x/a.bam\t/x/a.bam-var\tb\tb-var\r"
    lines = [
        (1, 1, 1, head), (2, 1, 2, '"k ""1"""\t15\t 1.5\t1e1\t0\t2\t3'), (3, 1, 3, None), (4, 1, 4, "x\t0\t1\t1\t1\t1\t1"),
        (5, 2, 2, "c\t9\t1\t1\t1"), (6, 9, 1, "c\t9\t1"), (7, None, None, ""), (8, 2, 1, "h\th\th\ts\tt-var"), (9, 1, 5, "c\t" + "9" * 40 + "\t1\t1\t1\t1\t1"),
        (2, 1, 2, '"k ""1"""\t15\t 1.5\t1e1\t0\t2\t3'),
    ]
    files = spark.createDataFrame([(1, 2, "z"), (1, None, "z"), (2, 1, "y"), (None, 4, "w")], "file_id long, n_samples int, raw_line string")
    parsed = R.parse_lines(spark.createDataFrame([(*r, "more") for r in lines], LINES + ", n_samples string"), files)
    assert {(r.line_id, r.reason) for r in R.rejects(parsed).collect()} == {(3, "column_count"), (4, "value"), (6, "column_count"), (7, "column_count"), (8, "value")}
    rows = sorted(tuple(r) for r in R.coverage_rows(parsed).where("line_id in (2, 5)").collect())
    two = [(2, 1, 'k "1"', 15, None, 1.5, 1, "a", 10.0, 0.0), (2, 1, 'k "1"', 15, None, 1.5, 2, "b", 2.0, 3.0)]
    assert {(r.contig_len, r.long_len) for r in R.coverage_rows(parsed).where("line_id = 9").collect()} == {(None, "9" * 40)}
    assert rows == sorted([*two, *two, (5, 2, "c", 9, None, 1.0, 1, None, 1.0, 1.0)])
    assert [r.contig_len for r in R.coverage_rows(parsed).where("line_id = 9").collect()] == [None, None]


def test_empty_tables(spark):
    parsed = R.parse_lines(spark.createDataFrame([], LINES), spark.createDataFrame([], "file_id long, n_samples int"))
    assert parsed.count() == 0 and R.coverage_rows(parsed).count() == 0


def test_very_long_line():
    long = '"' + "a\t" * 500_000 + '"'
    assert R.parse_batch(batch([(1, 1, 2, long + "\t1\t1", 0), (2, 1, 2, long, 0)])).column("reason").to_pylist() == [None, "column_count"]


def test_record_ends_outside_quotes():
    data = np.frombuffer(b'a\t"x\ny"\nb\n"\n', np.uint8)
    assert R.record_ends(data).tolist() == [7, 9, 12]
    assert R.record_ends(data[:0]).tolist() == []
