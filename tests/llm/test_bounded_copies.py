"""What a task of the tile join holds at once, however many blocks a row has to meet."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from seqloom.llm import cells


class Rows:
    """Stands for a table: keeps the function that would run over its batches."""

    columns = ("id", "vec")
    sparkSession = SimpleNamespace(conf={"spark.sql.shuffle.partitions": "4"})  # noqa: N815

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def test_copies_go_out_in_bounded_batches():
    dims, blocks = 136, 60
    x = np.random.default_rng(1).normal(0, 1e-3, (2000, dims))
    axes = np.zeros((1, dims))
    axes[0, 0] = 1
    cuts = [np.quantile(x[:, 0], np.arange(1, blocks) / blocks)]
    # the radius spans all stretches, so every row goes to every pair of its block
    c = cells.Cells(np.zeros((0, dims)), np.zeros((0, 0)), 0.0, 1.0, axes, cuts, [np.arange(blocks + 1)])
    rows = Rows()
    cells.blocks(rows, c, dims)
    flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, dtype=np.int32), pa.array(x.ravel()))
    out = list(rows.run(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), flat], ["id", "vec"])])))
    assert max(b.nbytes for b in out) < 16e6
    got = pa.Table.from_batches(out)
    assert got.num_rows == 2000 * blocks
    assert sorted(i for ids in got["ids"].to_pylist() for i in ids) == list(range(2000))
    met = set(zip(got["cls"].to_pylist(), got["bi"].to_pylist(), got["bj"].to_pylist(), strict=True))
    assert len(met) == got.num_rows


def test_copies_of_a_vector_split_no_block(spark):
    hot, others = [0.5] * 6, np.random.default_rng(2).uniform(0, 3, (40, 6)).tolist()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*others, *[hot] * 3000])], "id long, vec array<double>").coalesce(1)
    c = cells.fitted(rows, 0.1, 6, 64)
    assert max(int(np.diff(f).max()) for f in c.firsts) == 1
