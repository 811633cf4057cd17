import importlib
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import canonical

DATA = Path("/root/testdata/sf0.001")
MODULES = (entry.relational, entry.vectors, entry.files, entry.general)
CORE = [name for m in MODULES for name in m.QUERIES if name in m.ORACLE]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CORE) <= set(entry.queries())


def test_core_imports_nothing_of_the_llm_package():
    root = Path(entry.__file__).parent / "seqloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "seqloom.llm" not in path.read_text(), path
    kept = {m: sys.modules.pop(m) for m in [*sys.modules] if m.startswith("seqloom.llm")}
    for m in MODULES:
        importlib.reload(m)
    assert not any(m.startswith("seqloom.llm") for m in sys.modules)
    sys.modules.update(kept)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted((tuple(canonical(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    rel = con.execute(entry.oracle_sql()[name])
    order = sorted(range(len(rel.description)), key=lambda i: rel.description[i][0])
    assert cols == [rel.description[i][0] for i in order]
    assert rows == sorted((tuple(canonical(r[i]) for i in order) for r in rel.fetchall()), key=repr)
