"""Session settings, shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()


def build_session(master: str | None = None, app: str = "seqloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; *conf* (``a__b`` for ``a.b``) wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master may go without the setting; it then gets a temporary
    folder. On a cluster a missing setting is an error, since a folder of one
    machine would be lost with it.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="seqloom-")).as_uri()
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(path: str) -> None:
    """Takes a folder of kept tables away when the program ends, through Spark while it still runs."""
    if path.startswith("file:"):
        shutil.rmtree(urlparse(path).path, ignore_errors=True)
        return
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone, with its folder
        return


def cut(df: DataFrame) -> DataFrame:
    """*df*, computed once and kept as a table in the shared folder, so that losing an executor loses nothing.

    A table rather than ``checkpoint()``: the plan that reads it starts anew, while
    a checkpoint hands on the constraints of the plan that made it, which double
    with every join of an iteration. Files are removed by ``release``, or else when
    the program ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of kept tables (what ``cut`` returned; others are left alone) that no plan will read again."""
    for df in tables:
        path = df.__dict__.pop("_kept_at", None)
        if path:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
