"""Tables written to the folder that all executors share, which end a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkgram.sources.session import importable, on_one_machine

_roots: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the session's ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves if all executors are threads
    of this process; on a cluster it would not be shared, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not on_one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/sparkgram-scratch"
    if not _roots:
        atexit.register(_remove_all, spark)
    root = f"{base.rstrip('/')}/sparkgram-{uuid.uuid4().hex}"
    _roots.add(root)
    return f"{root}/{name}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that nothing reads any more."""
    root = path.rsplit("/", 1)[0]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _roots.discard(root)


def _remove_all(spark: SparkSession) -> None:
    for root in list(_roots):
        try:
            drop_scratch(spark, f"{root}/x")
        except Exception:  # the session may be gone by now
            return


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to scratch Parquet and returns it reread: lineage ends at
    replicated storage, so a lost executor never recomputes what lies before."""
    spark = df.sparkSession
    importable(spark)
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    # the schema is known, so rereading needs no footer
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of tables that ``cut`` made; no plan that is still to run may read them."""
    for table in tables:
        if getattr(table, "_scratch", None):
            drop_scratch(table.sparkSession, table._scratch)
            table._scratch = None
