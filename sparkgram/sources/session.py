"""Sessions with the settings that the operators like."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def on_one_machine(spark: SparkSession) -> bool:
    """Whether all executors are threads of the driver's process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package, whatever folder they start in.

    Workers of this machine get its folder; those of a cluster get the package
    itself, once a session.
    """
    context = spark.sparkContext
    if on_one_machine(spark):
        root = str(_PACKAGE.parent)
        paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, *paths) if x)
    elif not getattr(context, "_ships_sparkgram", False):
        context._ships_sparkgram = True
        archive = Path(tempfile.mkdtemp()) / "sparkgram_package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(_PACKAGE.rglob("*.py")):
                out.write(source, source.relative_to(_PACKAGE.parent))
        context.addPyFile(str(archive))


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkgram")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    importable(spark)
    return spark
