"""The session's settings that results depend on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Fixed: dates are those of UTC, overlapping maps keep the right side's value.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def build(app: str = "brindle", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    b = b.master(master) if master else b
    for k, v in (SETTINGS | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a Spark application: executors need no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_brindle_shipped", None) == sc.applicationId:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="brindle-"), "brindle_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(path)
    sc._brindle_shipped = sc.applicationId


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of ``spark.checkpoint.dir``, which all nodes share. Where it is unset and there is but one machine, one
    of its own is made; a cluster without it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder: lineage is cut, and no executor's loss costs them. A table, whose size
    Spark knows, unlike a checkpoint's."""
    folder = shared_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
