"""What the operators of this subpackage share: shipping code to executors, durable cuts, text helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import ship

#: Word characters of the contracts are everything but these.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch, about: they are whole documents, and a worker holds a batch and what it makes of it.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this package shipped to the executors' Python workers, and with batches of few documents."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all nodes share. Where it is unset and there is but one machine, one of its
    own is made; a cluster without it is an error, as executors do not see each other's folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder of ``spark.checkpoint.dir``: lineage is cut, and no executor's loss costs them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written as a table in the shared folder and read from it, and its folder. For steps that repeat: unlike a
    checkpoint's, a table's estimated size does not come from the joins that made it, whose product grows with each step."""
    folder = stage_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def apart(c: Column) -> Column:
    """A whole number's negative, to join on. A side that was grouped by the number is not dealt out by this, so both sides are
    exchanged for the join, and adaptive execution can split a hot key."""
    return F.negative(c)


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """The rows as one struct column ``row``, beside the columns that are needed: no other name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def fold(c: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 'null'."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("null"))) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of ``spark.checkpoint.dir``."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
