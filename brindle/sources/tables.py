"""Tables in and out: scans, series, exports, key-value stores, static checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.operators.writes import once_per_key

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES[:8]) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def series(spark: SparkSession, a: int, b: int) -> DataFrame:
    """Integers from a to b, both included."""
    return spark.range(a, b + 1).withColumnRenamed("id", "n")


def dates(spark: SparkSession, a: str, b: str, step: str = "interval 1 day") -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{a}', DATE'{b}', {step})) AS day")


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    """Statements between semicolons, in order."""
    return [spark.sql(s) for s in script.split(";") if s.strip()]


def as_json_array(df: DataFrame) -> DataFrame:
    """One row with all rows as one JSON array: for small results; as_json_lines has no such bound."""
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("json"))


def as_json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Generated columns: stored if the result is written, virtual if it is a view."""
    return df.withColumns(columns)


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")


def functions(spark: SparkSession) -> DataFrame:
    """The catalog of functions: (name, namespace, temporary, kind), namespace null for those of none."""
    rows = [(f.name, ".".join(f.namespace) if f.namespace else None, f.isTemporary, (f.className or "").rpartition(".")[2]) for f in spark.catalog.listFunctions()]
    return spark.createDataFrame(rows, "name string, namespace string, temporary boolean, kind string")


def namespaces(spark: SparkSession) -> DataFrame:
    """(namespace, catalog) of the databases."""
    return spark.createDataFrame([(d.name, d.catalog) for d in spark.catalog.listDatabases()], "namespace string, catalog string")


def contract(df: DataFrame, ddl: str) -> DataFrame:
    """The frame, if its columns and types are as declared; else an error before anything runs."""
    want, have = StructType.fromDDL(ddl), df.schema
    a, b = [(f.name, f.dataType) for f in want], [(f.name, f.dataType) for f in have]
    if a != b:
        raise TypeError(f"declared {a}, got {b}")
    return df


def introspect(df: DataFrame) -> list[dict]:
    return df.schema.jsonValue()["fields"]


class StateStore:
    """A keyed store as an immutable table (key, value, version); each change is a new store."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def of(cls, spark: SparkSession) -> StateStore:
        return cls(spark.createDataFrame([], "key string, value string, version bigint"))

    def save(self, items: DataFrame) -> StateStore:
        """Items (key, value): put, and count the version up. An error when it runs if a key is put twice."""
        items = once_per_key(items, ["key"], "save")
        old = self.rows.select(F.col("key").alias("__k"), F.col("version").alias("__v"))
        new = items.join(old, F.col("key") == F.col("__k"), "left").select("key", "value", (F.coalesce("__v", F.lit(0)) + 1).alias("version"))
        return StateStore(self.rows.join(items.select("key"), "key", "left_anti").unionByName(new))

    def get(self, keys: DataFrame) -> DataFrame:
        """A row for each key; a missing one reads as empty."""
        return keys.join(self.rows, "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("version", F.lit(0)).alias("version"))

    def delete(self, keys: DataFrame) -> StateStore:
        return StateStore(self.rows.join(keys.select("key"), "key", "left_anti"))


def numbered(df: DataFrame, keys, order) -> DataFrame:
    """1-based place within each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


class FolderStore(StateStore):
    """The same store kept in a folder: a change is a new folder beside the old one."""

    def __init__(self, spark: SparkSession, folder: str, version: int = 0):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        if version == 0:
            super().__init__(StateStore.of(spark).rows)
        else:
            super().__init__(spark.read.parquet(f"{self.folder}/{version}"))

    def _next(self, store: StateStore) -> FolderStore:
        store.rows.write.parquet(f"{self.folder}/{self.version + 1}")
        return FolderStore(self.spark, self.folder, self.version + 1)

    def save(self, items: DataFrame) -> FolderStore:
        return self._next(super().save(items))

    def delete(self, keys: DataFrame) -> FolderStore:
        return self._next(super().delete(keys))


def fields(df: DataFrame) -> DataFrame:
    """The schema as rows (place, name, kind, nullable)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, kind string, nullable boolean")


def append(df: DataFrame, folder: str) -> DataFrame:
    """INSERT ... SELECT: the rows are added to a folder; returned is all that it has."""
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def sizes(df: DataFrame) -> DataFrame:
    """(file, bytes) of a table's files, the largest first."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct().orderBy(F.desc("bytes"), "file")


def aligned(df: DataFrame) -> DataFrame:
    """Each row as one line of columns as wide as their longest value, headings included: (line)."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    wide = text.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(f"__{c}") for c in df.columns])
    return text.crossJoin(F.broadcast(wide)).select(F.rtrim(F.concat_ws("  ", *[F.rpad(c, F.col(f"__{c}"), F.lit(" ")) for c in df.columns])).alias("line"))  # one row


def emit(df: DataFrame):
    """Rows one by one, as dictionaries, a partition at a time."""
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)
