"""A text index: postings of tokens, built once; queries are answered from them and read no text.

Texts are cut into tokens in the JVM, in one pass. Each task writes the postings of its own documents, a row for each token and
place: (segment, token, row, key, place), sorted by token. No posting is exchanged (texts are, once, if the table's files leave few tasks
with most of them), a lookup reads few pages of each file, and a token that most documents have is spread over all files. Each distinct token becomes its lexeme once: the words table, sorted by lexeme,
has (segment, token, lexeme), and a query looks up the tokens of its lexemes first. Stop words are in neither. Each document also has
a row of the empty token with its number of places, which queries of what documents lack start from. Documents that are added later
are segments of their own.

A null text is an empty one; documents without lexemes have their row of the empty token only; keys may repeat or be null, rows
are told apart by numbers of the index.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import fts, tokens
from brindle.session import shared_folder, ship


def all_words(q: fts.Query) -> list[str]:
    """Every lexeme that a query names, negated ones too."""
    if q.op in ("and", "or", "not"):
        return sorted({w for t in q.terms for w in all_words(t)})
    return sorted(set(fts.words_of(q)))


def matches_nothing(q: fts.Query) -> bool:
    """Whether a document that has none of the query's lexemes matches."""
    if q.op == "not":
        return not matches_nothing(q.terms[0])
    if q.op in ("and", "or"):
        return (all if q.op == "and" else any)(matches_nothing(t) for t in q.terms)
    return False


def dictionary(words: DataFrame) -> DataFrame:
    """(token, lexeme) of the distinct tokens of ``words`` (token) that are no stop words."""

    @F.arrow_udf(T.StringType())
    def lexeme(column: pa.Array) -> pa.Array:
        return pa.array([fts.lexeme_of(t) for t in column.to_pylist()], pa.string())

    # few bytes, but much work each: adaptive execution would leave them to one task
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.sparkSession.sparkContext.defaultParallelism)
    return words.distinct().repartition(parts).select("token", lexeme.asNondeterministic()("token").alias("lexeme")).where("lexeme IS NOT NULL")


#: Bytes of text that a task sorts the postings of in memory, and those that a task of its own is worth.
MOST, LEAST = 1 << 26, 1 << 20


def _dealt(docs: DataFrame, text: str) -> DataFrame:
    """The documents, dealt out anew where the files leave a task more than twice its share: a table may be one row group."""
    each = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n"))
    largest, total = (x or 0 for x in each.agg(F.max("n"), F.sum("n")).first())
    parts = max(min(docs.sparkSession.sparkContext.defaultParallelism, total // LEAST), -(-total // MOST), 1)
    return docs.repartition(parts) if largest * parts > 2 * total else docs


def _postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, row, key, place) of the places of all documents but those of stop words, sorted within each task."""
    texts = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.concat(tokens.indexed_tokens(texts), F.array(F.lit(""))).alias("tokens"))
    placed = d.select("row", "key", F.posexplode("tokens").alias("n", "token")).where(~F.col("token").isin(sorted(fts.STOP)))
    # the empty token stands at the end: what is before it are all places
    return placed.select("token", "row", "key", F.when(F.col("token") == "", F.col("n")).otherwise(F.col("n") + 1).alias("place")).sortWithinPartitions("token", "row", "place")


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder that all nodes share."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, folder: str | None = None) -> TextIndex:
        index = cls(docs.sparkSession, folder or shared_folder(docs.sparkSession, "textindex"))
        index._write(docs, key, text, 0)
        return index

    def _write(self, docs: DataFrame, key: str, text: str, segment: int) -> None:
        """The segment's words are those of its postings as written, which are seen once both are there."""
        ship(self.spark)
        staged, final = f"{self.folder}/staged-{uuid.uuid4().hex}", f"{self.folder}/postings/segment={segment}"
        _postings(_dealt(docs, text), key, text).write.parquet(staged)
        words = dictionary(self.spark.read.parquet(staged).select("token").where("token <> ''"))
        words.sortWithinPartitions("lexeme").write.mode("overwrite").parquet(f"{self.folder}/words/segment={segment}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(final).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(path(final).getParent())
        if not files.rename(path(staged), path(final)):
            raise OSError(f"{staged} cannot become {final}")

    def add(self, docs: DataFrame, key: str, text: str) -> None:
        """Index more documents, as a segment. What is found afterwards includes them."""
        last = self.documents().agg(F.max("segment")).first()[0]
        self._write(docs, key, text, 0 if last is None else last + 1)

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    def documents(self) -> DataFrame:
        """(segment, row, key, n_places) of every document."""
        return self.postings.where("token = ''").select("segment", "row", "key", F.col("place").alias("n_places"))

    def forms(self, words: list[str]) -> DataFrame:
        """(token, lexeme) of the indexed tokens whose lexemes are among ``words``."""
        found = self.spark.read.parquet(f"{self.folder}/words").where(F.col("lexeme").isin(words))
        return found.select("token", "lexeme").distinct()  # segments have tokens in common

    def vectors(self, words: list[str]) -> DataFrame:
        """(segment, row, key, v) of the documents that have any of the lexemes, v mapping those that they have to places."""
        forms = self.forms(words)
        # known beforehand, so that the lookup is pushed down to the sorted files
        some = self.postings.where(F.col("token").isin([r.token for r in forms.collect()])).join(F.broadcast(forms), "token")
        by = some.groupBy("segment", "row", "lexeme").agg(F.first("key").alias("key"), F.array_sort(F.collect_list("place")).alias("places"))
        return by.groupBy("segment", "row").agg(F.first("key").alias("key"), F.map_from_entries(F.collect_list(F.struct("lexeme", "places"))).alias("v"))

    def find(self, q: fts.Query) -> DataFrame:
        """(segment, row, key, v) of the documents that match."""
        ws = all_words(q)
        some = self.vectors(ws)
        if matches_nothing(q):
            all_rows = self.documents().select(F.col("segment").alias("s"), F.col("row").alias("r"), F.col("key").alias("k"))
            some = all_rows.join(some, (F.col("s") == F.col("segment")) & (F.col("r") == F.col("row")), "left")
            some = some.select(F.col("s").alias("segment"), F.col("r").alias("row"), F.col("k").alias("key"), F.coalesce("v", F.create_map().cast("map<string,array<int>>")).alias("v"))
        return some.where(fts.matches(F.col("v"), q))

    def search(self, q: fts.Query, ranked_by: fts.Query | None = None) -> DataFrame:
        """(key, rank) of the documents that match; the rank is that of ``ranked_by``, the query itself by default."""
        by = ranked_by or q
        found = self.find(q)
        if not set(all_words(by)) <= set(all_words(q)):
            own = self.vectors(all_words(by)).select(F.col("segment").alias("s"), F.col("row").alias("r"), F.col("v").alias("w"))
            found = found.join(own, (F.col("s") == F.col("segment")) & (F.col("r") == F.col("row")), "left").withColumn("v", F.coalesce("w", F.create_map().cast("map<string,array<int>>")))
        return found.select("key", self.rank(by).alias("rank"))

    @staticmethod
    def rank(q: fts.Query) -> Column:
        return fts.rank(F.col("v"), q)


def _signature(docs: DataFrame) -> tuple:
    """The files that a table is read from: path, length and time of change."""
    spark = docs.sparkSession
    found = []
    for f in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((f, status.getLen(), status.getModificationTime()))
    return tuple(found)


def of_table(docs: DataFrame, key: str, text: str) -> TextIndex:
    """The index of a table that is read from files, built when first asked for and again when a file has changed."""
    spark = docs.sparkSession
    name = (spark.sparkContext.applicationId, key, text, _signature(docs))
    if not name[3]:
        return TextIndex.build(docs, key, text)
    if name not in _KNOWN or not _exists(spark, _KNOWN[name].folder):
        _KNOWN[name] = TextIndex.build(docs, key, text)
    return _KNOWN[name]


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


#: Indexes of this application, by table.
_KNOWN: dict[tuple, TextIndex] = {}
