"""Named queries with declared columns: each checks its result's schema before anything runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import contract

AUTHOR = "id bigint, name string, city string"
BOOK = "id bigint, author_id bigint, title string, year int"
PER_CITY = "city string, n bigint"


def authors(t) -> DataFrame:
    """Customers, as authors of a city."""
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return contract(j.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("city")), AUTHOR)


def books(t) -> DataFrame:
    """Orders, as books of their customers."""
    return contract(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year")), BOOK)


def _next(rows: DataFrame) -> DataFrame:
    return rows.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))


def create_author(rows: DataFrame, name: str, city: str) -> tuple[DataFrame, DataFrame]:
    """(authors, the one that was made)."""
    one = contract(_next(rows).select("id", F.lit(name).alias("name"), F.lit(city).alias("city")), AUTHOR)
    return rows.unionByName(one), one


def get_author(rows: DataFrame, author: int) -> DataFrame:
    return contract(rows.where(F.col("id") == author), AUTHOR)


def add_book(rows: DataFrame, author: int, title: str, year: int) -> tuple[DataFrame, DataFrame]:
    """(books, the one that was added)."""
    one = contract(_next(rows).select("id", F.lit(author).cast("long").alias("author_id"), F.lit(title).alias("title"), F.lit(year).alias("year")), BOOK)
    return rows.unionByName(one), one


def books_by_author(rows: DataFrame, author: int, since: int) -> DataFrame:
    return contract(rows.where((F.col("author_id") == author) & (F.col("year") >= since)).orderBy("year", "id"), BOOK)


def count_books_per_city(rows: DataFrame) -> DataFrame:
    return contract(rows.groupBy("city").agg(F.count(F.lit(1)).alias("n")), PER_CITY)
