"""Shared pieces of the text operators: joins with hot keys, bounded samples, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.sources.stored import let_go, ship, stored

__all__ = ["SPACE", "WORD", "as_bytes", "beside", "bucket_of", "chunks", "labelled_sample", "let_go", "partitions", "sampled", "ship", "stored", "table_path"]

#: Java pattern of one ASCII white-space character, and its complement a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the contract's folds. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def beside(rows: DataFrame, table: DataFrame, keys: list[str], size: str, spread: int = 1000) -> DataFrame:
    """``rows`` with their key's row of a stored table, whose ``size`` is the number of rows of that key.

    Keys that hold over one in ``spread`` of all rows are at most so many: they are broadcast, so that no task gets all rows
    of one. The others are joined as Spark chooses.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * spread > F.lit(total)
    often, rare = table.where(hot).drop(size), table.where(~hot).drop(size)
    return rows.join(F.broadcast(often), keys).unionByName(rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rare, keys))


def chunks(batches: Iterable[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``most`` bytes of text, at least one row each."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    elif pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def sampled(rows: DataFrame, by: list[str], most: int, most_mb: int) -> list:
    """Rows (id, text, ...) to learn from, collected: at most ``most`` ids in each group of ``by`` in the order of a hash of
    the id, one row each (the smallest text), and as many in that order as have ``most_mb`` MB of text together."""
    others = [c for c in rows.columns if c not in ("id", "text", *by)]
    rows = rows.where("id is not null and text is not null").groupBy(*by, "id").agg(F.min(F.struct("text", *others)).alias("r")).select(*by, "id", "r.*")
    order = [F.xxhash64("id"), F.col("id")]
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("k") <= most).drop("k")
    # one task, of at most ``most`` rows for each group
    rows = rows.withColumn("mb", F.sum(F.octet_length("text") / (1 << 20)).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where(F.col("mb") <= most_mb)
    return sorted(rows.drop("mb").collect(), key=lambda r: (r["id"], r["text"]))


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str, folds: int, most: int, most_mb: int = 256) -> list[tuple[str, int]]:
    """At most ``most`` (text, label) pairs, and ``most_mb`` MB of text, whose fold is not 0, in the order of a hash of the id.

    Only ids and labels are ranked; the ids (bounded by ``most``) are broadcast to fetch the texts. An id counts once, by its
    smallest text and largest label.
    """
    ids = (
        labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (bucket_of(F.col("id"), folds) != 0))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where(bucket_of(F.col("id"), folds) != 0).join(F.broadcast(ids), "id")
    return [(r["text"], r["y"]) for r in sampled(rows, [], most, most_mb)]
