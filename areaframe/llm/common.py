"""Helpers shared by the training-data operators.

Every operator identifies an input row by ``(doc_id, _t)`` where ``_t`` is a hash of
the text, so null ids and repeated rows have defined results: repeated rows are
answered alike, and rows that share an id but not a text are answered separately.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and is at most this large.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

#: Bytes of rows that a partition of a table of ids is given, see ``compact``.
PARTITION_BYTES = 16 << 20

#: Bytes of a batch that a Python worker is handed. A worker holds a batch several times over (Arrow on both
#: sides, its strings at up to four bytes a character), and keeps its memory for the tasks that follow.
BATCH_BYTES = 4 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words as the contracts of several operators define them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) a temporary one is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this lasts, Arrow batches end at BATCH_BYTES: 10 000 rows with one or two texts may be very large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later stages read files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int = 100, rows: int | None = None) -> DataFrame:
    """Hint the strategy for joining ``df``, which must be cheap to count.

    Broadcast when the counted rows prove it small, sort-merge (which AQE can split
    when a key is skewed) otherwise.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def parts(df: DataFrame, row_bytes: int = 40) -> int:
    """How many partitions the counted rows of the written table ``df``, of ids and numbers, need."""
    return max(1, -(-df.count() * row_bytes // PARTITION_BYTES))


def compact(df: DataFrame, row_bytes: int = 40) -> DataFrame:
    """The written table ``df`` in as many partitions as it needs.

    Joins and groups of a table that fits one partition need no exchange, which spares
    iterative steps hundreds of nearly empty tasks.
    """
    return df.coalesce(parts(df, row_bytes))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, which keeps every code point in its place."""
    return F.translate(text, UPPER, UPPER.lower())


def lower_word(word: Column) -> Column:
    """Lower-case A-Z of a word; the common ASCII word takes the fast built-in."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(lower_ascii(word))


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of the row key, which Spark still runs as an equi-join."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["_t"] == right["_t"])


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and further named columns; a missing further column is null.

    Selecting by name first keeps extra or clashing columns of the input out of the way.
    """
    have = set(df.columns)
    return df.select("doc_id", F.col("text").cast("string").alias("text"), *(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in more))


def prefix_sums(lengths: str) -> str:
    """SQL for the exclusive prefix sums of the array<bigint> column ``lengths``.

    Appending to one accumulator copies it each time; doing so in blocks of 64 keeps
    that copying small for texts with very many matches.
    """
    empty = "cast(array() AS array<bigint>)"
    block = f"""(x, o) -> aggregate(x, named_struct('s', o, 'a', {empty}),
        (acc, v) -> named_struct('s', acc.s + v, 'a', array_append(acc.a, acc.s)), acc -> acc.a)"""
    offsets = f"""aggregate(bl, named_struct('s', 0L, 'a', {empty}),
        (acc, x) -> named_struct('s', acc.s + aggregate(x, 0L, (u, v) -> u + v), 'a', array_append(acc.a, acc.s)), acc -> acc.a)"""
    return f"""CASE WHEN {lengths} IS NULL OR size({lengths}) = 0 THEN {empty} ELSE
      flatten(transform(
        array(transform(sequence(0, CAST((size({lengths}) - 1) DIV 64 AS INT)), b -> slice({lengths}, b * 64 + 1, 64))),
        bl -> flatten(zip_with(bl, {offsets}, {block})))) END"""
