"""Batches of long texts end at a number of bytes, whatever the rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from areaframe.llm.common import BATCH_BYTES, write_table


def test_batches_of_long_texts_are_small(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "size"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 500).alias("a"), F.repeat(F.lit("klmnopqrst"), 500).alias("b"))
    out = write_table(texts.mapInArrow(run, "n bigint, size bigint"), "batch-sizes").collect()
    assert sum(r.n for r in out) == 3000
    assert max(r["size"] for r in out) <= 1.1 * BATCH_BYTES
    assert spark.conf.get(name) == before
