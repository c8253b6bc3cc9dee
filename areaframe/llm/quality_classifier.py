"""Quality scores: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

N-grams are taken over the words and over their shapes (kinds of characters; one sign for a
word that its predecessor repeats), so what is odd about a text counts with unknown words too.

Training takes a bounded sample of labelled texts, dealt by hash to a few shards. Each shard
runs FTRL-proximal updates over its texts in its own task; the weights are averaged. What is
shared with the scoring tasks is one vector of SLOTS weights, whatever the input's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.llm.common import documents, text_key, write_table

#: Labelled texts to fit on, about (they are chosen by hash), and texts of one shard.
FIT_ROWS = 32_768
SHARD_ROWS = 4096
SLOTS = 1 << 18
ORDERS = 2
PASSES = 3
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.1
#: Words whose hash a worker remembers.
CACHE_WORDS = 500_000
#: Words that are looked up at once when scoring.
SLICE_WORDS = 400_000


_LOWER = re.compile(rb"[a-z\x80-\xff]+")
_UPPER = re.compile(rb"[A-Z]+")
_DIGIT = re.compile(rb"[0-9]+")


def shape(word: bytes) -> bytes:
    """A word with each run of small letters, capitals and digits as one sign; other signs stay."""
    return _LOWER.sub(b"a", _UPPER.sub(b"A", _DIGIT.sub(b"0", word)))


class _Hashes(dict):
    """Words to the hashes of word and shape, the latter in the high half."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = crc32(word) | crc32(b"\0" + shape(word)) << 32
        return out


_KNOWN = _Hashes()
_AGAIN = np.uint64(1)  # stands for the shape of a word that its predecessor repeats


def slots(words: list[bytes], orders: int = ORDERS) -> list[np.ndarray]:
    """The slots of a text's n-grams of words and of their shapes, order by order."""
    both = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    out = []
    for h in (both & np.uint64(0xFFFFFFFF), np.where(np.append(False, both[1:] == both[:-1])[: len(both)], _AGAIN, both >> np.uint64(32) | np.uint64(1 << 33))):
        mixed = h
        for k in range(orders):
            if k:
                mixed = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
            out.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64) % SLOTS)
    return out


def features(words: list[bytes], orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and their values: counts over the root of all n-grams, so that long texts weigh no more."""
    every = np.concatenate(slots(words, orders)) if words else np.zeros(0, np.int64)
    at, counts = np.unique(every, return_counts=True)
    return at, counts / np.sqrt(max(1, len(every)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """FTRL-proximal over the rows (slots, values, label) in their order; the last weight is the bias."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(at: np.ndarray | slice, bias: bool) -> np.ndarray:
        l1 = 0.0 if bias else L1
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + (0.0 if bias else L2)))

    own = slice(SLOTS, SLOTS + 1)
    for _ in range(passes):
        for at, value, label in rows:
            w, b = weights(at, False), weights(own, True)
            p = 1 / (1 + np.exp(-np.clip(w @ value + b[0], -35, 35)))
            for some, old, g in ((at, w, (p - label) * value), (own, b, np.array([p - label]))):
                more = n[some] + g * g
                z[some] += g - (np.sqrt(more) - np.sqrt(n[some])) / ALPHA * old
                n[some] = more
    return np.append(weights(slice(0, SLOTS), False), weights(own, True)).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, _t, text, label of about ``fit_rows`` labelled texts at most, chosen by a hash of their id.

    A label is a document's mean mark, rounded half up, where it has several; null marks and ids do not count.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("_q")).select(F.col("doc_id").alias("_id"), (F.col("_q") >= 0.5).cast("int").alias("label"))
    marks = write_table(marks, "quality-labels")
    chosen = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) * F.lit(marks.count()) < F.lit(fit_rows << 20)
    some = write_table(marks.where(chosen), "quality-sample")
    # at most about ``fit_rows`` rows of two numbers, as counted
    met = docs.join(F.broadcast(some), docs["doc_id"] == some["_id"])
    return met.withColumn("_t", text_key("text")).groupBy("doc_id", "_t", "label").agg(F.first("text").alias("text"))


def train(sample: DataFrame, orders: int = ORDERS) -> np.ndarray | None:
    """Weights for all slots and the bias from (doc_id, _t, text, label), or None without any row.

    Each shard of about SHARD_ROWS rows is fitted by one task, in an order that only hashes
    decide; the mean of the shards' weights, each by its rows, is the model. The driver gets one
    vector a shard, FIT_ROWS / SHARD_ROWS of them.
    """
    sample = write_table(sample, "quality-fit")
    rows = sample.count()
    if not rows:
        return None
    shards = max(1, round(rows / SHARD_ROWS))

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("_order", "ascending"), ("_t", "ascending")])
        own = [(*features((t or b"").split(), orders), y) for t, y in zip(table.column("text").cast(pa.binary()).to_pylist(), table.column("label").to_pylist(), strict=True)]
        return pa.table({"n": pa.array([len(own)], pa.int64()), "weights": pa.array([fit(own).tobytes()], pa.binary())})

    dealt = sample.withColumns({"_order": F.xxhash64("_t", F.lit(1)), "_shard": F.pmod(F.xxhash64("doc_id", "_t"), F.lit(shards)).cast("int")})
    fitted = dealt.groupBy("_shard").applyInArrow(shard, "n bigint, weights binary").collect()
    return np.average([np.frombuffer(r["weights"], np.float32) for r in fitted], axis=0, weights=[r["n"] for r in fitted]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, *more: str, orders: int = ORDERS) -> DataFrame:
    """doc_id, the columns ``more`` and score: the sigmoid of each text's sparse dot product with the weights."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # SLOTS + 1 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts, out = batch.column("text").cast(pa.binary()), []
            at = 0
            while at < len(texts):
                parts, sizes, held = [], [], 0
                while at + len(sizes) < len(texts) and (held < SLICE_WORDS or not sizes):
                    own = slots((texts[at + len(sizes)].as_py() or b"").split(), orders)
                    parts += own
                    sizes.append(sum(map(len, own)))
                    held += sizes[-1]
                every = np.append(w[np.concatenate(parts)].astype(np.float64), 0.0)
                n = np.array(sizes)
                sums = np.where(n > 0, np.add.reduceat(every, np.cumsum(n) - n), 0.0)
                out.append(1 / (1 + np.exp(-np.clip(sums / np.sqrt(np.maximum(n, 1)) + w[-1], -35, 35))))
                at += len(sizes)
            scores = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *more)] + [scores], ["doc_id", *more, "score"])

    df = docs.select("doc_id", *more, "text")
    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *more)) + ", score double")


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Learns from labelled texts whose crc32(doc_id as text) mod 3 is not 1 (a null id: 0, never
    labelled). Null and empty texts have no n-grams and get the bias alone; without any label all
    scores are 0.5. Repeated rows are scored alike. Nothing but the sample is shuffled.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    df = documents(docs).withColumn("held_out", held)
    weights = train(labelled_sample(df.where("NOT held_out AND text IS NOT NULL"), labels.where(~held), fit_rows))
    out = df.select("doc_id", "held_out", F.lit(0.5).alias("score")) if weights is None else score(df, weights, "held_out")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
