"""Periodic runs of words: maximal pairs of each text's suffixes, found bottom-up in its LCP-interval tree.

A run with smallest period q is a stretch of words that equals itself moved by q words and
that no neighbouring word extends. It is the maximal pair of the suffixes at its start and q
words later: what they have in common is the run without its first q words, and the words
before them differ. So runs are read off the tree and nothing has to be extended.

Suffixes of many texts are ordered at once, by doubling the compared length over their
ranks; words of different texts never compare equal, so no match crosses texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_TIMES = 4
#: Words whose suffixes are ordered together; a longer text is taken by itself.
SLICE_WORDS = 400_000


def suffix_ranks(ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per doubling the ranks by the first 1, 2, 4, ... words, and the positions that still share theirs.

    A rank is the number of suffixes that are less, so equal ranks mean equal beginnings and
    later levels only refine the groups that are left.
    """
    n = len(ids)
    todo, rank, shared, ranks = np.arange(n), np.zeros(n, np.int32), [], []
    second, step = ids.astype(np.int64), 0
    while True:
        key = (rank[todo].astype(np.int64) << 32) | second
        order = np.argsort(key, kind="stable")
        todo, key = todo[order], key[order]
        new = np.diff(key, prepend=-1) != 0
        group = np.diff(key >> 32, prepend=-1) != 0
        at = np.arange(len(todo))
        least = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[todo] += least.astype(np.int32)
        ends = np.append(new[1:], True)
        todo = todo[~(new & ends)]
        ranks.append(rank)
        shared.append(todo)
        if not len(todo):
            return ranks, shared
        step = max(1, 2 * step)
        later = todo + step
        second = np.where(later < n, rank[np.minimum(later, n - 1)].astype(np.int64) + 1, 0)


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix of ``order`` has in common with the next one."""
    a, b = order[:-1].copy(), order[1:].copy()
    last, out = len(ranks[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = (np.maximum(a, b) <= last) & (ranks[k][np.minimum(a, last)] == ranks[k][np.minimum(b, last)])
        for x in (a, b, out):
            x[same] += 1 << k
    return out


def maximal_pairs(order: list[int], common: list[int], left: list[int], least_words: int, least_times: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, distance) of the maximal pairs of neighbouring occurrences in an interval
    of the LCP tree whose distance is short enough for a run.

    The intervals are closed bottom-up. Each holds its positions in order, with the word before
    each as its class; the smaller child is merged into the larger, and only positions of
    different children and classes make a pair. Occurrences that overlap by two thirds lie at
    multiples of one period, so a run's two suffixes are neighbours among the positions of their interval.
    """
    far, found = least_times - 1, []

    def merged(a: list[int], b: list[int], words: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        most, least = words // far, least_words - words
        for p in b:
            i = bisect_left(a, p)
            if i < len(a) and least <= a[i] - p <= most and left[a[i]] != left[p]:
                found.append((p, words + a[i] - p, a[i] - p))
            if i and least <= p - a[i - 1] <= most and left[a[i - 1]] != left[p]:
                found.append((a[i - 1], words + p - a[i - 1], p - a[i - 1]))
        if len(b) > 1:
            a.extend(b)
            a.sort()
        else:
            a.insert(bisect_left(a, b[0]), b[0])
        return a

    stack: list[tuple[int, list[int]]] = []
    for p, words in zip(order, [*common, 0], strict=True):
        own = [p]
        while stack and stack[-1][0] > words:
            depth, held = stack.pop()
            own = merged(held, own, depth)
        if stack and stack[-1][0] == words:
            own = merged(stack.pop()[1], own, words) if words else []
        if words:
            stack.append((words, own))
    yield from found


def text_runs(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[list[tuple[int, int, int]]]:
    """Per text (a list of words) its runs (start, length, period), by start, then period."""
    ids: list[int] = []
    starts = []
    for words in texts:
        starts.append(len(ids))
        known: dict[bytes, int] = {}
        base = len(ids)
        ids += [known.setdefault(w, base + len(known)) for w in words]
    best: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    # the least that two suffixes of a run have in common, and the doubling that has compared no more
    least = min(max(least_words - q, (least_times - 1) * q) for q in range(1, least_words + 1))
    level = max(least, 1).bit_length() - 1
    if len(ids) > least:
        numbers = np.array(ids, np.int64)
        ranks, shared = suffix_ranks(numbers)
        if len(shared) > level and len(shared[level]):
            order = shared[level][np.argsort(ranks[-1][shared[level]], kind="stable")]
            common = common_prefixes(order, ranks)
            common[common < least] = 0
            left = np.concatenate([[-1], numbers[:-1]])
            # a text's first word follows nothing, whatever stands before it in the slice
            first = np.array(starts)
            left[first[first < len(left)]] = -1
            held = np.flatnonzero((np.append(common, 0) > 0) | (np.append(0, common) > 0))
            if len(held):
                left_of = left.tolist()
                of = np.searchsorted(first, order, "right") - 1
                whose = dict(zip(order[held].tolist(), of[held].tolist(), strict=True))
                for start, length, period in maximal_pairs(order[held].tolist(), np.append(common, 0)[held][:-1].tolist(), left_of, least_words, least_times):
                    d = whose[start]
                    key = (start - starts[d], length)
                    best[d][key] = min(period, best[d].get(key, period))  # multiples of a period cover the same words
    return [sorted((s, n, q) for (s, n), q in runs.items()) for runs in best]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int32)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period), collapsed.

    A run has at least ``least_words`` words and ``least_times`` periods. ``collapsed`` is the
    text without the words that a run repeats after its first period, joined by one space. A
    null or empty text has no words and an empty ``collapsed``. Rows are independent, so
    nothing is shuffled and repeated rows are answered alike; memory is bounded by an Arrow batch
    and one slice of texts (a few dozen bytes a word).
    """
    if least_words < 2 or least_times < 4:
        raise ValueError("runs of fewer than two words or four periods are not supported")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            at = 0
            while at < len(texts):
                some: list[list[bytes]] = []
                held = 0
                while at + len(some) < len(texts) and (held < SLICE_WORDS or not some):
                    some.append((texts[at + len(some)].as_py() or b"").split())
                    held += len(some[-1])
                runs = text_runs(some, least_words, least_times)
                left = pa.array([_collapsed(w, r) for w, r in zip(some, runs, strict=True)], pa.binary()).cast(pa.string())
                rows = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind)
                ids = batch.column("doc_id").slice(at, len(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in some], pa.int64()), rows, left], ["doc_id", "n_words", "runs", "collapsed"])
                at += len(some)

    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n_words bigint, runs {RUNS}, collapsed string")


def digest(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli) and digests of all."""
    order = """array_sort(runs, (a, b) -> CASE WHEN a.length * b.period > b.length * a.period THEN -1 WHEN a.length * b.period < b.length * a.period THEN 1
        WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1) WHEN a.period <> b.period THEN IF(a.period < b.period, -1, 1) ELSE 0 END)"""
    best = runs.withColumn("_best", F.expr(f"try_element_at({order}, 1)"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
