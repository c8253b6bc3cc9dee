"""Line deduplication by pairwise alignment.

A document is compared with the first document that holds each of its runs of shared lines;
runs begin at every line, reach MIN_WORDS words and double in length from there, and are
found by hashes. Each pair is aligned with a patience diff: runs that are unique in both
documents are the anchors, the gaps between them are filled in. Aligned common blocks are
deleted from the later document.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.llm.common import documents, same_row, sized, text_key, write_table

#: Words that an aligned block needs before it is deleted.
MIN_WORDS = 10
#: White space of ASCII, as in the expressions that count lines.
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def line_table(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: row key, k (its number among them), i (its number among all
    lines), h1 and h2 (128-bit hash, white space collapsed), n (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], [[] for _ in range(5)]
            for at, text in enumerate(batch.column("text").to_pylist()):
                k = 0
                for i, line in enumerate(text.split("\n")):
                    if parts := [x for x in _BLANK.split(line) if x]:
                        row.append(at)
                        for c, v in zip(out, (k, i, *_halves(xxhash.xxh3_128_intdigest(" ".join(parts).encode())), len(parts)), strict=True):
                            c.append(v)
                        k += 1
            at = pa.array(row, pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("_t").take(at), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                ["doc_id", "_t", "k", "i", "h1", "h2", "n"],
            )

    df = documents(docs).where(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text")).alias("_t"), "text")
    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, _t bigint, k int, i int, h1 bigint, h2 bigint, n int")


def _halves(h: int) -> tuple[int, int]:
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def shared_lines(lines: DataFrame) -> DataFrame:
    """doc_id, _t and lines: a document's lines that stand in other documents too."""
    key = ["h1", "h2"]
    doc = F.struct("doc_id", "_t")
    more = lines.groupBy(*key).agg(F.min(doc).alias("_first"), F.max(doc).alias("_last")).where(F.col("_first") != F.col("_last")).select(*key)
    # a set: repeated rows of one (id, text) are one document
    return lines.hint("merge").join(more, key).groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set(F.struct("k", "i", "n", *key))).alias("lines"))


def runs(lines: list[tuple[int, int, int, int]], min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(k, size, hash, occ, times) of the runs of consecutive lines (k, n, h1, h2) with enough words.

    From each line the shortest run on and the shortest run back, which together cover every
    longer one, and all runs of 2, 4, 8 ... lines. occ counts the earlier equal runs.
    """
    found, at = [], 0
    while at < len(lines):
        end = at + 1
        while end < len(lines) and lines[end][0] == lines[end - 1][0] + 1:
            end += 1
        part = lines[at:end]
        sums = [0, *accumulate(x[1] for x in part)]
        own = [struct.pack("<qq", x[2], x[3]) for x in part]
        spans = set()
        for s in range(len(part)):
            e = bisect.bisect_left(sums, sums[s] + min_words)
            if e < len(sums):
                spans.add((s, e))
            if sums[s + 1] >= min_words:
                spans.add((bisect.bisect_right(sums, sums[s + 1] - min_words) - 1, s + 1))
        found += [(part[s][0], e - s, xxhash.xxh3_128_intdigest(b"".join(own[s:e]))) for s, e in spans]
        size = 2
        while size <= len(part):
            own = [xxhash.xxh3_128_digest(own[s] + own[s + size // 2] + b"+") for s in range(len(part) - size + 1)]
            found += [(part[s][0], size, int.from_bytes(own[s], "big")) for s in range(len(own)) if sums[s + size] - sums[s] >= min_words and (s, s + size) not in spans]
            size *= 2
        at = end
    times = Counter(x[2] for x in found)
    seen: Counter = Counter()
    out = []
    for k, size, h in sorted(found):
        out.append((k, size, h, seen[h], times[h]))
        seen[h] += 1
    return out


def run_table(shared: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per run of shared lines: row key, k (first line), size (lines), h1, h2, occ, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], [[] for _ in range(6)]
            for at, rows in enumerate(batch.column("lines").to_pylist()):
                for k, size, h, occ, times in runs([(r["k"], r["n"], r["h1"], r["h2"]) for r in rows], min_words):
                    row.append(at)
                    for c, v in zip(out, (k, size, *_halves(h), occ, times), strict=True):
                        c.append(v)
            at = pa.array(row, pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("_t").take(at), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                ["doc_id", "_t", "k", "size", "h1", "h2", "occ", "times"],
            )

    return shared.mapInArrow(run, f"doc_id {dict(shared.dtypes)['doc_id']}, _t bigint, k int, size int, h1 bigint, h2 bigint, occ int, times int")


def overlaps(table: DataFrame) -> DataFrame:
    """One row per later document: the runs it shares with each run's first document.

    The n-th equal run of a document pairs with the n-th of the first document that has as
    many, so every run gives at most one row however many documents hold it, and no pairs
    within a group of copies are made.
    """
    key = ["h1", "h2", "occ"]
    doc = F.struct("doc_id", "_t")
    first = table.groupBy(*key).agg(F.min(F.struct("doc_id", "_t", "k", "times")).alias("o"), F.max(doc).alias("_last"))
    first = first.where(F.struct("o.doc_id", "o._t") != F.col("_last")).drop("_last")
    met = table.hint("merge").join(first, key).where(~(F.struct("doc_id", "_t").eqNullSafe(F.struct("o.doc_id", "o._t"))))
    shared = F.struct("k", "size", F.col("o.doc_id").alias("oid"), F.col("o._t").alias("ot"), F.col("o.k").alias("ok"), ((F.col("times") == 1) & (F.col("o.times") == 1)).alias("unique"))
    return met.groupBy("doc_id", "_t").agg(F.collect_list(shared).alias("shared"))


def _increasing(rows: list[tuple]) -> list[tuple]:
    """The longest run of rows, in order of k, whose ok increases (patience sorting)."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(rows)
    for x, r in enumerate(rows):
        at = bisect.bisect_left(tails, r[1])
        tails[at : at + 1] = [r[1]]
        last[at : at + 1] = [x]
        if at:
            back[x] = last[at - 1]
    out, x = [], last[-1] if last else -1
    while x >= 0:
        out.append(rows[x])
        x = back[x]
    return out[::-1]


def patience(rows: list[tuple]) -> list[tuple]:
    """Align rows (k, ok, unique, ...): anchors first, then what lies in the gaps between them."""
    rows = sorted(rows)
    anchors = _increasing([r for r in rows if r[2]])
    if len(anchors) == len(rows):
        return anchors
    out, at = [], 0
    for a in [*anchors, None]:
        low = out[-1][1] if out else -1
        gap = []
        while at < len(rows) and (a is None or rows[at][0] < a[0]):
            if not rows[at][2] and rows[at][1] > low and (a is None or rows[at][1] < a[1]):
                gap.append(rows[at])
            at += 1
        out += _increasing(gap)
        if a:
            out.append(a)
            at += 1
    return out


def blocks(rows: list[tuple], min_words: int) -> list[tuple[int, int, int]]:
    """(first line, last line, non-blank lines) of the aligned blocks with enough words; rows: (k, ok, unique, i, n)."""
    out, run = [], []
    for r in [*patience(rows), None]:
        if run and (r is None or r[0] != run[-1][0] + 1 or r[1] != run[-1][1] + 1):
            if sum(x[4] for x in run) >= min_words:
                out.append((run[0][3], run[-1][3], len(run)))
            run = []
        if r:
            run.append(r)
    return out


def pairs(found: list[dict], lines: dict[int, tuple[int, int]]) -> list[list[tuple]]:
    """For each partner the rows (k, ok, unique, i, n) to align; a line in several runs goes by the longest."""
    by: dict[tuple, dict[int, tuple]] = {}
    for r in sorted(found, key=lambda r: (r["size"], r["unique"], -r["k"])):
        one = by.setdefault((r["oid"], r["ot"]), {})
        for x in range(r["size"]):
            k, ok = r["k"] + x, r["ok"] + x
            one[k] = (k, ok, r["unique"] or (k in one and one[k][1] == ok and one[k][2]), *lines[k])
    return [list(x.values()) for x in by.values()]


def cuts(met: DataFrame, shared: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, _t and cut: the blocks (s, e, lines) to delete from each later document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows, lines in zip(batch.column("shared").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                place = {x["k"]: (x["i"], x["n"]) for x in lines}
                found.append(sorted({b for x in pairs(rows, place) for b in blocks(x, min_words)}))
            cut = pa.array([[{"s": s, "e": e, "lines": n} for s, e, n in x] for x in found], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("lines", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_t"), cut], ["doc_id", "_t", "cut"])

    df = met.hint("merge").join(shared, same_row(met, shared)).select(met["doc_id"], met["_t"], "shared", "lines")
    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, _t bigint, cut array<struct<s: int, e: int, lines: int>>").where(F.size("cut") > 0)


def dedup(docs: DataFrame, *more: str, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, ``more``, text without the blocks, n_lines, n_removed, n_blocks.

    Documents are ordered by id, then by a hash of the text; repeated rows of one (id, text)
    are one document and keep their lines alike. Null texts stay null, blank lines are never
    compared, and a text that is wholly repeated becomes empty.
    """
    lines = write_table(line_table(docs), "dedup-lines")
    shared = write_table(shared_lines(lines), "dedup-shared")
    cut = write_table(cuts(overlaps(write_table(run_table(shared, min_words), "dedup-runs")), shared, min_words), "dedup-cuts")
    c = sized(cut, 150).alias("c")
    d = documents(docs, *more).withColumn("_t", text_key(F.col("text"))).alias("d")
    df = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d._t") == F.col("c._t")), "left")
    df = df.select("d.doc_id", *(F.col(f"d.{x}") for x in more), F.col("d.text").alias("_x"), F.col("c.cut").alias("cut"))
    left = F.expr("CASE WHEN cut IS NULL THEN _x ELSE array_join(filter(split(_x, '\\n', -1), (l, i) -> NOT exists(cut, b -> i BETWEEN b.s AND b.e)), '\\n') END")
    gone = F.expr("CASE WHEN cut IS NULL THEN 0L ELSE CAST(size(filter(split(_x, '\\n', -1), (l, i) -> l RLIKE '\\\\S' AND exists(cut, b -> i BETWEEN b.s AND b.e))) AS bigint) END")
    total = F.expr("CASE WHEN _x IS NULL THEN 0L ELSE CAST(size(filter(split(_x, '\\n', -1), l -> l RLIKE '\\\\S')) AS bigint) END")
    return df.select("doc_id", *more, left.alias("text"), total.alias("n_lines"), gone.alias("n_removed"), F.coalesce(F.size("cut"), F.lit(0)).alias("n_blocks"))
