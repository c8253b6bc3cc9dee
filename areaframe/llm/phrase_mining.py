"""Phrases that occur together, mined set by set: sorted occurrence relations, extended by merge-joins and kept by group counts.

The relation of all word occurrences (language, piece, position, word) is written once, in
blocks of whole pieces sorted by position. A block names each of its words once and holds
the occurrences as numbers; a piece's end takes a position of its own, so neighbours in position
always lie in one piece. The relation of phrases of k words is extended to k + 1 by a merge-join
of sorted positions, after a semi-join with the frequent groups of k words; the groups of
all blocks are then counted.

The semi-join uses bitmaps of fixed size over the frequent groups. They may let through a group
that is not frequent, which the exact count then drops; they never lose one. So their size does not
depend on the data, and neither does the plan; beyond some 50 million frequent groups they let
more through, up to all groups of frequent words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.llm.common import UPPER, sized, write_table

LEAST = 10
LONGEST = 3
TOP = 2000
#: A phrase goes where a longer one holds at least this share of its occurrences, in percent.
HELD = 50
#: Occurrences of one block, and bits of the bitmap of frequent groups.
BLOCK_WORDS = 250_000
BITMAP_BITS = 1 << 26
#: Groups that leave a task at once.
BATCH_ROWS = 50_000
#: Parts into which each language's ranking is split before its first rows are taken.
SALTS = 64

_END = b"\xff"  # no byte of UTF-8 text
_MAP = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t", UPPER.lower().encode() + _END * 10 + b" ")


def _numbers() -> dict[bytes, int]:
    from collections import defaultdict

    out: dict[bytes, int] = defaultdict(count().__next__)
    out[_END]  # a piece's end is number 0
    return out


def occurrences(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of the occurrence relation of (lang, text): lang, words, n (how often each occurs), at (numbers of words, of 2 bytes where these suffice, else of 4).

    Texts are lower-cased in A-Z and split into pieces, these into words. ``words`` begin at number 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def closed(lang: str) -> pa.RecordBatch:
            known, parts = open_.pop(lang)
            del sizes[lang]
            at = np.concatenate(parts)
            n = np.bincount(at, minlength=len(known))[1:]
            at = at.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
            words = pa.array(list(known)[1:], pa.binary()).cast(pa.string())
            columns = [pa.array([lang], pa.string()), pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(n)], pa.array(n, pa.int64())), pa.array([at.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "words", "n", "at"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").translate(_MAP).replace(_END, b" \xff ").split()
                if not words:
                    continue
                known, parts = open_.setdefault(lang, (_numbers(), []))
                parts.append(np.array([known[w] for w in words] + [0], np.int32))
                sizes[lang] = sizes.get(lang, 0) + len(words)
                if sizes[lang] >= block_words:
                    yield closed(lang)
            while sum(sizes.values()) > 4 * block_words:  # very many languages
                yield closed(max(sizes, key=sizes.__getitem__))
            del batch
            pa.default_memory_pool().release_unused()
        for lang in list(open_):
            yield closed(lang)

    return docs.select("lang", "text").mapInArrow(run, "lang string, words array<string>, n array<bigint>, at binary")


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of groups of keys."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _bitmap(places: DataFrame) -> np.ndarray:
    """The bits of all places (place, from 0); what reaches the driver is at most BITMAP_BITS / 64 rows."""
    bit = places.select(F.pmod("place", F.lit(BITMAP_BITS)).alias("bit"))
    bits = bit.groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def _places(groups: DataFrame, keys: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _mixed([batch.column(k).to_numpy() for k in keys]) >> _PLACE
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64))], ["place"])

    return groups.select(*keys).mapInArrow(run, "place bigint")


_PLACE = np.uint64(24)  # a place is the upper 40 bits of a hash


def extend(blocks: DataFrame, frequent: DataFrame, length: int, least: int) -> DataFrame:
    """Groups of ``length`` words that occur ``least`` times: k1, k2, ..., n. Their parts of one word less are in ``frequent``.

    Most groups occur once or twice, so places (hashes of 40 bits) are counted first, in rows a
    third as wide, and only groups in frequent places are counted themselves. A place holds all that its
    groups have, so none that is frequent is lost.
    """
    parts = _bitmap(_places(frequent, [f"k{i + 1}" for i in range(length - 1)]))
    places = _counted(blocks, length, parts).where(F.col("n") >= least)
    return _counted(blocks, length, parts, _bitmap(places)).where(F.col("n") >= least)


def _counted(blocks: DataFrame, length: int, parts: np.ndarray, places: np.ndarray | None = None) -> DataFrame:
    """Counts of groups by place, or, with a bitmap of places, of the groups in these by themselves."""
    keys = [f"k{i + 1}" for i in range(length)]
    shared = blocks.sparkSession.sparkContext.broadcast((parts, places))  # BITMAP_BITS bits each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, places = shared.value

        def kept(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
            b = place % np.uint64(BITMAP_BITS)
            return (bits[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1

        frequent = lambda columns: kept(parts, _mixed(columns) >> _PLACE)
        for batch in batches:
            for i in range(len(batch)):
                names = np.append(np.int64(0), batch.column("keys")[i].values.to_numpy())
                word = np.frombuffer(batch.column("at")[i].as_py(), np.uint16 if len(names) <= 1 << 16 else np.uint32).astype(np.int64)
                # the relation of single words, then of longer groups: sorted positions and group numbers
                where, group, groups = np.flatnonzero(word), word[word > 0], [np.arange(len(names))]
                n = np.zeros(0, np.int64)
                for k in range(1, length):
                    # semi-join with the frequent groups of k words: the prefix here, what follows its first word below
                    if k == length - 1:
                        keep = frequent([names[g] for g in groups])[group]
                        where, group = where[keep], group[keep]
                    # merge-join with the words at the next position
                    later = np.minimum(where + k, len(word) - 1)
                    met = (word[later] > 0) & (later == where + k)
                    where, last = where[met], word[later[met]]
                    pairs = group[met] << 32 | last
                    if k < length - 1:
                        pairs, group = np.unique(pairs, return_inverse=True)
                    else:  # only the counts are needed now
                        pairs.sort()
                        first = np.flatnonzero(np.diff(pairs, prepend=-1))
                        pairs, n = pairs[first], np.diff(first, append=len(pairs))
                    groups = [g[pairs >> 32] for g in groups] + [pairs & 0xFFFFFFFF]
                del word, where, group, pairs, last, met, later
                for low in range(0, len(n), BATCH_ROWS):
                    columns = [names[g[low : low + BATCH_ROWS]] for g in groups]
                    place = _mixed(columns) >> _PLACE
                    keep = frequent(columns[1:])
                    if places is None:
                        columns = [place.astype(np.int64)]
                    else:
                        keep &= kept(places, place)
                    yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns] + [pa.array(n[low : low + BATCH_ROWS][keep], pa.int64())], [*(keys if places is not None else ["place"]), "n"])
                del names, groups, n
            pa.default_memory_pool().release_unused()

    by = ["place"] if places is None else keys
    found = blocks.select("keys", "at").mapInArrow(run, ", ".join(f"{k} bigint" for k in by) + ", n bigint")
    return found.groupBy(*by).agg(F.sum("n").alias("n"))


def _joined(df: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """df with what ``side`` (columns k1, k2, ... and others) says of the group named by the columns ``on``.

    Always sort-merged: one plan at every size.
    """
    keys = [c for c in side.columns if c.startswith("k")]
    side = side.withColumnsRenamed({k: f"_{k}" for k in keys})
    return df.join(side.hint("merge"), [F.col(c) == F.col(f"_{k}") for c, k in zip(on, keys, strict=True)]).drop(*(f"_{k}" for k in keys))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    ``docs`` has lang and text; a null language is ``und``, a null or empty text has no words.
    A phrase occurs at least ``least`` times (a). Cut after one of its words it has parts that
    occur l and r times and the score floor(1000000 * a * a / (l * r)); the cut of the least
    score counts, the first of equals. Phrases of which a longer one holds ``held`` percent are
    dropped. Ties are ordered by a, then by the phrase's bytes. Rows that repeat count each time.

    Words are known by 64-bit hashes that are checked to be different for all words of all
    languages; if two were equal, another seed is taken. Products are decimals of 38 digits,
    exact up to 10^15 occurrences.
    """
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = write_table(occurrences(source), "phrase-occurrences")
    every = blocks.select("lang", F.explode(F.arrays_zip("words", "n")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.n").alias("n"))
    every = write_table(every, "phrase-words")
    for seed in range(16):
        if every.groupBy(_key(seed, F.col("word")).alias("k1")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed tells all words apart")
    named = write_table(every.where(F.col("n") >= least).select(_key(seed, F.col("word")).alias("k1"), "n", "lang", "word"), "phrase-frequent")
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    levels = {1: named.select("k1", "n")}
    numbered = blocks.select(F.transform("words", lambda w: _key(seed, w)).alias("keys"), "at")
    for length in range(2, longest + 1):
        levels[length] = write_table(extend(numbered, levels[length - 1], length, least), f"phrase-groups-{length}")

    out = None
    for length in range(2, longest + 1):
        keys = [f"k{i + 1}" for i in range(length)]
        df = levels[length].withColumnRenamed("n", "a")
        if length < longest:  # one word more is enough: what holds the phrase in still longer ones holds it in one of these
            longer = levels[length + 1]
            sides = [longer.select(*(F.col(f"k{i + 1 + shift}").alias(f"k{i + 1}") for i in range(length)), "n") for shift in (0, 1)]
            most = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.max("n").alias("_most"))
            df = df.join(most.hint("merge"), keys, "left").where(F.coalesce(100 * F.col("_most") < held * F.col("a"), F.lit(True))).drop("_most")
        for i, k in enumerate(keys):  # the words, and how often the first and the last of them occur
            df = _joined(df, named.select("k1", F.col("n").alias(f"n{i}_1"), F.col("word").alias(f"word{i}"), *([F.col("lang")] if i == 0 else [])), [k])
        for size in range(2, length):
            for i in (0, length - size):
                df = _joined(df, levels[size].withColumnRenamed("n", f"n{i}_{size}"), keys[i : i + size])
        cuts = [F.struct(_score(f"n0_{k}", f"n{k}_{length - k}").alias("score"), F.lit(k).alias("k"), F.col(f"n0_{k}").alias("l"), F.col(f"n{k}_{length - k}").alias("r")) for k in range(1, length)]
        df = df.withColumn("_cut", F.array_min(F.array(*cuts)))
        df = df.select("lang", F.concat_ws(" ", *(f"word{i}" for i in range(length))).alias("phrase"), "a", "_cut.l", "_cut.r", "_cut.score")
        out = df if out is None else out.unionByName(df)
    # the best of each part of a language first, so that a language with most phrases is no single sort
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = out.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(sized(write_table(totals, "phrase-totals"), 40), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _key(seed: int, word: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.col("lang"), word)


def _score(left: str, right: str) -> Column:
    whole = "CAST({} AS DECIMAL(16, 0))".format
    return F.expr(f"CAST(CAST(1000000 AS DECIMAL(7, 0)) * ({whole('a')} * {whole('a')}) div ({whole(left)} * {whole(right)}) AS BIGINT)")
