"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Only the number of pieces of each length matters for the packing, and there are at most
``capacity`` lengths. So the plan is made from that histogram, whose size does not depend
on the data: sets that provably dominate every alternative are fixed first, the rest is
packed best-fit decreasing, many equal bins in one step. Spark then ranks the pieces of
each length and looks their places up in the plan.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.llm.common import write_table

CAPACITY = 4096
END_ID = 1
#: Parts of chunks whose ids a worker remembers, in each of two generations, and the longest of them.
CACHE_PARTS = 150_000
CACHE_CHARS = 32
#: Characters of text that are encoded at once.
SLICE_CHARS = 4 << 20

# The tokenizer drops white space and pre-tokenizes without looking across it, so the ids of a
# text are those of its chunks in order. Inside a chunk of ASCII and precomposed Latin letters it
# encodes each of these parts on its own; special tokens are found before that, so chunks that may
# hold one stay whole. Both patterns are RE2's.
_LATIN = r"\x{df}-\x{f6}\x{f8}-\x{17e}"
_PLAIN = r"^[\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17e}]*$"
_PARTS = rf"('s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^0-9a-z{_LATIN}]+)"
_SPECIAL = "<|"
#: What the last token of every part ends with.
_WORD_END = "</w>"


def _plain(chunks: pa.Array) -> pa.Array:
    return pc.and_not(pc.match_substring_regex(chunks, _PLAIN), pc.match_substring(chunks, _SPECIAL))


def _gather(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``values``, whose runs have these sizes, one after the other; and the sizes taken."""
    begin, each = (np.cumsum(sizes) - sizes)[at], sizes[at]
    ends = np.cumsum(each)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + each, each)], each


class Encoder:
    """A tokenizer that encodes every part of a chunk once while it is remembered."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _single(self, some: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _parts(self, new: list[str]) -> Iterator[bytes]:
        """Ids of parts, encoded 500 together and cut where a part's last token stands."""
        for at in range(0, len(new), 500):
            group = new[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(group):
                yield from self._single(group)
                continue
            flat = ids.tobytes()
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                yield flat[a:b]

    def parts(self, some: pa.Array) -> list[bytes]:
        """The little-endian 32-bit ids of distinct parts and whole chunks."""
        names = some.to_pylist()
        out = [self.known.get(p) or self.older.get(p) for p in names]
        missing = [i for i, x in enumerate(out) if x is None and names[i]]
        single = _plain(some.take(pa.array(missing, pa.int64()))).to_pylist()
        for kind, encoded in ((True, self._parts), (False, self._single)):
            which = [i for i, plain in zip(missing, single, strict=True) if plain is kind]
            for i, ids in zip(which, encoded([names[i] for i in which]), strict=True):
                out[i] = ids
        if len(self.known) > CACHE_PARTS:  # what was not met since the last time is forgotten
            self.known, self.older = {}, self.known
        self.known.update((p, x) for p, x in zip(names, out, strict=True) if x and len(p) <= CACHE_CHARS)
        return [x or b"" for x in out]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text ends."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        flat = pc.list_flatten(split).dictionary_encode()
        chunks = flat.dictionary
        spaced = pc.replace_substring_regex(pc.utf8_lower(chunks), _PARTS, r"\1 ")
        inner = pc.ascii_split_whitespace(pc.if_else(_plain(chunks), spaced, chunks))
        parts = pc.list_flatten(inner).dictionary_encode()
        own = self.parts(parts.dictionary)
        ids, sizes = _gather(np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4, parts.indices.to_numpy())
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(pc.list_value_length(inner).to_numpy())]  # of the chunks
        ids, sizes = _gather(ids, np.diff(ends, prepend=0), flat.indices.to_numpy())
        return ids, np.append(0, np.cumsum(sizes))[np.cumsum(pc.list_value_length(split).to_numpy())]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker: tokenizers that are made and dropped task by task leave memory behind."""
    return Encoder(path)


def encode(path: str, texts: list[str]) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text."""
    ids, ends = encoder(path).texts(texts)
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        yield ids[a:b].tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A null or empty text is the end id alone. Only documents longer than ``capacity`` are cut.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (size < SLICE_CHARS or stop == at):
                    size += len(texts[stop])
                    stop += 1
                ids, ends = own.texts(texts[at:stop])
                row, piece, start, length, crc = ([] for _ in range(5))
                begin = 0
                for i, e in enumerate(ends.tolist(), at):
                    buffer = ids[begin:e].tobytes() + end
                    begin = e
                    for k, p in enumerate(range(0, len(buffer), 4 * capacity)):
                        part = buffer[p : p + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(p // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                at = stop
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Plan:
    """Where the pieces of each length go: runs of (length, first rank, first sequence, copies a sequence, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self._rank: dict[int, int] = {}

    def put(self, length: int, first: int, copies: int, offset: int, bins: int) -> None:
        rank = self._rank.get(length, 0)
        self.runs.append((length, rank, first, copies, offset))
        self._rank[length] = rank + copies * bins

    def fix(self, lengths: list[int], bins: int) -> None:
        """Open ``bins`` sequences that hold exactly these lengths."""
        offset = 0
        for x in lengths:
            self.put(x, self.sequences, 1, offset, bins)
            offset += x
        self.sequences += bins


def reduce_instance(left: dict[int, int], plan: Plan) -> None:
    """Fix sets that dominate every other set with their largest item; ``left`` keeps the rest.

    For an item j with room R = capacity - j, largest first:
    no other item fits: {j};
    an item of exactly R exists: {j, R}, whatever else could stand with j would fit in R's place;
    no two others fit together: {j, i} with the largest i that fits;
    no three others fit together: {j, i} if i is at least the best pair, or {j, a, b} with the
    largest a that fits, when every pair and every single item fits inside a and b.
    """
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                chosen = _dominating(left, j, plan.capacity - j)
                if chosen is None:
                    break
                times = min(left[x] // chosen.count(x) for x in chosen)
                plan.fix(chosen, times)
                for x in chosen:
                    left[x] -= times
                    if not left[x]:
                        del left[x]
                changed = True


def _dominating(left: dict[int, int], j: int, room: int) -> list[int] | None:
    def count(x: int) -> int:
        return left.get(x, 0) - (x == j)

    if room and count(room) > 0:
        return [j, room]
    small: list[int] = []
    for x in _ascending(left):
        small += [x] * min(3 - len(small), count(x))
        if len(small) == 3 or x > room:
            break
    fits = [x for x in small if x <= room]
    if not fits:
        return [j]
    if len(small) >= 3 and sum(small[:3]) <= room:
        return None
    sizes = [x for x in _ascending(left) if x <= room and count(x) > 0]
    most = sizes[-1]
    if len(small) < 2 or sum(small[:2]) > room:
        return [j, most]
    pair = max((c + d for c in sizes if (d := _largest(sizes, room - c, lambda x, c=c: count(x) > (x == c)))), default=0)
    if most >= pair:
        return [j, most]
    b = _largest(sizes, room - most, lambda x: count(x) > (x == most))
    half = _largest(sizes, room // 2, lambda x: True)
    if b and half and b >= half:
        return [j, most, b]
    return None


def _largest(sizes: list[int], limit: int, ok) -> int:
    return next((x for x in reversed(sizes[: bisect.bisect_right(sizes, limit)]) if ok(x)), 0)


def _ascending(left: dict[int, int]) -> list[int]:
    return sorted(x for x, n in left.items() if n)


def best_fit(left: dict[int, int], plan: Plan) -> None:
    """Best-fit decreasing, one step for all bins with the same room.

    ``room`` maps the room left to runs of sequences (first, bins); each length ends at most
    one run early, so there are never more than a few runs for each length.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def offer(r: int, first: int, bins: int) -> None:
        if r and bins:
            if r not in room:
                room[r] = []
                bisect.insort(rooms, r)
            room[r].append((first, bins))

    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at < len(rooms):
                r = rooms[at]
                first, bins = room[r].pop()
                if not room[r]:
                    del room[r]
                    rooms.pop(at)
            else:
                r = plan.capacity
                bins = -(-n // (r // x))
                first = plan.sequences
                plan.sequences += bins
            each = r // x
            full = min(bins, n // each)
            if full:
                plan.put(x, first, each, plan.capacity - r, full)
                offer(r - each * x, first, full)
                n -= full * each
            used = full
            if full < bins and 0 < n < each:
                plan.put(x, first + full, n, plan.capacity - r, 1)
                offer(r - n * x, first + full, 1)
                n, used = 0, full + 1
            offer(r, first + used, bins - used)


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan, left = Plan(capacity), {k: v for k, v in histogram.items() if v}
    reduce_instance(left, plan)
    best_fit(left, plan)
    return plan


def ranked(table: DataFrame) -> DataFrame:
    """Adds rank: from 0 without gaps among the pieces of each length.

    Pieces of one length are dealt to buckets by a hash and ranked inside them, so a length
    that a third of all rows have is no single task's work. Equal rows may swap ranks.
    """
    spark = table.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    df = table.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    df = df.withColumn("_i", F.row_number().over(inside))
    return df.hint("merge").join(counts, ["length", "_b"]).withColumn("rank", F.col("_before") + F.col("_i") - 1).drop("_b", "_i", "_before")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every piece is placed once; repeated rows and null ids are documents of their own, an
    empty table gives no rows.
    """
    table = write_table(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = make_plan(histogram, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    kinds = dict(table.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            _, first, begin, copies, offset = runs[at].T
            nth = rank - first
            places = [pa.array(begin + nth // copies), pa.array(offset + nth % copies * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *places], [*names, "sequence_id", "offset"])

    schema = f"doc_id {kinds['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked(table).mapInArrow(run, schema)
