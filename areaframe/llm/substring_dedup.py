"""Removal of long byte strings that an earlier document holds.

A string of LENGTH bytes is judged by the least hash among its GRAM-byte substrings, its
minimizer: equal strings have equal minimizers at equal places, so only minimizers are
exchanged. First whole runs of content-defined chunks that an earlier document holds are
settled (repetitive corpora collapse to first occurrences, as in a run-length index). What
remains is sampled at minimizers; those of one hash are gathered with the bytes around them,
and every window over such a place is compared exactly with the windows of earlier documents.

A run-compressed Burrows-Wheeler index over the corpus was not used: see the README.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.llm.common import BROADCAST_BYTES, documents, sized, text_key, write_table

LENGTH = 50
GRAM = 20
SIDE = LENGTH - GRAM
#: Mean distance of chunk borders, and the least one.
CHUNK, CHUNK_LEAST = 256, 64
#: Places of one hash that a task compares in memory; more are dealt out window by window.
GROUP = 100_000
_SLICE = 4 << 20
_PLACE_BITS = 30
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(int(_M), n, 1 << 64))


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` bytes, by doubling (size: 16 or 20)."""
    h, n = data.astype(np.uint64) + np.uint64(1), 1
    four = h
    while n < 16:
        h = h[:-n] * _powers(n) + h[n:]
        n *= 2
        four = h if n == 4 else four
    if size == 20:
        h = h[:-4] * _powers(4) + four[16:]
    return _mix(h)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch with the bytes of its texts in one array, and where each begins and ends."""
    sizes = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        end, total = at + 1, int(sizes[at])
        while end < batch.num_rows and total + sizes[end] <= _SLICE:
            total += int(sizes[end])
            end += 1
        part = batch.slice(at, end - at)
        data = np.frombuffer(b"".join(x.as_py().encode("utf-8") for x in part.column("text")), np.uint8)
        ends = np.cumsum(sizes[at:end]).astype(np.int64)
        yield part, data, ends - sizes[at:end], ends
        at = end


def regions(docs: DataFrame) -> DataFrame:
    """ord, _t, s, e, h1, h2: every run of two neighbouring chunks with a 128-bit hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts, ends in _slices(batch):
                row, s, e, h1, h2 = ([] for _ in range(5))
                marks = np.flatnonzero(_rolling(data, 16) < np.uint64((1 << 64) // CHUNK)) if len(data) >= 16 else np.zeros(0, np.int64)
                marks = marks[np.diff(marks, prepend=-CHUNK_LEAST - 1) >= CHUNK_LEAST]
                buffer = data.tobytes()
                for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    cut = [a, *marks[np.searchsorted(marks, a + CHUNK_LEAST) : np.searchsorted(marks, b - CHUNK_LEAST)].tolist(), b]
                    for k in range(max(1, len(cut) - 2)):
                        x, y = cut[k], cut[min(k + 2, len(cut) - 1)]
                        if y - x >= LENGTH:
                            h = xxhash.xxh3_128_intdigest(buffer[x:y])
                            row.append(i)
                            s.append(x - a)
                            e.append(y - a)
                            h1.append((h >> 64) - (1 << 63))
                            h2.append((h & (1 << 64) - 1) - (1 << 63))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("ord").take(at), part.column("_t").take(at), *(pa.array(v, pa.int64()) for v in (s, e, h1, h2))], ["ord", "_t", "s", "e", "h1", "h2"])

    return docs.mapInArrow(run, "ord bigint, _t bigint, s bigint, e bigint, h1 bigint, h2 bigint")


def settled(docs: DataFrame) -> DataFrame:
    """ord, _t and old: the stretches (s, e, s, e ...) of each document that are such runs of an earlier one."""
    table = write_table(regions(docs), "regions")
    first = table.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where(F.col("first") < F.col("last")).drop("last")
    old = table.hint("merge").join(first, ["h1", "h2"]).where(F.col("ord") > F.col("first"))
    # chunks are longer than a window, so what two overlapping runs hold together is settled too
    return write_table(_merged(old, "old", LENGTH - 1), "settled")


def _merged(stretches: DataFrame, name: str, overlap: int) -> DataFrame:
    """ord, _t and the stretches of each document as a flat array s, e, s, e ...; those that
    overlap by ``overlap`` bytes at least are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts"):
                flat: list[int] = []
                for x in parts.as_py():
                    if flat and x["s"] + overlap <= flat[-1]:
                        flat[-1] = max(flat[-1], x["e"])
                    else:
                        flat += [x["s"], x["e"]]
                out.append(flat)
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("_t"), pa.array(out, pa.list_(pa.int64()))], ["ord", "_t", name])

    parts = stretches.groupBy("ord", "_t").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("parts"))
    return parts.mapInArrow(run, f"ord bigint, _t bigint, {name} array<bigint>")


def _minimizers(part: pa.RecordBatch, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer places of all windows that are not settled: place in the data, hash, document in the part."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h = _rolling(data, GRAM)
    # the hash's high bits, then the place: the least is the leftmost least, wherever the string stands
    bits = np.uint64(_PLACE_BITS)
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    size, low = 1, key
    while size * 2 <= SIDE + 1:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < SIDE + 1:
        low = np.minimum(low[: -(SIDE + 1 - size)], low[SIDE + 1 - size :])
    open_ = np.zeros(len(data) + 1, np.int32)  # windows that lie inside one document, then minus those settled
    long = ends - starts >= LENGTH
    open_[starts[long]] += 1
    open_[ends[long] - LENGTH + 1] -= 1
    olds = part.column("old").to_pylist()
    for a, old in zip(starts.tolist(), olds, strict=True):
        reach = 0  # settled stretches are sorted; their windows are taken off once
        for s, e in zip((old or ())[::2], (old or ())[1::2], strict=True):
            s, e = max(s, reach), e - LENGTH + 1
            if e > s:
                open_[a + s] -= 1
                open_[a + e] += 1
                reach = e
    ok = np.cumsum(open_[:n]) > 0
    place = np.unique(low[:n][ok] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return place, h[place], np.searchsorted(ends, place, side="right")


def _pad(data: np.ndarray, at: np.ndarray, step: int, room: np.ndarray) -> np.ndarray:
    """[place, SIDE] bytes beside each place, 0 beyond the document."""
    k = np.arange(SIDE)
    where = at[:, None] + step * k
    return np.where(k < room[:, None], data[np.clip(where, 0, len(data) - 1)], 0).astype(np.uint8)


def hashes(docs: DataFrame) -> DataFrame:
    """h, ord: the minimizer hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts, ends in _slices(batch):
                _, h, doc = _minimizers(part, data, starts, ends)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(part.column("ord").to_numpy()[doc])], ["h", "ord"])

    return docs.mapInArrow(run, "h bigint, ord bigint")


def places(docs: DataFrame, shared: np.ndarray | None) -> DataFrame:
    """h, ord, _t, pos, left, right: minimizers with the SIDE bytes on each side.

    With ``shared`` (sorted hashes) only those; left is reversed, both end with the document.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value
        for batch in batches:
            for part, data, starts, ends in _slices(batch):
                at, h, doc = _minimizers(part, data, starts, ends)
                if only is not None and len(at):
                    x = np.minimum(np.searchsorted(only, h), max(len(only) - 1, 0))
                    hit = only[x] == h if len(only) else np.zeros(len(h), bool)
                    at, h, doc = at[hit], h[hit], doc[hit]
                pos = at - starts[doc] if len(at) else at
                lroom, rroom = np.minimum(pos, SIDE), np.minimum(ends[doc] - at - GRAM, SIDE) if len(at) else at
                sides = []
                for sub, step, room in ((at - 1, -1, lroom), (at + GRAM, 1, rroom)):
                    flat = _pad(data, sub, step, room)[np.arange(SIDE) < room[:, None]] if len(at) else np.zeros(0, np.uint8)
                    offsets = np.concatenate([[0], np.cumsum(room)]).astype(np.int32)
                    sides.append(pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())]))
                columns = [pa.array(h.view(np.int64)), pa.array(part.column("ord").to_numpy()[doc]), pa.array(part.column("_t").to_numpy()[doc]), pa.array(pos.astype(np.int64)), *sides]
                yield pa.RecordBatch.from_arrays(columns, ["h", "ord", "_t", "pos", "left", "right"])

    return docs.mapInArrow(run, "h bigint, ord bigint, _t bigint, pos bigint, left binary, right binary")


def _window_keys(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows [place, bytes taken from the left], and which of them exist."""
    h = batch.column("h").to_numpy().view(np.uint64)
    prefix, room = [], []
    for c in ("left", "right"):
        column = batch.column(c)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
        grid = np.zeros((len(h), SIDE), np.uint64)
        grid[np.arange(SIDE) < sizes[:, None]] = flat
        out = np.empty((SIDE + 1, len(h)), np.uint64)
        out[0] = h
        for k in range(SIDE):
            out[k + 1] = _mix(out[k] * _M + grid[:, k] + np.uint64(1))
        prefix.append(out)
        room.append(sizes)
    keys = np.empty((SIDE + 1, len(h)), np.uint64)
    there = np.empty((SIDE + 1, len(h)), bool)
    for k in range(SIDE + 1):
        keys[k] = _mix(prefix[0][k] * _M ^ prefix[1][SIDE - k] + np.uint64(k))
        there[k] = (room[0] >= k) & (room[1] >= SIDE - k)
    return keys, there


def _covered(table: pa.Table) -> pa.RecordBatch:
    """Stretches of later documents for whole groups of places."""
    order = np.argsort(table.column("ord").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    keys, there = _window_keys(table)
    doc, pos = table.column("ord").to_numpy(), table.column("pos").to_numpy()
    least, most = np.full(len(doc), SIDE + 1), np.full(len(doc), -1)
    for k in range(SIDE + 1):
        some = np.flatnonzero(there[k])
        _, first, which = np.unique(keys[k][some], return_index=True, return_inverse=True)
        later = some[doc[some] > doc[some[first]][which]]
        least[later] = np.minimum(least[later], k)
        most[later] = k
    hit = np.flatnonzero(most >= 0)  # all these windows hold the place, so they form one stretch
    at = pa.array(hit)
    return pa.RecordBatch.from_arrays([pa.array(doc[hit]), table.column("_t").combine_chunks().take(at), pa.array(pos[hit] - most[hit]), pa.array(pos[hit] - least[hit] + LENGTH)], ["ord", "_t", "s", "e"])


def compare(gathered: DataFrame) -> DataFrame:
    """ord, _t, s, e: stretches that an earlier document holds, from places sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 50_000:
                table = pa.concat_tables(held).combine_chunks()
                h = table.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if cut:
                    yield _covered(table.slice(0, cut))
                held = [table.slice(cut)]
                rows = table.num_rows - cut
        if rows:
            yield _covered(pa.concat_tables(held).combine_chunks())

    return gathered.mapInArrow(run, "ord bigint, _t bigint, s bigint, e bigint")


def compare_hot(gathered: DataFrame) -> DataFrame:
    """The same for hashes with very many places: every window is a row, pre-aggregated by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                keys, there = _window_keys(part)
                k, i = np.nonzero(there)
                doc, t, pos = (part.column(c).to_numpy()[i] for c in ("ord", "_t", "pos"))
                yield pa.RecordBatch.from_arrays([pa.array(keys[k, i].view(np.int64)), pa.array(doc), pa.array(t), pa.array(pos - k)], ["w", "ord", "_t", "s"])

    rows = gathered.mapInArrow(run, "w bigint, ord bigint, _t bigint, s bigint")
    first = rows.groupBy("w").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where(F.col("first") < F.col("last")).drop("last")
    later = rows.hint("merge").join(first, "w").where(F.col("ord") > F.col("first"))
    return later.select("ord", "_t", "s", (F.col("s") + LENGTH).alias("e"))


def _same_surroundings(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches of places whose bytes on both sides an earlier document has too, and the other places.

    The first document of each surrounding stands for it, so what a third of all documents
    share costs one row a task.
    """
    first = found.groupBy("h", "left", "right").agg(F.min("ord").alias("first"))
    met = found.hint("merge").join(first, ["h", "left", "right"])
    s, e = F.col("pos") - F.length("left"), F.col("pos") + GRAM + F.length("right")
    whole = met.where((F.col("ord") > F.col("first")) & (e - s >= LENGTH)).select("ord", "_t", s.alias("s"), e.alias("e"))
    return whole, met.where(F.col("ord") == F.col("first")).drop("first")


def repeated(docs: DataFrame, old: DataFrame) -> DataFrame:
    """ord, _t, cut: all stretches that an earlier document holds, from documents with ord and text."""
    o = sized(old, 100).alias("o")
    d = docs.alias("d")
    df = d.join(o, (F.col("d.ord") == F.col("o.ord")) & (F.col("d._t") == F.col("o._t")), "left").select("d.ord", "d._t", "d.text", "o.old")
    shared = hashes(df).groupBy("h").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where(F.col("a") < F.col("b")).select("h")
    shared = write_table(shared, "shared-hashes")
    if shared.count() * 8 <= BROADCAST_BYTES:
        found = places(df, np.sort(shared.toArrow().column("h").to_numpy().view(np.uint64)))
    else:
        found = places(df, None).hint("merge").join(shared, "h", "left_semi")
    found = write_table(found, "places")
    hot = write_table(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("h"), "hot-hashes")
    h = sized(hot, 16)
    few = found.join(h, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    whole, rest = _same_surroundings(found.join(h, "h", "left_semi"))
    stretches = compare(few).unionByName(whole).unionByName(compare_hot(rest))
    pairs = F.expr("transform(sequence(0, CAST(size(old) DIV 2 AS INT) - 1), i -> named_struct('s', old[2 * i], 'e', old[2 * i + 1]))")
    stretches = stretches.unionByName(old.select("ord", "_t", F.explode(pairs).alias("x")).select("ord", "_t", "x.s", "x.e"))
    return write_table(_merged(stretches, "cut", 0), "stretches")


def _kept(data: bytes, cut: list[int]) -> tuple[list[bytes], int, int]:
    """The parts that stay, the bytes removed, and the runs they form; ``cut`` is flat, sorted and merged."""
    starts, ends = cut[::2], cut[1::2]
    parts = [data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True)]
    return parts, sum(ends) - sum(starts), len(starts)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty. A null id counts as later than every other; rows with equal ids
    do not remove anything from each other. Ids are integers.
    """
    ids = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = ids.withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("_t", text_key(F.col("text")))
    d = ids.select("ord", "_t", "text")
    cut = repeated(d, settled(d))
    c = sized(cut, 100).alias("c")
    i = ids.alias("i")
    df = i.join(c, (F.col("i.ord") == F.col("c.ord")) & (F.col("i._t") == F.col("c._t")), "left").select("i.doc_id", "i.text", "c.cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, removed, spans, sha = ([] for _ in range(5))
            for text, cut in zip(batch.column("text"), batch.column("cut"), strict=True):
                data = text.as_py().encode("utf-8")
                parts, gone, runs = _kept(data, cut.as_py() or [])
                rest = b"".join(parts)
                kept.append(rest)
                size.append(len(data))
                removed.append(gone)
                spans.append(runs)
                sha.append(hashlib.sha256(rest).hexdigest())
            numbers = [pa.array(x, pa.int64()) for x in (size, removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *numbers, pa.array(sha)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
