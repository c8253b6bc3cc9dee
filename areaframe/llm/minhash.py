"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A signature has CHUNKS * WIDTH symbols of 16 bits. Two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) symbols differ in at most ERRORS symbols of some chunk (pigeonhole), so
they share a key of that chunk with ERRORS symbols masked: every pair under that signature
distance becomes a candidate. A pair at the threshold misses all chunks with a probability of
about 3e-6 at a similarity of 0.85 and 2e-4 at 0.80. Candidates are confirmed on the full
shingle sets.

The pairs within a bucket are never made. Each class meets the bucket's pivot; buckets whose
other members are then still in several components are settled by what their sets differ in.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.llm.common import compact, documents, parts, sized, text_key, write_table
from areaframe.llm.components import components

SHINGLE = 5
CHUNKS, WIDTH, ERRORS = 12, 8, 1
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: The chunks are laid out for similarities from this one on.
LEAST_PERCENT = 80
#: Rounds of pivots go on while the groups of a shingle hold more open pairs than this a row.
PAIRS_A_ROW = 8
#: Characters of text whose words are hashed at once.
SLICE_CHARS = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and where each text's words end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    flat = pc.list_flatten(split).dictionary_encode()
    names = flat.dictionary.cast(pa.large_binary()).to_pylist()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    there = np.fromiter(map(bool, names), bool, len(names))  # white space at an end splits off an empty word
    at = flat.indices.to_numpy()
    held = there[at]
    return own[at[held]], np.append(0, np.cumsum(held))[np.cumsum(pc.list_value_length(split).to_numpy())]


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles; of the whole sequence if it is shorter."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (chars < SLICE_CHARS or end == at):
            chars += len(texts[end] or "")
            end += 1
        words, ends = _word_hashes([x or "" for x in texts[at:end]])
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if a == b:
                yield np.zeros(0, np.uint64)
                continue
            n = max(1, b - a - size + 1)
            out = np.full(n, min(b - a, size), np.uint64)
            for k in range(min(size, b - a)):
                out = _mix(out * _MIX + words[a + k : a + k + n])
            yield np.unique(out)
        at = end


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return next(shingle_sets([text], size))


def signature(s: np.ndarray, symbols: int = CHUNKS * WIDTH) -> np.ndarray:
    """16 bits of the least value under each permutation."""
    a, b = _permutations(symbols)
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(symbols, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, (low[at : at + 512, None] * a + b).min(axis=0), out=least)
    return (_mix(least.astype(np.uint64) + np.uint64(1)) >> np.uint64(48)).astype("<u2")


def _signed(documents_: DataFrame) -> DataFrame:
    """Row key, n (set size), f1 and f2 (fingerprint of the set) and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, sig = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                n.append(len(s))
                f1.append(int(_mix(s).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(_mix(s ^ _MIX).sum(dtype=np.uint64).view(np.int64)))
                sig.append(signature(s).tobytes() if len(s) else b"")
            numbers = [pa.array(x, pa.int64()) for x in (n, f1, f2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_t"), *numbers, pa.array(sig, pa.binary())], ["doc_id", "_t", "n", "f1", "f2", "sig"])

    kind = dict(documents_.dtypes)["doc_id"]
    return documents_.mapInArrow(run, f"doc_id {kind}, _t bigint, n bigint, f1 bigint, f2 bigint, sig binary")


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The keys of each signature [doc, symbol]: every chunk with every choice of ERRORS symbols masked."""
    parts = sig.reshape(len(sig), CHUNKS, WIDTH).astype(np.uint64)
    keys = []
    for m, masked in enumerate(combinations(range(WIDTH), ERRORS)):
        kept = [i for i in range(WIDTH) if i not in masked]
        h = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(1009) + np.uint64(m + 1), parts.shape[:2])
        for i in kept:
            h = _mix(h * _MIX + parts[:, :, i])
        keys.append(h)
    return np.concatenate(keys, axis=1).view(np.int64)


def _index(classes: DataFrame) -> DataFrame:
    """key, node, n: the multi-index, one row for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(part.num_rows, -1)
                keys = chunk_keys(sig)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(part.column(c).to_numpy(), keys.shape[1])) for c in ("node", "n"))], ["key", "node", "n"])

    return classes.where(F.col("n") > 0).select("node", "n", "sig").mapInArrow(run, "key bigint, node bigint, n bigint")


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """node and text of the classes in ``nodes``, written as a table; no other texts travel."""
    wanted = classes.hint("merge").join(nodes, "node", "left_semi").select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep._t").alias("_t"))
    w = sized(write_table(wanted, f"{name}-nodes"), 60).alias("w")
    d = docs.alias("d")
    texts = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d._t") == F.col("w._t"))).groupBy("node").agg(F.first("text").alias("text"))
    return write_table(texts, f"{name}-texts")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as links (u, v).

    Texts travel only for classes that are in some pair; the side that repeats most, b,
    is joined last and its set is built once for a run of equal b.
    """
    pairs = write_table(pairs, "pairs")
    texts = _texts(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), classes, docs, "pair")
    both = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, b_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, a_set in enumerate(shingle_sets(batch.column("text_a").to_pylist())):
                if b[i] != held:
                    held, b_set = b[i], shingles(batch.column("text_b")[i].as_py())
                both = len(np.intersect1d(a_set, b_set, assume_unique=True))
                if 100 * both >= percent * (len(a_set) + len(b_set) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["u", "v"])

    return write_table(both.mapInArrow(run, "u bigint, v bigint"), "links")


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    return (100 * F.least(F.col(a), F.col(b))) >= (percent * F.greatest(F.col(a), F.col(b)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, _t (hash of the text), n_shingles, component_id, kept.

    Equal sets form one class. In every bucket of the index each class is first compared
    with one pivot, the class with the most company; that joins groups of copies with one
    comparison a class. Buckets in which classes other than the pivot are still apart are
    settled by ``_still_apart``. Texts without words are linked with nothing. Rows with one id
    and different texts are documents of their own that share the id; a null id stays null.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the index is laid out for {LEAST_PERCENT} percent and more")
    d = documents(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_t", text_key(F.col("text")))
    signed = write_table(_signed(d), "signed")
    key = ["n", "f1", "f2"]
    classes = signed.where(F.col("n") > 0).groupBy(*key).agg(F.min(F.struct("doc_id", "_t")).alias("rep"), F.first("sig").alias("sig"), F.min("doc_id").alias("low"))
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # ids are fixed by the written table
    index = compact(write_table(_shared_keys(_index(classes)), "buckets"))

    company = index.groupBy("node").agg(F.sum("size").alias("company"))
    members = index.hint("merge").join(company, "node")
    pivots = members.groupBy("key").agg(F.max(F.struct("company", "node", "n")).alias("p"))
    met = members.hint("merge").join(pivots, "key").where(F.col("node") != F.col("p.node"))
    met = compact(write_table(met.select("key", "node", "n", "company", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "bucket-rows"))
    first = met.where(_similar_sizes("n", "pivot_n", percent)).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _confirmed(first, classes, d, percent)
    group = compact(write_table(components(links), "groups"))

    links = _still_apart(met.select("key", "node", "company"), links, group, classes, d, percent)
    group = compact(write_table(components(links), "groups"))

    named = classes.hint("merge").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.hint("merge").join(least, "root").select(*key, "component_id")
    out = signed.hint("merge").join(named, key, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "_t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _shared_keys(index: DataFrame) -> DataFrame:
    """key, node, n, size: rows of the keys that more than one class has."""
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    sizes = write_table(sizes, "key-sizes")
    return index.join(sized(sizes, 16), "key")


def _families(rows: DataFrame, group: DataFrame) -> DataFrame:
    """family, node, root: the classes of the buckets (key, node, company) whose members are in several components.

    A class's hub is the class with the most company among the pivots of its buckets. Where all classes
    of the buckets of a pivot agree on the hub, they belong to the hub's family, else to the pivot's. So the
    classes of each bucket meet in one family, and families do not chain: their classes
    share a key with one and the same class. Copies share nearly all keys, so the buckets of a pivot are
    put together before families are told: each row of a bucket meets its pivot, and only that.
    """
    n = parts(rows)
    labelled = rows.hint("merge").join(group, "node", "left").coalesce(n).withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.max(F.struct("company", "node")).alias("p")).where("r1 <> r2").select("key", "p")
    known = labelled.hint("merge").join(mixed, "key").select("node", "root", "p", F.col("p.node").alias("pivot")).distinct()
    known = write_table(known, "apart")
    n = parts(known)
    known = known.coalesce(n)
    hubs = known.groupBy("node").agg(F.max("p")["node"].alias("hub"))
    family = known.hint("merge").join(hubs, "node").coalesce(n).groupBy("pivot").agg(F.min("hub").alias("h1"), F.max("hub").alias("h2"))
    family = family.select("pivot", F.when(F.col("h1") == F.col("h2"), F.col("h1")).otherwise(F.col("pivot")).alias("family"))
    return write_table(known.hint("merge").join(family, "pivot").coalesce(n).select("family", "node", "root").distinct(), "families")


def _still_apart(rows: DataFrame, links: DataFrame, group: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``links`` and those between the components of a bucket, from its ``rows`` (key, node, company).

    Within a family the reference is the set of shingles that more than half of its classes
    hold, and each class is known by its difference from that: D, of d shingles. With
    g = (100 + p) d - (100 - p) n, two classes are linked exactly if
    g_x + g_y <= 2 (100 + p) |D_x & D_y|. So classes with g_x + g_y <= 0 are linked with the one
    of least g, and every other link shares a shingle of D. Taking D by frequency, rarest
    first, the first shared one lies early enough to leave room for the rest of the overlap;
    texts with changes of their own meet nobody. Shingles that many share are settled by
    ``_by_pivots`` before their pairs are made.
    """
    nodes = _families(rows, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = list(shingle_sets(part.column("text").to_pylist()))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "own"])

    own = _texts(nodes.select("node").distinct(), classes, docs, "apart").mapInArrow(run, "node bigint, own array<bigint>")
    own = write_table(own.hint("merge").join(nodes, "node"), "apart-sets")
    sizes = own.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    often = own.select("family", F.explode("own").alias("e")).groupBy("family", "e").agg(F.count(F.lit(1)).alias("df"))
    # at most twice as many as a class of the family has on average
    reference = often.hint("merge").join(sizes, "family").where(2 * F.col("df") > F.col("size")).groupBy("family").agg(F.collect_list("e").alias("ref"))
    delta = own.hint("merge").join(reference, "family", "left").withColumn("ref", F.coalesce("ref", F.array().cast("array<bigint>")))
    delta = delta.select("family", "node", "root", F.size("own").cast("long").alias("n"), F.concat(F.array_except("own", "ref"), F.array_except("ref", "own")).alias("delta")).withColumn("d", F.size("delta").cast("long"))
    delta = write_table(delta.withColumn("gap", (100 + percent) * F.col("d") - (100 - percent) * F.col("n")), "apart-deltas")
    centre = delta.groupBy("family").agg(F.min(F.struct("gap", "node", "root")).alias("c"))
    delta = delta.hint("merge").join(centre, "family")
    sure = delta.where((F.col("gap") + F.col("c.gap") <= 0) & (F.col("root") != F.col("c.root"))).select(F.col("node").alias("a"), F.col("c.node").alias("b"))

    least = F.greatest(F.lit(1), F.ceil((F.col("gap") + F.col("c.gap")) / (2 * (100 + percent))), F.col("d") - F.floor((100 - percent) * F.col("n") / percent))
    cut = delta.select("family", "node", "root", "n", "d", "gap", least.alias("least"), F.explode("delta").alias("e"))
    df = cut.groupBy("family", "e").agg(F.count(F.lit(1)).alias("df"))
    cut = cut.hint("merge").join(df, ["family", "e"]).withColumn("rank", F.row_number().over(Window.partitionBy("family", "node").orderBy("df", "e")))
    cut = cut.where((F.col("df") > 1) & (F.col("rank") <= F.col("d") - F.col("least") + 1)).withColumn("room", F.col("d") - F.col("rank") + 1)
    cut = write_table(cut.select("family", "e", "node", "root", "n", "gap", "room"), "apart-prefixes")

    links, cut, sure = _by_pivots(cut, sure, links, classes, docs, percent)
    pairs = _fitting(cut, cut, percent).where(F.col("a") < F.col("b"))
    return links.unionByName(_confirmed(sure.unionByName(pairs).distinct(), classes, docs, percent))


def _fitting(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a shingle and may be similar enough."""
    x, y = (part.select("family", "e", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "root", "n", "gap", "room"))) for side, part in (("a", left), ("b", right)))
    fits = F.col("a_gap") + F.col("b_gap") <= 2 * (100 + percent) * F.least("a_room", "b_room")
    met = x.hint("merge").join(y, ["family", "e"]).where((F.col("a_root") != F.col("b_root")) & _similar_sizes("a_n", "b_n", percent) & fits)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _by_pivots(cut: DataFrame, sure: DataFrame, links: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, prefixes and sure pairs that are left when the shingles' groups are small or no longer shrink.

    In each round every class of a group meets the group's pivot. Then components are
    contracted; the pivot, whose pairs are all settled, and groups within one component go.
    """
    before = None
    while True:
        per = cut.groupBy("family", "e", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("family", "e").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
        total, open_ = per.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
        if not open_ or open_ <= PAIRS_A_ROW * total or (before and open_ > 0.8 * before):
            return links, cut, sure
        before = open_
        pivots = cut.groupBy("family", "e").agg(F.min(F.struct("gap", "node", "root", "n", "room")).alias("p")).select("family", "e", "p.*")
        pivots = write_table(pivots, "apart-pivots")
        first = _fitting(cut, pivots, percent).unionByName(sure).distinct()
        links = links.unionByName(_confirmed(first, classes, docs, percent))
        sure = sure.where("false")
        group = compact(write_table(components(links), "groups"))
        rest = cut.hint("merge").join(pivots.select("family", "e", "node"), ["family", "e", "node"], "left_anti").drop("root")
        rest = rest.hint("merge").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = rest.groupBy("family", "e").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("family", "e")
        cut = write_table(rest.hint("merge").join(several, ["family", "e"]).select(*cut.columns), "apart-prefixes")
