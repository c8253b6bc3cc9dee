"""Packing, line dedup, near-duplicates, substring dedup and components against plain Python."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import pytest

from areaframe.llm import components, line_dedup, minhash, packing, queries, substring_dedup
from tests.llm.conftest import SCHEMA, by_id


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
            bins[k] -= items[i]
            go(i + 1, bins)
            bins[k] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    for seed in range(300):
        r = random.Random(seed)
        capacity = r.choice([10, 15, 30])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        left, plan = dict(Counter(items)), packing.Plan(capacity)
        packing.reduce_instance(left, plan)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert plan.sequences + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = packing.pack(docs, path, capacity=256).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 256):
            part = ids[p : p + 256]
            want[(doc_id, p // 256, p, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1 + -(-sum(r["length"] for r in out) * 11 // (10 * 256))
    assert packing.pack(docs.where("false"), path).count() == 0


def test_packing_chunks_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["It's a b \x1c é e ́x", "A<|endoftext|>b <|startoftext|>", "ΣΑΣ ÀB\r\n\tc", "", " ", "don't 'S ' s"]
    for text, got in zip(texts, packing.encode(path, texts), strict=True):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == tok.encode(text, add_special_tokens=False).ids


def test_line_dedup(spark):
    a = [f"alpha {i} line one two three four five six seven" for i in range(6)]
    b = [f"beta {i} line one two three four five six seven" for i in range(4)]
    short = "too short"
    data = [
        (1, "\n".join([*a, short])), (2, "\n".join([b[0], *a[1:4], "", b[1], short])), (3, "\n".join(a)), (4, "\n".join([a[5], a[0], b[3]])),
        (5, None), (6, ""), (3, "\n".join(a)), (None, a[0]), (8, "\n".join([b[2], b[2]])), (9, "\n".join([b[2], b[2], b[2]])),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    got = by_id(line_dedup.dedup(df, "lang"))
    text = {k: v[0]["text"] for k, v in got.items()}
    # a null id sorts before all others, so its line stays and goes from document 1
    assert text[None] == a[0] and text[1] == "\n".join([*a[1:], short])
    assert text[2] == "\n".join([b[0], "", b[1], short])
    assert text[3] == "" and len(got[3]) == 2 and got[3][0] == got[3][1]
    # out of order: lines of different first documents align one by one
    assert text[4] == b[3] and got[4][0]["n_removed"] == 2
    assert text[5] is None and text[6] == "" and text[8] == "\n".join([b[2], b[2]]) and text[9] == b[2]
    assert line_dedup.dedup(df.where("false")).count() == 0


def test_line_dedup_finds_copies_torn_by_other_partners(spark):
    short = [f"p{i} one two three four five" for i in range(9)]
    a, b = (f"{x} one two three four five six seven eight nine ten" for x in ("left", "right"))
    data = [
        (1, "\n".join(["own 1", short[1], "own 2", short[3], "own 3", short[5], "own 4", short[7]])), (2, "\n".join(short)), (3, "\n".join(short)),
        (11, f"{b}\n{a}"), (12, f"{a}\n{b}"), (13, f"{a}\n{b}"),
        # the first line stands once more, before the copied passage
        (4, "\n".join([short[4], "own 5", *short[3:6]])),
    ]
    got = by_id(line_dedup.dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)))
    text = {k: v[0]["text"] for k, v in got.items()}
    assert text[1] == data[0][1] and text[2] == "\n".join(short) and text[3] == "" and got[3][0]["n_removed"] == 9
    assert text[11] == f"{b}\n{a}" and text[12] in (a, b) and text[13] == ""
    assert text[4] == f"{short[4]}\nown 5"


def test_line_runs_cover_every_common_block():
    for seed in range(300):
        r = random.Random(seed)
        lines = [(k, r.randint(1, 12), r.randint(0, 3), 0) for k in range(r.randint(1, 12))]
        got = {(k, k + size) for k, size, *_ in line_dedup.runs(lines, 10)}
        assert all(sum(x[1] for x in lines[s:e]) >= 10 for s, e in got)
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(x[1] for x in lines[s:e]) >= 10:
                    assert {k for x, y in got if s <= x and y <= e for k in range(x, y)} == set(range(s, e))


def test_patience_alignment_is_increasing_and_keeps_anchors():
    for seed in range(200):
        r = random.Random(seed)
        n = r.randint(0, 12)
        rows = [(k, ok, r.random() < 0.5, k, 5) for k, ok in zip(range(n), r.sample(range(20), n), strict=True)]
        got = line_dedup.patience(rows)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        anchors = [x for x in rows if x[2]]
        longest = max((sum(1 for _ in s) for s in [line_dedup._increasing(anchors)]), default=0)
        assert sum(x[2] for x in got) == longest


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs, rows):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    got = by_id(minhash.near_duplicates(docs))
    for i, (doc, s) in enumerate(sets):
        want = least.get(find(i), doc) if s else doc
        assert (got[doc][0]["n_shingles"], got[doc][0]["component_id"]) == (len(s), want), doc
        assert got[doc][0]["kept"] == (doc is None or want == doc)
    assert len(got[7]) == 2
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_chains_of_near_copies(spark):
    """Each copy is near the one before only; all are one component."""
    w = [f"w{i}" for i in range(200)]
    data = []
    for i in range(12):
        data.append((i, " ".join(w), "en", "s", 0))
        w = [*w]
        w[15 * i] = f"new{i}"
    got = by_id(minhash.near_duplicates(spark.createDataFrame(data, SCHEMA)))
    assert {v[0]["component_id"] for v in got.values()} == {0}


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30) if i != 50] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(300, 300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root if x != 300}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def cut(rows):
    first = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def check_cut(spark, rows):
    got = by_id(substring_dedup.dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t, *_ in rows], SCHEMA)))
    last = 1 << 62  # a null id is later than all others
    for want, (i, *_) in zip(cut([(last if i is None else i, t) for i, t, *_ in rows]), rows, strict=True):
        assert want[1:] in [tuple(g[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for g in got[i]], i


def test_substring_dedup(spark, rows):
    check_cut(spark, rows)
    assert substring_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_substring_dedup_of_runs_and_borders(spark, monkeypatch):
    r = random.Random(5)
    base = "".join(r.choice("ab \né") for _ in range(1200))
    data = [(i, base[r.randint(0, 900) :][: r.randint(40, 400)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 80))) + base[: r.randint(0, 120)]) for i in range(30)]
    data += [(50, "a" * 49), (51, "a" * 50), (52, "a" * 51), (53, "b" + "a" * 200), (40, "ab" * 100), (41, "ba" * 100)]
    check_cut(spark, data)


def test_substring_dedup_of_very_frequent_places(spark, monkeypatch):
    """The path for hashes with very many places gives the same."""
    monkeypatch.setattr(substring_dedup, "GROUP", 3)
    r = random.Random(6)
    line = "".join(r.choice("abcdefgh ") for _ in range(130))
    check_cut(spark, [(i, "".join(r.choice("xyzw") for _ in range(40)) + line[r.randint(0, 30) :] + str(i)) for i in range(25)])


def linked_by_brute_force(data):
    sets = [set(minhash.shingles(t[1]).tolist()) for t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(data))}


def families_of_near_copies(size, joints, words=300):
    """Four families of texts just under the threshold, joined by texts that are half of one and half of another."""
    r = random.Random(11)
    names = [f"w{i}" for i in range(3000)]
    origins = [[r.choice(names) for _ in range(words)] for _ in range(4)]
    texts = [list(o) for o in origins for _ in range(size)]
    for _ in range(joints):
        a, b = r.sample(origins, 2)
        texts.append(a[: words // 2] + b[words // 2 :])
    for t in texts:
        for at in r.sample(range(words), words // 100 + 1):
            t[at] = r.choice(names)
    return [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("pairs_a_row", [8, 0])
def test_near_duplicates_in_families_that_chain(spark, monkeypatch, pairs_a_row):
    """Whether pairs are made at once or rounds of pivots go before, against brute force."""
    monkeypatch.setattr(minhash, "PAIRS_A_ROW", pairs_a_row)
    data = families_of_near_copies(30, 30, 100)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == linked_by_brute_force(data)
    assert len(set(got.values())) > 4


def test_near_duplicates_in_a_hot_group_of_unlinked_texts(spark):
    """Copies of one text, most of them too far from each other, against brute force over all pairs."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    origin = [r.choice(words) for _ in range(120)]
    data = []
    for i in range(150):
        t = list(origin)
        for at in r.sample(range(120), r.randint(0, 9)):
            t[at] = r.choice(words)
        data.append((i, " ".join(t), "en", "s", 0))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == linked_by_brute_force(data)
    assert len(set(got.values())) > 20
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame(data[:2], SCHEMA), 50)


def test_line_dedup_takes_other_blanks_for_words(spark):
    long = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, f"{long}\n\u00a0", "en", "s", 0), (2, f"{long}\n\u00a0\nown", "en", "s", 0)], SCHEMA)
    got = by_id(line_dedup.dedup(df))
    assert got[2][0]["text"] == "own" and got[2][0]["n_lines"] == 3 and got[2][0]["n_removed"] == 2
