"""Periodic runs, quality scores and phrase mining against brute force and held-out labels."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from areaframe.llm import periodic_runs, phrase_mining, quality_classifier, queries
from tests.llm.conftest import CLASH, SCHEMA, by_id, prose, vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

# --- periodic runs ---------------------------------------------------------------------------


def runs_of(w, least_words=6, times=4):
    """Every stretch of words that equals itself moved by q and cannot be extended, with its least q."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least_words, times * q) and j > i:
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def planted(doc_id, w):
    h = crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def digest(doc_id, text):
    w = WORDS.findall(text or "")
    w = planted(doc_id, w) if doc_id is not None else w
    runs = runs_of(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[1] and 1000 * best[1] // best[2],
        "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), "collapsed_sha256": sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    }


def test_runs_equal_brute_force_on_random_words():
    r = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 5)):
            w = [bytes([97 + r.randrange(r.choice([1, 2, 3, 6]))]) for _ in range(r.randint(0, 50))]
            if w and r.random() < 0.5:
                a, p = r.randrange(len(w)), r.randint(1, 6)
                w = [w[i] if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i in range(len(w))]
            texts.append(w)
        least, times = r.choice([(6, 4), (2, 4), (9, 5)])
        assert periodic_runs.text_runs(texts, least, times) == [runs_of(w, least, times) for w in texts]


@pytest.fixture
def sf(spark, rows, tmp_path):
    """The small corpus as a folder of tables, with labels for most documents."""
    more = [(200 + i, " ".join(["go"] * n + ["stop", "a", "b"] * m), "en", "s1", 1) for i, (n, m) in enumerate([(5, 1), (6, 4), (30, 3), (1, 40)] * 12)]
    spark.createDataFrame(rows + more, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows) if r[0] is not None], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows + more


def test_periodic_runs_query_equals_brute_force(spark, sf):
    got = by_id(queries.op11_periodic_runs(spark, sf[0]))
    want = {}
    for r in sf[1]:
        want.setdefault(r[0], []).append(digest(r[0], r[1]))
    assert set(got) == set(want) and sum(x["n_runs"] for v in got.values() for x in v) > 40
    for k, v in want.items():
        assert sorted(got[k], key=str) == sorted(v, key=str)


def test_periodic_runs_of_very_long_and_clashing_rows(spark):
    r = random.Random(1)
    long = " ".join(r.choice(vocabulary(3, 50)) for _ in range(60_000)) + " x" * 30_000 + " a b c" * 10_000
    df = spark.createDataFrame([(1, long, "c"), (2, None, "c"), (3, "", "c"), (4, "x x x x x x", "c"), (4, "x x x x x x", "c")], "doc_id int, text string, runs string")
    got = by_id(periodic_runs.find_runs(df))
    assert [(x["start"], x["length"], x["period"]) for x in got[1][0]["runs"][-2:]] == [(60_000, 30_000, 1), (90_000, 30_000, 3)]
    assert [x["n_words"] for x in (got[2][0], got[3][0])] == [0, 0] and got[2][0]["collapsed"] == ""
    assert len(got[4]) == 2 and got[4][0] == got[4][1] and got[4][0]["collapsed"] == "x"
    assert periodic_runs.digest(periodic_runs.find_runs(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, least_times=2)


# --- quality scores --------------------------------------------------------------------------


def labelled(spark, n=600):
    r = random.Random(2)
    good, bad = vocabulary(1, 300), [w.upper() + "!!" for w in vocabulary(4, 300)]
    rows = []
    for i in range(n):
        y = int(r.random() < 0.7)
        rows.append((i, prose(r, good if y else bad, r.choice([1, 20, 80])), "en" if y else "fr", f"s{y}", y))
    docs = spark.createDataFrame([x[:4] + (1,) for x in rows], SCHEMA)
    return docs, spark.createDataFrame([(x[0], x[4]) for x in rows], "doc_id bigint, quality int"), {x[0]: x[4] for x in rows}


def test_quality_scores_on_held_out_labels(spark):
    docs, labels, truth = labelled(spark)
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    held = [i for i in truth if crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    # held-out labels, languages and sources change nothing
    from pyspark.sql import functions as F

    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = quality_classifier.classify(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None)}), labels.withColumn("quality", F.when(odd, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert {r["doc_id"]: r["score"] for r in other.collect()} == {i: r["score"] for i, r in got.items()}


def test_quality_scores_of_odd_rows(spark, docs, none):
    d, labels, _ = labelled(spark, 60)
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (7, 1), (7, 0), (999, 0)], "doc_id bigint, quality int"))
    got = by_id(quality_classifier.classify(docs, labels))
    assert got[100][0]["score"] == got[101][0]["score"] == got[102][0]["score"]  # null, empty and blank: the bias alone
    assert len(got[7]) == 2 and {len(v) for v in got.values()} <= {1, 2}
    assert {r["score"] for r in quality_classifier.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0
    assert set(CLASH) <= set(docs.columns)


def test_quality_model_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SHARD_ROWS", 100)
    docs, labels, truth = labelled(spark)
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels, fit_rows=300).collect()}
    held = [i for i in truth if crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    sample = quality_classifier.labelled_sample(docs, labels, fit_rows=300).count()
    assert 200 < sample < 400


# --- phrases ---------------------------------------------------------------------------------


def phrases_of(rows, least, longest, top, held=50):
    """The definition, phrase by phrase."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(upper, lower))):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (lang, w), a in cands.items():
        if any(y[0] == lang and len(y[1]) > len(w) and any(y[1][i : i + len(w)] == w for i in range(len(y[1]))) and 100 * b >= held * a for y, b in cands.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    result, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return result


@pytest.mark.parametrize("least, longest, top, block", [(3, 3, 2000, 1_000_000), (2, 4, 7, 50), (10, 2, 5, 1)])
def test_phrases_equal_brute_force(spark, docs, rows, least, longest, top, block, monkeypatch):
    monkeypatch.setattr(phrase_mining.occurrences, "__defaults__", (block,))
    monkeypatch.setattr(phrase_mining, "BATCH_ROWS", 64)
    own = rows + [(300 + i, "To be, or NOT to be: that is the question.\tto be\x0bor not to be! ÉTÉ été", lang, None, 1) for i, lang in enumerate(["en", None, "fr"] * 6)]
    df = spark.createDataFrame(own, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in phrase_mining.mine(df, least, longest, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(phrases_of([(r[2], r[1]) for r in own], least, longest, top)) and got


def test_phrases_with_a_full_bitmap(spark, docs, rows, monkeypatch):
    """Bitmaps that let nearly everything through change no result."""
    monkeypatch.setattr(phrase_mining, "BITMAP_BITS", 64)
    got = sorted(tuple(r) for r in phrase_mining.mine(docs, 3, 3, 50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(phrases_of([(r[2], r[1]) for r in rows], 3, 3, 50))


def test_phrases_of_odd_rows(spark, none):
    assert phrase_mining.mine(none).count() == 0
    df = spark.createDataFrame([(None, "en"), ("", "en"), (" \t\n.,", None), ("x " * 200_000, "fr")], "text string, lang string")
    assert [tuple(r) for r in phrase_mining.mine(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()] == [("fr", 1, "x x x", 199_998, 200_000, 199_999, 200_000, 999_985)]


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 3_000_000_019, 3_000_000_037
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(phrase_mining._score("l", "r")).first()[0] == 1_000_000 * a * a // (left * right)
