"""Language ID, licences, components of the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from areaframe.llm import langid, licenses, queries
from tests.llm.conftest import SCHEMA, by_id


def kneser_ney(texts, order):
    """Plain interpolated Kneser-Ney over characters: a probability function."""
    counts = Counter()
    for t in texts:
        folded = []
        for c in t.lower():
            c = c if c.isalpha() else " "
            if c != " " or not folded or folded[-1] != " ":
                folded.append(c)
        if folded == [] or folded[-1] != " ":
            folded.append(" ")
        s = " " * (order - 1) + "".join(folded)
        for i in range(len(s) - order + 1):
            counts[s[i : i + order]] += 1
    levels = [counts]
    for _ in range(order - 1):
        up = Counter()
        for g in levels[0]:
            up[g[1:]] += 1
        levels.insert(0, up)

    def p(g, k=order):
        if k == 0:
            return 1 / 0x10000
        level = levels[k - 1]
        ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = min(max(ones / (ones + 2 * twos) if ones + 2 * twos else 0.5, 0.1), 0.95)
        g = g[-k:]
        row = {x: v for x, v in level.items() if x[:-1] == g[:-1]}
        if not row:
            return p(g, k - 1)
        total = sum(row.values())
        return max(row.get(g, 0) - d, 0) / total + d * len(row) / total * p(g, k - 1)

    return p


def test_probabilities_are_kneser_ney(spark):
    texts = ["banana band", "nab a bandana, ban!", "an abba"]
    model = langid.train(spark.createDataFrame([("x", t) for t in texts] + [("y", "zzz zoo")], "lang string, text string"))
    p = kneser_ney(texts, 4)
    for g in ("bana", "nabz", "zzzz", "  ba", "qban", "anda"):
        code = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(g))], np.uint64)
        assert math.isclose(model.scores(code)[0][model.langs.index("x")], math.log2(p(g)), rel_tol=1e-4), g


def test_language(spark, docs, rows):
    got = by_id(langid.identify(docs, "source"))
    right = [got[r[0]][0]["lang_pred"] == r[2] for r in rows if r[0] is not None and r[0] < 60 and len(r[1]) > 30 and not got[r[0]][0]["held_out"]]
    held = [got[r[0]][0]["lang_pred"] == r[2] for r in rows if r[0] is not None and r[0] < 60 and len(r[1]) > 30 and got[r[0]][0]["held_out"]]
    assert all(right) and len(held) > 3 and sum(held) >= 0.9 * len(held)
    for r in rows:
        g = got[r[0]][0]
        assert g["held_out"] == (zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 4 == 2)
        assert (g["lang_pred"] == "und") == (r[1] is None or not any(c.isalpha() for c in r[1])) and 0 <= g["score"] <= 1
    assert langid.identify(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.drop("lang")).collect()} == {"und"}


def test_rejection(spark):
    import random

    r = random.Random(1)
    words = ["the", "cat", "sat", "on", "mats", "with", "other", "hats", "and", "then", "that"]
    data = [(i, " ".join(r.choice(words) for _ in range(80)), "en", "s", 0) for i in range(80)]
    data += [(100, "".join(r.choice("qxzjkv") + r.choice(" wy") for _ in range(300)), None, "s", 0)]
    got = by_id(langid.identify(spark.createDataFrame(data, SCHEMA)))
    assert got[100][0]["rejected"] and not any(got[i][0]["rejected"] for i in range(80))


def test_licences(spark):
    long = " ".join(f"word{i}" for i in range(200))
    data = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", long), (3, "a/b/d.txt", long + "\nLicensed under the Apache License, Version 2.0."), (4, "x/y.txt", long),
        (5, "a/z/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "a/z/q/r.txt", None), (7, None, ""), (8, "a/b/c.txt", long), (9, "a/same.txt", "the license of the cat"),
        (10, "t/LICENSE", "Released under the MIT License."), (11, "t/NOTICE", "Licensed under CC BY-NC 4.0."), (12, "t/u.txt", long),
    ]
    got = by_id(licenses.scan(spark.createDataFrame(data, "doc_id bigint, path string, text string")))
    pick = lambda i: (got[i][0]["license"], got[i][0]["how"], got[i][0]["from_dir"])
    assert pick(1) == ("MIT", "own", None) and pick(3) == ("Apache-2.0", "own", None) and pick(5) == ("GPL-3.0", "own", None)
    assert pick(2) == ("MIT", "inherited", "a") and pick(8) == pick(2) and pick(6) == ("GPL-3.0", "inherited", "a/z")
    assert pick(4) == (None, "none", None) and pick(7) == (None, "none", None) and pick(9) == ("MIT", "inherited", "a")
    assert pick(12) == ("CC-BY-NC-4.0", "inherited", "t")  # a tie goes by name
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, path string, text string")).count() == 0


def test_license_blocks_weigh_terms_by_the_corpus(spark):
    mit = next(t for t in licenses.TEMPLATES["MIT"] if "merchantability" in t.lower()).split()
    apache = max(licenses.TEMPLATES["Apache-2.0"], key=len).split()
    wrap = lambda words, lead: "\n".join(lead + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    data = [
        (1, "p/a.c", "/*\n" + wrap(apache, " * ") + "\n */\nint main() { return zero; }\nint other() { return one; }"), (2, "q/LICENSE", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + wrap(mit, "")),
        (3, "r/a.py", "# Foobar is licensed under the MIT License."), (4, "s/README", "This project is released under the MIT License."), (5, "u/a.py", "the license of the cat\nis under the table"),
    ]
    data += [(100 + i, f"v/{i}", "\n".join(f"foobar w{i}x{k}" for k in range(20))) for i in range(50)]
    got = by_id(licenses.scan(spark.createDataFrame(data, "doc_id bigint, path string, text string")))
    assert [got[i][0]["license"] for i in range(1, 6)] == ["Apache-2.0", "MIT", "MIT", "MIT", None]
    assert got[1][0]["score"] > 0.8 and got[2][0]["score"] > 0.9 and all(got[100 + i][0]["how"] == "none" for i in range(50))
    # the weight of a term outside the templates comes from the corpus
    n, df = sum(len([x for x in t.split("\n") if licenses.terms(x)]) for _, _, t in data), Counter(t for *_, x in data for y in x.split("\n") for t in set(licenses.terms(y)))
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1
    vector = lambda x: {t: k * idf(t) for t, k in Counter(licenses.terms(x)).items()}
    cosine = lambda a, b: sum(v * b.get(k, 0) for k, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    assert math.isclose(got[3][0]["score"], max(cosine(vector(data[2][2]), vector(t)) for t in licenses.TEMPLATES["MIT"]), abs_tol=1e-6)


def test_cosine_against_brute_force():
    m = licenses.Matcher(100, {"the": 90, "license": 5})
    line = "Released under the MIT license today"

    def vector(words):
        return {t: n * m.idf.get(t, m.rare) for t, n in Counter(words).items()}

    def cosine(a, b):
        return sum(v * b.get(k, 0) for k, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    best = max((cosine(vector(licenses.terms(line)), vector(licenses.terms(t))), n) for n, ts in licenses.TEMPLATES.items() for t in ts)
    got = m.line(licenses.terms(line))
    assert got and got[0] == best[1] and math.isclose(got[1], best[0])


def test_pipeline_stages(spark, rows, tmp_path):
    spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, next(r[1] for r in rows if r[0] == 4)[-300:])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[4] < counts[3]
    placed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in placed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))
    groups = defaultdict(list)
    for n in queries.QUERIES:
        groups[n.split("_")[0]].append(n)
    assert all(len(v) == 1 for v in groups.values())
