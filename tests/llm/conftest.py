import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names the operators use inside.
CLASH = ["_t", "_x", "n", "h", "key", "node", "ord", "pos", "term", "rank", "cut", "host", "path"]


def vocabulary(seed, size, letters="abcdefghij"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(size)]


def prose(r, words, n):
    out = []
    for i in range(n):
        out.append(r.choice(words))
        if i % 17 == 16:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n")


def corpus():
    """Prose with copies, near copies, shared lines and passages, personal data, empty, null and long texts."""
    r = random.Random(7)
    langs = {"en": vocabulary(1, 400, "abcdefgh"), "fr": vocabulary(2, 400, "ijklmnopé")}
    rows, texts = [], []
    passage = prose(r, langs["en"], 70)
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        t = prose(r, langs[lang], r.choice([3, 40, 120, 200]))
        if i % 9 == 4:
            t += "\n" + passage
        if i % 7 == 2 and texts:
            t, lang = r.choice(texts)
        if i % 11 == 5 and texts:
            t, lang = max(texts, key=lambda x: len(x[0]))
            w = t.split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 13 == 3:
            t += "\nmail bob.b@mail.example.org now, host 10.0.0.300 or 10.0.0.30, card 4111 1111 1111 1111, call +1 (555) 010-9999."
        texts.append((t, lang))
        rows.append((i, t, lang, f"s{i % 4}", len(t)))
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \n\t ", "en", "s1", 4), (103, "Ünïcode 𝔘 text é à " * 300, "fr", "s2", 1), (104, "x" * 3000, "en", "s2", 3000)]
    rows += [(105, "12 34 56", "en", "s3", 8), (7, rows[7][1], "en", "s3", 1), (None, rows[20][1], "en", "s3", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


def by_id(df, key="doc_id"):
    """Rows by id; ids that repeat (7) or are null give the same columns for each row."""
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out
