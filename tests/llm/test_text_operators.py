"""PII, quality rules, token counts and decontamination against plain Python."""

import hashlib
import re
from collections import Counter

import pytest

from areaframe.llm import decontaminate, pii, quality_rules, queries, token_counts
from tests.llm.conftest import SCHEMA, by_id

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(x):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(x))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in RULES.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


HARD = [
    "a@b.c_d@e.f.g",
    "a@b.c.d@e.f",
    "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 00255.1.1.1 1.2.3.4.",
    "4111-1111 1111-1111 4111111111111112 1 2 3",
    "+1 234 567 89 ++12345678 +1-2 (3) 4 5 6 7 8 9) +49.30.123456...",
    "é𝔘 x@y.zz é 9.9.9.9",
    "@a.b .@. %+@x.y-z.w",
    "5" * 3000 + "." + "a" * 3000 + "@" + "b." * 500 + "c",
    "",
    "+" * 50 + "1" * 20,
]


def test_pii_base_spans(spark, docs, rows):
    data = [(i, t, "en", "s", 0) for i, t in enumerate(HARD)] + [(1000 + k, r[1], *r[2:]) for k, r in enumerate(rows)]
    got = by_id(pii.find_spans(spark.createDataFrame(data, SCHEMA)))
    for i, text, *_ in data:
        spans = base(text)
        r = got[i][0]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest(), (text or "")[:80]
        assert [r[f"n_{k}"] for k in RULES] == [sum(x[0] == k for x in spans) for k in RULES]
        assert r["spans"].split(",")[: len(spans)] == ([f"{k}:{s}:{e}" for k, s, e in spans] or [""] * 0 or r["spans"].split(",")[:0])


def test_pii_terms_that_disclose(spark):
    text = lambda i: f"The quick report number {i} says that Zorblax wrote from zb@corp.example.com about the usual things" if i < 6 else f"The quick report number {i} says that somebody wrote about the usual things"
    df = spark.createDataFrame([(i, text(i), "en", "s", 0) for i in range(60)] + [(99, "Only Zorblax is named here", "en", "s", 0)], SCHEMA)
    terms = {r["term"]: r["action"] for r in pii.disclosing_terms(df, alpha=0.9).collect()}
    assert "zorblax" in terms and terms["zorblax"] == "generalise"
    assert not {"the", "report", "usual"} & set(terms)
    got = by_id(pii.find_spans(df, alpha=0.9))
    assert got[99][0]["spans"] == "term:5:12"
    clean = by_id(pii.sanitise(df, alpha=0.9))
    assert clean[99][0]["text"] == "Only [NAME] is named here"
    assert "[EMAIL]" in clean[0][0]["text"] and "zb@" not in clean[0][0]["text"]
    # only beside the entity: removed
    df = df.where("doc_id <> 99")
    assert "Zorblax" not in by_id(pii.sanitise(df, alpha=0.9))[0][0]["text"] and "[NAME]" not in by_id(pii.sanitise(df, alpha=0.9))[0][0]["text"]


def test_pii_empty(none):
    assert pii.find_spans(none).count() == 0


def quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": len(w) < 50 or 100 * len(hit) > 50 * len(w),
    }


def test_quality_base(spark, docs, rows):
    data = [*rows, (200, "a b c a b c d\na b\n\na b\n#$ |", "en", "s", 0), (201, "a a a a", "en", "s", 0)]
    got = by_id(quality_rules.assess(spark.createDataFrame(data, SCHEMA)))
    for r in data:
        assert {k: got[r[0]][0][k] for k in quality(r[1])} == quality(r[1]), r[0]
    assert len(got[7]) == 2 and got[7][0] == got[7][1]


def test_quality_lines_across_documents(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    common = " ".join(f"c{k}" for k in range(80))
    data = [(i, own(i) + ("\n" + common.upper() if i < 20 else ""), "en", "a" if i < 100 else "b", 0) for i in range(200)]
    data += [(300, own(300) + "\n" + common, "en", "b", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = by_id(quality_rules.assess(df))
    assert all(got[i][0]["kept"] == (i >= 20) for i in range(200))
    assert got[0][0]["removed_words"] == 80 and got[300][0]["kept"]  # the line is rare on that host
    text = by_id(quality_rules.remove_lines(df))
    assert text[3][0]["text"] == own(3) and text[300][0]["text"].endswith(common)


def test_quality_empty(none):
    assert quality_rules.assess(none).count() == 0


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = by_id(token_counts.count_tokens(docs, path, slice_bytes=500))
    for r in rows:
        g = got[r[0]][0]
        assert g["n_tokens"] == len(tok.encode(r[1] or "", add_special_tokens=False).ids) and g["n_bytes"] == len((r[1] or "").encode())
    assert token_counts.count_tokens(docs.where("false"), path).count() == 0


@pytest.mark.parametrize("text", ["a   x", "a  b\n\n c \n", "it's <|endoftext|> don't<|endoftext|>'s", "\x1c!\x1cb c", " lead", "tab\t\tx \ty", "é è  z", "x\r\n y"])
def test_token_split_is_safe(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    parts = token_counts.split_text(text * 3)
    assert "".join(parts) == text * 3
    assert sum(len(tok.encode(p, add_special_tokens=False).ids) for p in parts) == len(tok.encode(text * 3, add_special_tokens=False).ids)


def contamination(text, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = word(text), set(), set()
    for item, t in items:
        iw = word(t)
        wins = {tuple(iw[i : i + 13]) for i in range(max(1, len(iw) - 12))} if iw else set()
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, rows):
    words = max((r[1] for r in rows if r[0] == 1 or r[0] == 4), key=len).split()
    items = [(1, " ".join(words[3:25])), (10, "X Y"), (2, None), (3, ""), (5, "É à, é À " * 4), (6, "x" * 3000), (11, rows[8][1]), (12, "12 34"), (12, "12 34"), (13, " ".join(words[:14]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.digest(docs, bench))
    keys = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for r in rows:
        assert tuple(got[r[0]][0][k] for k in keys) == contamination(r[1], items), r[0]
    assert any(g[0]["contaminated"] for g in got.values())
    assert decontaminate.digest(docs.where("false"), bench).count() == 0
    assert decontaminate.digest(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_proximity_matches(spark):
    words = [f"t{i}" for i in range(13)]
    near = words[:6] + ["extra"] + words[6:]
    df = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, " ".join(near), "en", "s", 0)], SCHEMA)
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    got = {(r["doc_id"], r["kind"]) for r in decontaminate.matches(df, bench).collect()}
    assert {(1, "aligned"), (1, "near"), (2, "near")} <= got


def test_quality_counts_distinct_documents(spark):
    text = "\n".join(" ".join(f"l{i}w{k}" for k in range(15)) for i in range(10))
    own = lambda i: " ".join(f"o{i}x{k}" for k in range(60))
    data = [(1, text, "en", "a", 0)] * 8 + [(i, own(i), "en", "a", 0) for i in range(10, 20)]
    got = by_id(quality_rules.assess(spark.createDataFrame(data, SCHEMA)))
    assert all(r["removed_words"] == 0 and r["kept"] for r in got[1]) and len(got[1]) == 8
    # the absolute limit holds on a host of any size
    shared = [(i, own(i) + "\n" + " ".join(["zz"] * 80), "en", "b", 0) for i in range(8)] + [(100 + i, own(i), "en", "b", 0) for i in range(400)]
    df = spark.createDataFrame(shared, SCHEMA)
    assert by_id(quality_rules.assess(df, min_share=0.1))[0][0]["removed_words"] == 0
    assert by_id(quality_rules.assess(df, min_share=0.1, most_docs=7))[0][0]["removed_words"] == 80


def test_pii_counts_documents_and_not_rows(spark):
    text = lambda i: f"The quick report number {i} says that Zorblax wrote from zb@corp.example.com about the usual things" if i < 6 else f"The quick report number {i} says that somebody wrote about the usual things"
    data = [(i, text(i), "en", "s", 0) for i in range(60)]
    once = {tuple(r) for r in pii.disclosing_terms(spark.createDataFrame(data, SCHEMA)).collect()}
    twice = {tuple(r) for r in pii.disclosing_terms(spark.createDataFrame(data + data[:3] * 4 + data[30:40], SCHEMA)).collect()}
    assert once == twice and "zorblax" in {r[0] for r in once}
