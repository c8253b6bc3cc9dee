"""Benchmark decontamination by a positional inverted index.

The index holds postings (term, document, position) of the training text for the rarest
terms of each test window. The offset-adjusted lists of a window are intersected starting
from its rarest terms; the words of what survives are joined with the window's. Everything is
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.llm.common import documents, lower_word, same_row, sized, text_key, words, write_table

#: Runs of digits, letters and code points from U+0080; A-Z are lower-cased word by word afterwards.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Rarest terms of a window whose lists are intersected before the comparison.
RAREST = 2
#: Positions by which the rarest terms may be off in a proximity match.
SLOP = 5


def terms(text: Column) -> Column:
    """The words of a text with A-Z lower-cased."""
    return F.transform(words(text, TERM), lower_word)


def test_windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win_id, win: its words), and the items that hold them (win_id, item), written as tables.

    An item with fewer words than ``size``, but not none, is one window. Null texts have none.
    """
    df = benchmark.select("item_id", F.col("text").cast("string").alias("_x")).where(F.col("_x").isNotNull())
    df = df.select("item_id", terms(F.col("_x")).alias("_w")).where(F.size("_w") > 0)
    cut = F.expr(f"transform(sequence(1, greatest(1, size(_w) - {size - 1})), i -> slice(_w, i, {size}))")
    df = write_table(df.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.explode(F.array_distinct(cut)).alias("win")).distinct(), "bench-item-windows")
    windows = write_table(df.select("win").distinct().withColumn("win_id", F.monotonically_increasing_id()), "bench-windows")
    return windows, write_table(df.hint("merge").join(windows, "win").select("win_id", "item"), "bench-items")


def _terms(docs: DataFrame) -> DataFrame:
    """doc_id, _t, n_words, pos, term: one row per word, and one without a term for a text that has none."""
    df = documents(docs).select("doc_id", text_key(F.col("text")).alias("_t"), words(F.coalesce("text", F.lit("")), TERM).alias("_w"))
    df = df.select("doc_id", "_t", F.size("_w").cast("long").alias("n_words"), F.posexplode_outer("_w").alias("pos", "term"))
    return df.withColumn("term", lower_word(F.col("term")))


def anchors(docs: DataFrame, windows: DataFrame, rarest: int = RAREST) -> DataFrame:
    """The ``rarest`` terms of each window by corpus frequency: win_id, len (words), term, off, need (how many).

    Windows with a term that no document holds cannot occur and are left out.
    """
    vocabulary = write_table(windows.select(F.explode("win").alias("term")).distinct(), "bench-vocabulary")
    counts = _terms(docs).select("term").join(sized(vocabulary, 60), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    places = windows.select("win_id", F.size("win").alias("len"), F.posexplode("win").alias("off", "term")).hint("merge").join(counts.hint("merge"), "term", "left")
    by = Window.partitionBy("win_id")
    places = places.withColumn("_r", F.row_number().over(by.orderBy(F.col("n").asc_nulls_first(), "off"))).withColumn("_none", F.max(F.col("n").isNull()).over(by))
    places = places.where(~F.col("_none") & (F.col("_r") <= rarest))
    return places.withColumn("need", F.max("_r").over(by)).select("win_id", "len", "term", "off", "need")


def index_postings(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The index: doc_id, _t, pos, n_words and term for the terms in ``chosen``, written as a table.

    The first row of each text (pos 0, or null where it has no words) is always there, so the
    table also lists all texts with their word counts; its term is null if it is not in ``chosen``.
    """
    wanted = write_table(chosen.select("term", F.lit(True).alias("_is")).distinct(), "bench-terms")
    rows = _terms(docs).join(sized(wanted, 60), "term", "left").where(F.col("_is") | F.coalesce(F.col("pos") == 0, F.lit(True)))
    return write_table(rows.select("doc_id", "_t", "n_words", "pos", F.when(F.col("_is"), F.col("term")).alias("term")), "bench-postings")


def intersect(postings: DataFrame, chosen: DataFrame, slop: int = 0) -> DataFrame:
    """Offset-adjusted intersection: doc_id, _t, win_id, len, start.

    With ``slop`` 0 the rarest terms stand at exactly their distances (candidates for a
    phrase); otherwise all of them start within the same stretch of ``slop`` + 1 positions
    or the one after it (proximity).
    """
    start = F.col("pos") - F.col("off")
    rows = postings.where(F.col("term").isNotNull()).join(sized(chosen, 60), "term").select("doc_id", "_t", "n_words", "win_id", "len", "need", "off", start.alias("start"))
    if slop:
        near = F.floor(F.col("start") / (slop + 1)).cast("int")
        rows = rows.withColumn("start", F.explode(F.array(near, near - 1))).withColumn("start", F.col("start") * (slop + 1))
    else:
        rows = rows.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    # a window has fewer than 64 words, so its offsets are counted as bits
    met = rows.groupBy("doc_id", "_t", "win_id", "len", "start", "need").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("off"))).alias("_o"))
    return met.where(F.bit_count("_o") >= F.col("need")).drop("_o", "need")


def phrases(docs: DataFrame, cands: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, _t, win_id, len, start of the candidates whose words are the window's, each once, written as a table.

    Only texts with a candidate are split into words again, and each once.
    """
    keys = sized(write_table(cands.select("doc_id", "_t").distinct(), "bench-candidate-texts"), 32)
    d = documents(docs).where(F.col("text").isNotNull()).withColumn("_t", text_key(F.col("text")))
    texts = write_table(d.join(keys, same_row(d, keys), "left_semi").select("doc_id", "_t", terms(F.col("text")).alias("_w")), "bench-candidate-words")
    places = cands.groupBy("doc_id", "_t").agg(F.collect_set(F.struct("start", "len", "win_id")).alias("_c"))  # no more than the text has words, for each window length and anchor
    cut = F.expr("transform(_c, c -> named_struct('win_id', c.win_id, 'len', c.len, 'start', c.start, 'win', slice(_w, c.start + 1, c.len)))")
    rows = texts.hint("merge").join(places, same_row(texts, places)).select(texts["doc_id"], texts["_t"], F.explode(cut).alias("c")).select("doc_id", "_t", "c.*")
    found = rows.join(sized(windows, 400), ["win_id", "win"]).select("doc_id", "_t", "win_id", "len", "start")
    return write_table(found.distinct(), "bench-phrases")  # repeated rows of one text find the same


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """One row per input row: doc_id, _t (hash of the text), n_words, n_hit, item_ids (sorted strings), n_phrases.

    Null texts have no words; documents without a match have empty lists. Repeated rows
    are answered alike.
    """
    windows, items = test_windows(benchmark, size)
    chosen = write_table(anchors(docs, windows, rarest), "bench-anchors")
    postings = index_postings(docs, chosen)
    found = phrases(docs, write_table(intersect(postings, chosen), "bench-candidates"), windows)
    hits = found.groupBy("doc_id", "_t").agg(
        F.expr("cast(size(array_distinct(flatten(collect_set(sequence(start, start + len - 1))))) AS bigint)").alias("n_hit"), F.count(F.lit(1)).alias("n_phrases")
    )
    held = found.select("doc_id", "_t", "win_id").distinct().join(sized(items, 60), "win_id").groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    hits = write_table(hits.hint("merge").join(held, same_row(hits, held)).select(hits["doc_id"], hits["_t"], "n_hit", "n_phrases", "item_ids"), "bench-hits")
    rows = postings.where(F.coalesce(F.col("pos") == 0, F.lit(True))).select("doc_id", "_t", "n_words")
    h = sized(hits, 200)
    out = rows.join(h, same_row(rows, h), "left")
    none = {"n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>"), "n_phrases": F.lit(0).cast("long")}
    return out.select(rows["doc_id"], rows["_t"], "n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()))


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, rarest: int = RAREST, slop: int = SLOP) -> DataFrame:
    """Exact phrase places and proximity matches: doc_id, kind (aligned: an exact phrase, or near), win, item, start."""
    windows, items = test_windows(benchmark, size)
    chosen = write_table(anchors(docs, windows, rarest), "bench-anchors")
    postings = index_postings(docs, chosen)
    exact = phrases(docs, write_table(intersect(postings, chosen), "bench-candidates"), windows).withColumn("kind", F.lit("aligned"))
    near = intersect(postings, chosen, slop).withColumn("kind", F.lit("near"))
    return exact.unionByName(near).join(sized(windows, 400), "win_id").join(sized(items, 60), "win_id").select("doc_id", "kind", "win", "item", "start")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns; contaminated when at least one word in twenty is hit."""
    df = find(docs, benchmark)
    return df.select(
        "doc_id",
        "_t",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "n_phrases",
    )
