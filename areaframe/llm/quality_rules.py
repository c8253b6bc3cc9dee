"""Quality rules: repetition inside a text, and line frequency across documents of a host.

The cross-document rule hashes normalised lines, counts the documents of each host
that hold a line, removes lines above the host's limit, and rejects documents that
the removal depletes. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.llm.common import documents, same_row, sized, text_key, words, write_table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: A line is boilerplate when more than this many documents of its host hold it ...
MIN_DOCS = 5
#: ... and more than this share of the host's documents, or more than this many whatever its size.
MIN_SHARE = 0.02
MOST_DOCS = 1000
#: A document is depleted when the removed lines hold more than this share of its words.
DEPLETED = 0.5


def base_rules(docs: DataFrame) -> DataFrame:
    """Counts inside each whole text (null text: no words).

    Windows of three words are compared by a 64-bit hash; only texts in which one
    repeats pay for the sort that finds where.
    """
    df = documents(docs, "source").withColumn("_t", text_key(F.coalesce("text", F.lit(""))))
    df = df.withColumn("_x", F.coalesce("text", F.lit(""))).withColumn("_w", words(F.col("_x")))
    df = df.withColumn("_g", F.expr("CASE WHEN size(_w) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"))
    df = df.withColumn(
        "_s",
        F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN array_sort(transform(_g, (h, i) -> named_struct('h', h, 'i', i))) ELSE cast(array() AS array<struct<h: bigint, i: int>>) END"),
    ).withColumn("_d", F.expr("filter(_s, (x, i) -> coalesce(get(_s, i - 1).h = x.h, false) OR coalesce(get(_s, i + 1).h = x.h, false))"))
    lines = F.filter(F.split("_x", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines).select(
        "doc_id",
        "_t",
        "source",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_x", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_x") - F.length(F.translate("_x", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(_d, x -> array(x.i, x.i + 1, x.i + 2))))) AS bigint)").alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lines(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: row key, host, position, hash of the normalised line, words in it."""
    df = documents(docs, "source").where(F.col("text").isNotNull())
    normal = F.expr("transform(split(text, '\\n', -1), x -> trim(lower(regexp_replace(x, '[ \\t\\x0B\\f\\r]+', ' '))))")
    df = df.select("doc_id", text_key(F.col("text")).alias("_t"), F.coalesce("source", F.lit("")).alias("host"), normal.alias("_l"))
    df = df.select("doc_id", "_t", "host", F.posexplode("_l").alias("pos", "_v")).where("_v <> ''")
    return df.select("doc_id", "_t", "host", "pos", F.xxhash64("_v").alias("line"), F.length("_v").alias("chars"), F.size(F.split("_v", " ")).alias("line_words"))


def _normal_lines(df: DataFrame) -> DataFrame:
    """host, line, chars, n: the distinct normalised lines of each row (host, text, n)."""
    normal = F.expr("array_distinct(transform(split(text, '\\n', -1), x -> trim(lower(regexp_replace(x, '[ \\t\\x0B\\f\\r]+', ' ')))))")
    lines = df.select("host", "n", F.explode(normal).alias("_v")).where("_v <> ''")
    return lines.select("host", F.xxhash64("_v").alias("line"), F.length("_v").alias("chars"), "n")


def line_limits(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """Lines above their host's limit: host, line, chars, n_docs (distinct documents: id and text).

    The count is pre-aggregated before the shuffle, so that a line in a third of all rows costs
    one row a task. Repeated rows are found by their keys, and counted off again.
    """
    df = documents(docs, "source").select("doc_id", F.coalesce("source", F.lit("")).alias("host"), "text", text_key(F.col("text")).alias("_t"))
    copies = df.groupBy("doc_id", "_t", "host").agg(F.count(F.lit(1)).alias("c"))
    copies = write_table(copies, "line-documents")
    hosts = sized(write_table(copies.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")), "line-hosts"), 60)
    again = sized(write_table(copies.where(F.col("c") > 1), "line-repeats"), 60).alias("r")
    d = df.alias("d")
    off = d.join(again, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d._t") == F.col("r._t")) & (F.col("d.host") == F.col("r.host")))
    off = off.groupBy("d.doc_id", "d._t", "d.host").agg(F.first("d.text").alias("text"), (1 - F.first("r.c")).alias("n")).select("host", "text", "n")
    lines = _normal_lines(df.select("host", "text", F.lit(1).cast("long").alias("n"))).unionByName(_normal_lines(off))
    lines = lines.groupBy("host", "line", "chars").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") > min_docs)
    over = (F.col("n_docs") > min_share * F.col("host_docs")) | (F.col("n_docs") > most_docs)
    return lines.join(hosts, "host").where(over).drop("host_docs")


def assess(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, depleted: float = DEPLETED, most_docs: int = MOST_DOCS) -> DataFrame:
    """One row per input row: the counts, base_failed, removed_words and kept.

    ``kept`` is false for a document that fails the base rules or that loses more than
    ``depleted`` of its words with the boilerplate lines.
    """
    over = write_table(line_limits(docs, min_docs, min_share, most_docs), "line-limits")
    hits = _lines(docs).join(sized(over, 40), ["host", "line", "chars"])
    # a set, so that repeated rows of one document do not add up
    hits = hits.groupBy("doc_id", "_t", F.col("host").alias("_host")).agg(F.collect_set(F.struct("pos", "line_words")).alias("_cut"))
    base = base_rules(docs)
    out = base.join(hits.hint("merge"), same_row(base, hits) & (F.coalesce(base["source"], F.lit("")) == hits["_host"]), "left")
    removed = F.expr("aggregate(coalesce(_cut, array()), 0L, (a, x) -> a + x.line_words)").alias("removed_words")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = out.select(base["doc_id"], *counts, "base_failed", removed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= depleted * F.col("n_words")))


def remove_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """doc_id, source and the text without the lines that are above their host's limit."""
    over = write_table(line_limits(docs, min_docs, min_share, most_docs), "line-limits")
    hits = _lines(docs).join(sized(over, 40), ["host", "line", "chars"])
    hits = hits.groupBy("doc_id", "_t", F.col("host").alias("_host")).agg(F.collect_set("pos").alias("_cut"))
    df = documents(docs, "source").withColumn("_t", text_key(F.coalesce("text", F.lit(""))))
    out = df.join(hits.hint("merge"), same_row(df, hits) & (F.coalesce(df["source"], F.lit("")) == hits["_host"]), "left")
    left = F.expr("CASE WHEN _cut IS NULL THEN text ELSE array_join(filter(split(text, '\\n', -1), (x, i) -> NOT array_contains(_cut, i)), '\\n') END")
    return out.select(df["doc_id"], "source", left.alias("text"))
