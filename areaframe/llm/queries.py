"""The registered queries of this subpackage, and SQL oracles where SQL can express them.

Each query applies its operator with production parameters to the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import pii

    return pii.find_spans(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import quality_rules

    return quality_rules.assess(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import token_counts

    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import decontaminate

    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("_t")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import langid

    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import line_dedup

    df = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_lines", "n_removed", "n_blocks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("_t")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are laid out as source/language/id."""
    from areaframe.llm import licenses

    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import substring_dedup

    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of documents, a tenth of which (by a hash of the id) are made periodic from some word on first."""
    from areaframe.llm import periodic_runs

    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("g", F.expr("h div 10"))
    at = "transform(array(CAST(g % size(w) AS INT)), a -> transform(array(CAST(1 + (size(w) - a) div (3 + g % 8) AS INT)), p -> array_join(transform(w, (x, i) -> IF(i < a, x, w[a + (i - a) % p])), ' '))[0])[0]"
    periodic = F.expr(rf"transform(array(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)), w -> IF(size(w) = 0, text, {at}))[0]")
    docs = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))
    return periodic_runs.digest(periodic_runs.find_runs(docs))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import quality_classifier

    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areaframe.llm import phrase_mining

    return phrase_mining.mine(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality_rules, op3_token_counts, op4_decontamination, op5_packing, op6_language, op7_line_dedup, op8_near_duplicates, op9_licenses, op10_substring_dedup, op11_periodic_runs, op12_quality_classifier, op13_phrase_mining)}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(lower(regexp_replace(x, '[ \t\x0B\f\r]+', ' ', 'g')))), lambda x: x <> '') AS nl FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM w, range(1, len(w) - 1) r(i)),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(3) r(o) WHERE c > 1 GROUP BY 1),
hosts AS (SELECT host, count(*) AS n FROM (SELECT DISTINCT doc_id, host, t FROM d) GROUP BY 1),
lim AS (SELECT host, v FROM (SELECT host, unnest(list_distinct(nl)) AS v FROM (SELECT DISTINCT doc_id, host, t, nl FROM w)) JOIN hosts USING (host) GROUP BY host, v, n HAVING count(*) > 5 AND (count(*) > 0.02 * n OR count(*) > 1000)),
cut AS (SELECT doc_id, sum(len(string_split(v, ' '))) AS n FROM (SELECT doc_id, host, unnest(nl) AS v FROM w) JOIN lim USING (host, v) GROUP BY 1),
r AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AS kept FROM r""",
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS g FROM b, range(1, greatest(2, len(w) - 11)) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (SELECT doc_id, i, s.n, item, win.g FROM d, sizes s, range(1, len(w) - s.n + 2) r(i) JOIN win ON win.n = s.n AND win.g = array_to_string(w[i:i + s.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids, count(DISTINCT g || '@' || i) AS n_phrases FROM hit GROUP BY 1),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hit, range(13) r(o) WHERE o < n GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_phrases, 0) AS n_phrases
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)""",
    "op13_phrase_mining": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents),
p AS (SELECT id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, range(1, 4) s(k), range(1, len(w) - k + 2) r(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
held AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
cut AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score,
  row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f), j) AS nth
  FROM c LEFT JOIN held USING (lang, phrase), range(1, 3) s(j) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
  WHERE j < c.k AND (most IS NULL OR 100 * most < 50 * a)),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM cut WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
}
