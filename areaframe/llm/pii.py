"""Personal data: fixed patterns, and terms that disclose a protected entity.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The method on
top of them is information-theoretic: a term discloses an entity when the pointwise
mutual information of the two over the corpus comes near the information content of the
entity itself. Such terms are generalised, or removed when they give the entity away
entirely. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaframe.llm.common import documents, lower_ascii, prefix_sums, sized, text_key, words, write_table

# Each pattern is the contract's, written so that the search is linear: quantifiers that
# need no backtracking are possessive, and a match cannot start inside a run that an
# earlier start would have taken (\G: unless the previous match ended there).
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_IP_OK = rf"^{_PART}(?:\.{_PART}){{3}}$"

TERM = r"[\p{L}_][\p{L}\p{N}_]{2,}"
#: Words on either side of an entity that count as its context.
CONTEXT = 8
#: Documents that must hold term and entity together before their tie counts.
MIN_SUPPORT = 3
#: Share of the entity's information content that the term may not reach.
ALPHA = 0.95

_SPANS = "array<struct<kind: string, s: bigint, e: bigint, m: string>>"


def _luhn(digits: str) -> str:
    digit = f"CAST(substring(reverse({digits}), i, 1) AS INT)"
    total = f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + IF(i % 2 = 1, {digit}, 2 * {digit} - IF({digit} >= 5, 9, 0)))"
    return f"{total} % 10 = 0"


_VALID = {
    "email": "true",
    "ip": "x.m RLIKE r'" + _IP_OK + "'",
    "card": "length(translate(x.m, ' -', '')) BETWEEN 16 AND 19 AND " + _luhn("translate(x.m, ' -', '')"),
    "phone": "length(translate(x.m, ' ().-+', '')) BETWEEN 8 AND 15",
}


def _with_spans(df: DataFrame, source: str, patterns: dict[str, str], keep_pieces: bool = False) -> DataFrame:
    """Columns _<kind>: the matches of each pattern with start and end in code points.

    Pieces between matches and matches alternate, so positions are prefix sums of their
    lengths; no row key, shuffle or Python is needed.
    """
    for kind, pattern in patterns.items():
        df = df.withColumn(f"_m_{kind}", words(F.col(source), pattern))
        df = df.withColumn(f"_p_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(source, pattern, -1)))
        df = df.withColumn(f"_n_{kind}", F.expr(f"CASE WHEN _p_{kind} IS NULL THEN cast(array() AS array<bigint>) ELSE transform(_m_{kind}, (m, i) -> CAST(length(_p_{kind}[i]) + length(m) AS bigint)) END"))
        df = df.withColumn(f"_o_{kind}", F.expr(prefix_sums(f"_n_{kind}")))
        df = df.withColumn(f"_{kind}", F.expr(f"transform(_o_{kind}, (o, i) -> named_struct('kind', '{kind}', 's', o + length(_p_{kind}[i]), 'e', o + _n_{kind}[i], 'm', _m_{kind}[i]))"))
        gone = ["_n_", "_o_"] if keep_pieces else ["_m_", "_p_", "_n_", "_o_"]
        df = df.drop(*(g + kind for g in gone))
    return df


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, _t, _x (the text, null as empty) and an array of valid base spans for each kind."""
    df = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("_x")).withColumn("_t", text_key(F.col("_x")))
    df = _with_spans(df, "_x", PATTERNS)
    for kind in PATTERNS:
        df = df.withColumn(f"_{kind}", F.expr(f"filter(_{kind}, x -> {_VALID[kind]})"))
    return df


def entity_contexts(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Distinct (doc_id, _t, entity, term): terms within ``context`` words of an entity in a document."""
    df = documents(docs).where(F.col("text").isNotNull()).withColumnRenamed("text", "_x").withColumn("_t", text_key(F.col("_x")))
    parts = []
    for kind, pattern in PATTERNS.items():
        hint = {"email": "@", "ip": ".", "card": "", "phone": "+"}[kind]
        one = df.where(F.contains("_x", F.lit(hint))) if hint else df
        one = one.withColumn("_m", words(F.col("_x"), pattern)).where(F.size("_m") > 0).withColumn("_p", F.split("_x", pattern, -1))
        one = one.select("doc_id", "_t", F.explode(F.expr("transform(_m, (m, i) -> named_struct('m', m, 'before', _p[i], 'after', _p[i + 1]))")).alias("x")).where(F.expr(_VALID[kind]))
        value = F.col("x.m") if kind in ("email", "ip") else F.translate("x.m", " ().-", "")
        around = F.concat(F.slice(F.reverse(words(lower_ascii(F.col("x.before")), TERM)), 1, context), F.slice(words(lower_ascii(F.col("x.after")), TERM), 1, context))
        parts.append(one.select("doc_id", "_t", F.concat(F.lit(kind + ":"), F.lower(value)).alias("entity"), F.array_distinct(around).alias("_a")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "_t", "entity", F.explode_outer("_a").alias("term")).distinct()


def disclosing_terms(docs: DataFrame, context: int = CONTEXT, min_support: int = MIN_SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """Terms that disclose some entity: term, pmi, content (of the entity), action.

    pmi = log2(N * n(entity, term) / (n(entity) * n(term))), where all four count distinct
    documents (id, text) that hold the one, the other or both anywhere; the entity's content is
    log2(N / n(entity)). Candidates are terms within ``context`` words of the entity in
    ``min_support`` documents. A term discloses it from ``alpha`` of the content on, and is removed
    rather than generalised when it reaches all of it.
    """
    n_docs = documents(docs).where(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text"))).distinct().count()
    near = write_table(entity_contexts(docs, context), "pii-contexts")
    holders = near.select("doc_id", "_t", "entity").distinct()
    entities = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = near.where(F.col("term").isNotNull()).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_near")).where(F.col("n_near") >= min_support)
    # a term is in no fewer documents than it is near entities in, and with the entity in no more
    # than that is in: both bound its pmi from above
    close = near.where(F.col("term").isNotNull()).select("doc_id", "_t", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_close"))
    pairs = pairs.hint("merge").join(entities, "entity").join(close.hint("merge"), "term").where(F.log2(F.lit(float(n_docs)) / F.col("n_close")) >= alpha * _content(n_docs) - 1e-9)
    pairs = write_table(pairs.select("entity", "term", "n_entity"), "pii-pairs")
    wanted = write_table(pairs.select("term").distinct(), "pii-terms")
    held = write_table(_document_terms(docs).join(sized(wanted, 60), "term", "left_semi").distinct(), "pii-term-documents")
    everywhere = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    # only rows of candidate pairs leave the join: term and entity are looked up by one key
    both = held.hint("merge").join(pairs.select("term", "entity"), "term").alias("h")
    h = holders.alias("e")
    both = both.join(h.hint("merge"), F.col("h.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("h._t") == F.col("e._t")) & (F.col("h.entity") == F.col("e.entity")), "left_semi")
    both = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    scored = pairs.hint("merge").join(both, ["entity", "term"]).join(everywhere.hint("merge"), "term")
    scored = scored.withColumn("pmi", _pmi(n_docs, "n_term")).withColumn("content", _content(n_docs)).where((F.col("content") > 0) & (F.col("pmi") >= alpha * F.col("content")))
    # an entity that every document holds has no content; a term tied to several keeps its strongest tie
    best = scored.groupBy("term").agg(F.max(F.struct(F.col("pmi") / F.col("content"), "pmi", "content")).alias("b"))
    full = F.col("b.pmi") >= F.col("b.content") - 1e-9
    return best.select("term", "b.pmi", "b.content", F.when(full, "remove").otherwise("generalise").alias("action"))


def _pmi(n_docs: int, term: str) -> Column:
    return F.log2(F.lit(float(n_docs)) * F.col("n_both") / (F.col("n_entity") * F.col(term)))


def _content(n_docs: int) -> Column:
    return F.log2(F.lit(float(n_docs)) / F.col("n_entity"))


def _document_terms(docs: DataFrame) -> DataFrame:
    df = documents(docs).where(F.col("text").isNotNull())
    return df.select("doc_id", text_key(F.col("text")).alias("_t"), F.explode(F.array_distinct(words(lower_ascii(F.col("text")), TERM))).alias("term"))


def _with_terms(found: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds _act: the disclosing terms of each document with their action, or null."""
    hits = _document_terms(docs).join(sized(terms, 60), "term")
    hits = write_table(hits.groupBy("doc_id", "_t").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("_act")), "pii-hits")
    hits = sized(hits, 300).alias("h")
    d = found.alias("d")
    return d.join(hits, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d._t") == F.col("h._t")), "left").select("d.*", "h._act")


def find_spans(docs: DataFrame, **limits) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.

    Base spans come from the whole text (null: empty). Term spans are added where no base
    span lies. Positions are code points, end exclusive.
    """
    terms = write_table(disclosing_terms(docs, **limits), "pii-disclosing")
    df = _with_terms(detect(docs), docs, terms)
    df = df.withColumn("_base", F.concat(*(F.col(f"_{k}") for k in PATTERNS)))
    df = df.withColumn("_y", F.when(F.col("_act").isNotNull(), F.col("_x")))  # only documents with such terms are split into words
    df = _with_spans(df, "_y", {"term": TERM})
    df = df.withColumn("_term", F.expr("filter(coalesce(_term, array()), t -> map_contains_key(_act, translate(t.m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AND NOT exists(_base, b -> b.s < t.e AND t.s < b.e))"))
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    df = df.withColumn("_b", F.expr(joined.format("_base")))
    return df.select(
        "doc_id",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(F.col("_b"), 256).alias("base_sha256"),
        F.expr(joined.format("concat(_base, _term)")).alias("spans"),
        F.size("_term").cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and text in which base matches give way to their kind, and disclosing terms are
    generalised to [NAME], [CODE] or [TERM] by their shape, or removed. A null text stays null."""
    terms = write_table(disclosing_terms(docs, **limits), "pii-disclosing")
    df = documents(docs).withColumn("_t", text_key(F.coalesce("text", F.lit(""))))
    df = _with_terms(df, docs, terms)
    for kind, pattern in PATTERNS.items():
        df = df.withColumn("_m", words(F.col("text"), pattern)).withColumn("_p", F.split("text", pattern, -1))
        swap = f"CASE WHEN size(_m) > 0 THEN array_join(transform(_p, (p, i) -> concat(p, CASE WHEN i >= size(_m) THEN '' WHEN {_VALID[kind].replace('x.m', '_m[i]')} THEN '[{kind.upper()}]' ELSE _m[i] END)), '') ELSE text END"
        df = df.withColumn("text", F.expr(swap)).drop("_m", "_p")
    df = df.withColumn("_m", F.when(F.col("_act").isNotNull(), words(F.col("text"), TERM))).withColumn("_p", F.when(F.col("_act").isNotNull(), F.split("text", TERM, -1)))
    low = "translate(_m[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shape = "CASE WHEN _m[i] RLIKE '[0-9]' THEN '[CODE]' WHEN _m[i] RLIKE '^\\\\p{Lu}' THEN '[NAME]' ELSE '[TERM]' END"
    swap = f"CASE WHEN _m IS NULL THEN text ELSE array_join(transform(_p, (p, i) -> concat(p, CASE WHEN i >= size(_m) THEN '' WHEN NOT map_contains_key(_act, {low}) THEN _m[i] WHEN _act[{low}] = 'remove' THEN '' ELSE {shape} END)), '') END"
    return df.select("doc_id", F.expr(swap).alias("text"))
