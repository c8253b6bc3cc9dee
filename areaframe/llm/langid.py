"""Language identification with interpolated Kneser-Ney character models.

Spark counts the character n-grams of every labelled training text, per language; the
discounted probabilities are derived with DataFrame operations and kept in sorted arrays of
packed n-gram codes. A text gets the language whose model gives the lowest cross-entropy per
character, and is rejected when that lies beyond a limit calibrated on labelled texts that the
models were not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.llm.common import documents, sized, write_table

ORDER = 4
#: An n-gram that makes up less than one in this many of its language is not kept by itself: its
#: mass goes to the lower order. All are counted; the rule is the same for every table.
RARE = 1 << 27
#: One labelled text in this many is held back from the models to calibrate the rejection.
CALIBRATE = 16
#: Characters of text, and counted n-grams, that a task holds at once.
SLICE_CHARS, HELD_GRAMS = 1 << 20, 1 << 20
#: Rejection: this many times the distance of median and 90th percentile above the median.
REJECT = 8.0
#: ... but never closer than this many bits a character above the median.
LEAST_BITS = 1.0
_SPACE = 32
_BITS = 16


def _fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in one array, and where each begins.

    Letters are lower-cased, each run of other characters becomes one space, and every text
    is led by ORDER - 1 spaces and closed by one. Code points beyond 16 bits share the codes of
    the private use area.
    """
    folded = [x.lower() for x in texts]
    code = np.frombuffer("\n".join(folded).encode("utf-32-le", "replace") + b"\n\0\0\0", dtype=np.uint32)
    lengths = np.fromiter((len(x) + 1 for x in folded), np.int64, len(folded))
    doc = np.repeat(np.arange(len(folded)), lengths)
    code = np.where(_letters(code), np.where(code > 0xFFFF, 0xE000 + code % 0x1900, code), _SPACE).astype(np.uint64)
    code[np.cumsum(lengths) - 1] = _SPACE
    first = np.zeros(len(code), bool)
    first[np.cumsum(lengths) - lengths] = True
    keep = (code != _SPACE) | ~np.concatenate([[False], code[:-1] == _SPACE]) | first
    code, doc = code[keep], doc[keep]
    pad = ORDER - 1
    counts = np.bincount(doc, minlength=len(folded))
    out = np.full(len(code) + pad * len(folded), _SPACE, np.uint64)
    starts = np.concatenate([[0], np.cumsum(counts + pad)])[:-1]
    place = np.arange(len(code)) + pad * (doc + 1)
    out[place] = code
    return out, starts


_TABLE: list[np.ndarray] = []


def _letters(code: np.ndarray) -> np.ndarray:
    """Which code points are letters; the table for 16 bits is built once a worker."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000))
    out = _TABLE[0][np.minimum(code, 0xFFFF)]
    high = code > 0xFFFF
    if high.any():
        out[high] = [chr(c).isalpha() for c in code[high]]
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed ORDER-grams of all texts, the text of each, and the letters in each text."""
    code, starts = _fold(texts)
    n = len(code) - ORDER + 1
    gram = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        gram |= code[k : k + n] << np.uint64(_BITS * (ORDER - 1 - k))
    ends = np.append(starts[1:], len(code))
    doc = np.repeat(np.arange(len(texts)), ends - starts)
    inside = doc[:n] == doc[ORDER - 1 : ORDER - 1 + n]
    letters = np.bincount(doc[code != _SPACE], minlength=len(texts))
    return gram[inside], doc[:n][inside], letters


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, gram, n: counts of the ORDER-grams over all labelled texts.

    Each Arrow batch is counted in NumPy, then Spark adds up; only counts are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                by_lang: dict[str, list[str]] = {}
                chars = 0
                while at < len(texts) and chars < SLICE_CHARS:
                    by_lang.setdefault(langs[at], []).append(texts[at])
                    chars += len(texts[at])
                    at += 1
                for lang, some in by_lang.items():
                    gram, n = np.unique(_grams(some)[0], return_counts=True)
                    held.setdefault(lang, []).append((gram, n))
                    rows += len(gram)
                if rows > HELD_GRAMS:
                    yield from flush()
                    rows = 0
        yield from flush()

    counts = labelled.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Sorted code arrays with a probability for every language, per order.

    ``tables[k]`` holds the (k+1)-grams: codes, log2 probabilities [entry, language]; and
    ``back[k]`` the contexts of k characters: codes, log2 back-off weights.
    """

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]], back: list[tuple[np.ndarray, np.ndarray]], unseen: np.ndarray) -> None:
        self.langs, self.tables, self.back, self.unseen = langs, tables, back, unseen

    def scores(self, gram: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's last character under each language: [gram, language]."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        todo = np.arange(len(gram))
        for k in range(len(self.tables) - 1, -1, -1):
            codes, logs = self.tables[k]
            part = gram[todo] & _mask(k + 1)
            at = np.searchsorted(codes, part)
            at[at == len(codes)] = 0
            hit = codes[at] == part if len(codes) else np.zeros(len(part), bool)
            out[todo[hit]] += logs[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if k:
                codes, logs = self.back[k]
                part = (gram[todo] & _mask(k + 1)) >> np.uint64(_BITS)
                at = np.searchsorted(codes, part)
                at[at == len(codes)] = 0
                hit = codes[at] == part
                out[todo[hit]] += logs[at[hit]]
        out[todo] += self.unseen
        return out


def _mask(chars: int) -> np.uint64:
    return np.uint64(0xFFFFFFFFFFFFFFFF >> (64 - _BITS * chars))


def _levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """Counts for each order from 1: raw for the highest, continuation counts below it."""
    levels = [counts]
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit(int(_mask(k)) if k < 4 else -1))
        levels.insert(0, levels[0].groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    return levels


def train(labelled: DataFrame, order: int = ORDER, rare: int = RARE) -> Model | None:
    """Interpolated Kneser-Ney over all labelled texts; None where there are none.

    The discount of each order and language is n1 / (n1 + 2 n2). What reaches the driver is
    one row for each n-gram and context of a language, without those below ``rare``.
    """
    counts = count_grams(labelled)
    if order < ORDER:
        counts = counts.groupBy("lang", F.col("gram").bitwiseAND(F.lit(int(_mask(order)))).alias("gram")).agg(F.sum("n").alias("n"))
    counts = write_table(counts, "lang-grams")
    levels = _levels(counts, order)
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # one row a language
    if not langs:
        return None
    gathered = []
    for k, level in enumerate(levels):
        ones = F.sum((F.col("n") == 1).cast("long"))
        twos = F.sum((F.col("n") == 2).cast("long"))
        level = write_table(level, "lang-level")
        discount = level.groupBy("lang").agg(F.coalesce(F.try_divide(ones, ones + 2 * twos), F.lit(0.5)).alias("d"), F.sum("n").alias("all"))
        discount = write_table(discount.withColumn("d", F.least(F.greatest("d", F.lit(0.1)), F.lit(0.95))), "lang-discounts")
        level = level.join(sized(discount, 60), "lang").withColumn("ctx", F.shiftrightunsigned("gram", _BITS) if k else F.lit(0).cast("long"))
        by = Window.partitionBy("lang", "ctx")
        mass = F.when(F.col("n") * rare >= F.col("all"), F.col("n") - F.col("d"))
        level = level.withColumn("total", F.sum("n").over(by)).withColumn("p", mass / F.col("total")).withColumn("gamma", 1 - F.coalesce(F.sum("p").over(by), F.lit(0.0)))
        number = F.array_position(F.lit(langs), F.col("lang")) - 1
        # a context without an n-gram of its own passes everything on, as one that was never seen does
        gathered.append(level.where(F.col("p").isNotNull()).select(number.cast("smallint").alias("lang"), "gram", F.col("p").cast("float").alias("p"), F.col("gamma").cast("float").alias("gamma")).toArrow())
    return _assemble(langs, gathered)


def _assemble(langs: list[str], gathered: list[pa.Table]) -> Model:
    """Interpolate from the lowest order up, over the union of the languages' n-grams."""
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    back: list[tuple[np.ndarray, np.ndarray]] = []
    floor = np.zeros(len(langs), np.float32)
    for k, t in enumerate(gathered):
        lang, p, gamma = (t.column(c).to_numpy() for c in ("lang", "p", "gamma"))
        gram = t.column("gram").to_numpy().view(np.uint64)
        ctx = gram >> np.uint64(_BITS) if k else np.zeros(len(gram), np.uint64)
        codes, at = np.unique(gram, return_inverse=True)
        contexts, ctx_at = np.unique(ctx, return_inverse=True)
        logs = np.zeros((len(codes), len(langs)), np.float32)
        logs[at, lang] = p
        weight = np.ones((len(contexts), len(langs)), np.float32)  # a context that a language never saw passes all to the lower order
        weight[ctx_at, lang] = gamma
        if k == 0:
            floor = weight[0] / 0x10000  # what is left is spread over all codes
        for low in range(0, len(codes), 1 << 18):
            some = slice(low, low + (1 << 18))
            w = weight[np.searchsorted(contexts, codes[some] >> np.uint64(_BITS))] if k else weight[0]
            lower = np.exp2(Model(langs, tables, back, np.log2(floor)).scores(codes[some] & _mask(k))) if k else 1 / 0x10000
            logs[some] = np.log2(logs[some] + w * lower)
        tables.append((codes, logs))
        back.append((contexts, np.log2(weight)))
    return Model(langs, tables, back, np.log2(floor))


def score(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, lang_pred, bits (cross-entropy per character), score, letters and the columns ``more``.

    ``und`` for a null text and one without a letter. The score is the share of the winner
    when languages are weighted by 2^(-bits) over at most 40 characters.
    """
    return _scored(docs, docs.sparkSession.sparkContext.broadcast(model), *more)


def _scored(docs: DataFrame, shared: Broadcast, *more: str) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.langs, dtype=object)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < 500_000 or end == at):
                    size += len(texts[end])
                    end += 1
                some = batch.slice(at, end - at)
                gram, doc, letters = _grams(texts[at:end])
                sums = _sums(m, gram, doc, end - at)
                bits = -sums / np.maximum(np.bincount(doc, minlength=end - at), 1)[:, None]
                best = np.argmin(bits, axis=1)
                least = bits[np.arange(len(best)), best]
                share = 1 / np.exp2(-(bits - least[:, None]) * np.clip(letters, 1, 40)[:, None]).sum(axis=1)
                none = letters == 0
                pred = np.where(none, "und", names[best])
                share, least = np.where(none, 0.0, share), np.where(none, 0.0, least)
                new = [pa.array(pred.tolist(), pa.string()), pa.array(least), pa.array(share), pa.array(letters)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(some.column(c) for c in more), *new], ["doc_id", *more, "lang_pred", "bits", "score", "letters"])
                at = end

    df = docs.select("doc_id", *more, "text")
    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *more))
    return df.mapInArrow(run, f"{fields}, lang_pred string, bits double, score double, letters bigint")


def _sums(m: Model, gram: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text the sum of log2 probabilities, in pieces so that a very long text stays bounded."""
    out = np.zeros((n, len(m.langs)))
    for at in range(0, len(gram), 1 << 20):
        logs, part = m.scores(gram[at : at + (1 << 20)]), doc[at : at + (1 << 20)]
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        out[part[edges]] += np.add.reduceat(logs, edges, axis=0, dtype=np.float64)
    return out


def identify(docs: DataFrame, *more: str, reject: float = REJECT, order: int = ORDER) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, bits, rejected and ``more``.

    Learns from texts with a language whose crc32(doc_id as text) mod 4 is not 2 (a null
    id: 0). Rejected are ``und``, and texts whose bits, scaled by the square root of their
    length, lie ``reject`` spreads and LEAST_BITS above the median of their language's texts that
    were held back from the models (mod CALIBRATE 1), or of its training texts if it has none.
    An empty table or one without labels gives ``und`` for all.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    df = documents(docs, "lang", *more).withColumn("held_out", crc % 4 == 2).withColumn("_back", crc % CALIBRATE == 1)
    own = [c for c in more if c not in ("text", "lang")]
    labelled = df.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "_back")
    model = train(labelled.where(~F.col("_back")), order) or train(labelled, order)
    if model is None:
        nothing = {"lang_pred": F.lit("und"), "bits": F.lit(0.0), "score": F.lit(0.0), "rejected": F.lit(True)}
        return df.select("doc_id", "held_out", *(v.alias(k) for k, v in nothing.items()), *own)
    # ``lang`` travels along for the calibration only
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = write_table(_scored(df.select("doc_id", "held_out", "_back", "lang", "text", *own), shared, "held_out", "_back", "lang", *own), "lang-scores")
    shared.destroy()
    known = scored.where(~F.col("held_out") & (F.col("lang") == F.col("lang_pred")))
    # of each language's texts, those held back; one row a language
    which = known.groupBy("lang_pred").agg(F.max("_back").alias("_which"), F.percentile_approx("bits", 0.5, 10000).alias("_all"), F.percentile_approx(F.when(F.col("_back"), F.col("bits")), 0.5, 10000).alias("_own"))
    middle = sized(write_table(which.select("lang_pred", "_which", F.coalesce("_own", "_all").alias("mid")), "lang-middles"), 60)
    spread = (F.col("bits") - F.col("mid")) * F.sqrt(F.least("letters", F.lit(400)))
    limits = known.join(middle, "lang_pred").where(F.col("_back") == F.col("_which")).groupBy("lang_pred", "mid").agg(F.percentile_approx(spread, F.array(F.lit(0.5), F.lit(0.9)), 10000).alias("q"))
    limits = limits.select("lang_pred", "mid", (F.col("q")[0] + reject * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.5))).alias("most"))
    out = scored.join(sized(write_table(limits, "lang-limits"), 60), "lang_pred", "left")
    far = (F.col("lang_pred") == "und") | F.coalesce((spread > F.col("most")) & (F.col("bits") > F.col("mid") + LEAST_BITS), F.lit(False))
    return out.select("doc_id", "held_out", "lang_pred", "bits", "score", far.alias("rejected"), *own)
