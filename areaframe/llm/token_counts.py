"""Token counts: lengths only, from texts split at safe boundaries and encoded in slices of equal bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 20
#: Parts whose counts a worker remembers, and the longest of them.
CACHE_PARTS = 300_000
CACHE_CHARS = 32

# A byte-level pre-tokenizer always ends a piece where white space follows another
# character, so the counts of the parts add up. Special tokens hold no space.
_PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
_KNOWN: dict[str, dict[str, int]] = {}


def split_text(text: str) -> list[str]:
    """The parts of a text between safe boundaries; a text without any stays whole."""
    return _SAFE.split(text) if _OTHER_SPACE.search(text) else _PLAIN.findall(text)


def _encode(tokenizer, parts: list[str], slice_bytes: int) -> Iterator[tuple[str, int]]:
    """Each part with its token count, encoded in slices of about ``slice_bytes``."""
    at = 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and held < slice_bytes:
            held += len(parts[end])
            end += 1
        yield from zip(parts[at:end], map(len, tokenizer.encode_batch_fast(parts[at:end], add_special_tokens=False)), strict=True)
        at = end


def encode_lengths(tokenizer, texts: list[str], known: dict[str, int], slice_bytes: int = SLICE_BYTES) -> list[int]:
    """Token counts of ``texts``. Parts repeat a lot: each is encoded once while it is remembered."""
    split = [split_text(x) for x in texts]
    extra: dict[str, int] = {}
    for part, n in _encode(tokenizer, list(set().union(*split) - known.keys()), slice_bytes):
        (known if len(known) < CACHE_PARTS and len(part) <= CACHE_CHARS else extra)[part] = n
    if extra:
        return [sum(known[p] if p in known else extra[p] for p in own) for own in split]
    return [sum(map(known.__getitem__, own)) for own in split]


def count_tokens(docs: DataFrame, tokenizer_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens. A null text counts as empty.

    Needs no shuffle; memory is bounded by an Arrow batch and one slice of encodings.
    """
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        known = _KNOWN.setdefault(tokenizer_path, {})
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n: list[int] = []
            while len(n) < len(texts):
                end, held = len(n), 0
                while end < len(texts) and held < 4 * slice_bytes:
                    held += len(texts[end])
                    end += 1
                n += encode_lengths(tokenizer, texts[len(n) : end], known, slice_bytes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
