"""Tasks of one Python worker share an encoder; what it forgets or keeps changes no ids."""

import struct

import pyarrow as pa
from tokenizers import Tokenizer

from areaframe.llm import packing
from areaframe.llm.queries import tokenizer_path


def test_tasks_share_an_encoder_and_memory_changes_no_ids(spark, monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    made = []
    begin = packing.Encoder.__init__
    monkeypatch.setattr(packing.Encoder, "__init__", lambda self, p: (made.append(p), begin(self, p))[1])
    monkeypatch.setattr(packing, "CACHE_PARTS", 20)
    tok = Tokenizer.from_file(path)
    for k in range(6):  # as many tasks
        texts = [f"word{k} rare{k * j} shared <|x|> it's {'é' * j}" for j in range(30)]
        for text, got in zip(texts, packing.encode(path, texts), strict=True):
            assert list(struct.unpack(f"<{len(got) // 4}I", got)) == tok.encode(text, add_special_tokens=False).ids
    assert len(made) <= 1


def test_workers_keep_their_encoder_between_tasks(spark):
    path = tokenizer_path("word_bpe_49k.json")

    def run(batches):
        for b in batches:
            import os

            own = packing.encoder(path)
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([id(own)], pa.int64())], ["pid", "encoder"])

    rows = spark.range(0, 24, 1, 24).mapInArrow(run, "pid bigint, encoder bigint").collect()
    assert len(rows) == 24
    assert len({(r.pid, r.encoder) for r in rows}) == len({r.pid for r in rows})
