"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from corrobora.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def reference_ids(text: str) -> list[int]:
    return library.encode_ordinary(text)


TEXTS = ["", "Hello  world's  end\n\n  x", "É日本語 \t mixed ½ 12345  ", "a" * 3000, "   ", "don't <|endoftext|> stop", "🙂🙂 emoji " * 50, "word " * 400_000]


def test_ids_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SEGMENT", 1000)
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, None, 2), (2, TEXTS[2], 3), (2, TEXTS[2], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    encoded = byte_bpe.encode(docs, PATH, P.PATTERN)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in encoded.collect())
    want = sorted(((i if i is not None else -1), reference_ids(t or ""), len(reference_ids(t or ""))) for i, t, _ in rows)
    assert got == want
    decoded = sorted(((r.doc_id if r.doc_id is not None else -1), bytes(r.content)) for r in byte_bpe.decode(encoded, PATH).collect())
    assert decoded == sorted(((i if i is not None else -1), (t or "").encode()) for i, t, _ in rows)


def test_digests(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in byte_bpe.digests(docs, PATH, P.PATTERN).collect():
        ids = np.array(reference_ids(TEXTS[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(TEXTS[r.doc_id].encode()).hexdigest()


def test_empty_table_and_repeated_blocks(spark):
    kind = "doc_id long, text string"
    assert byte_bpe.digests(spark.createDataFrame([], kind), PATH, P.PATTERN).count() == 0
    one = spark.createDataFrame([(1, "same block")], kind)
    assert byte_bpe.digests(one.unionByName(one), PATH, P.PATTERN).count() == 2
