"""Token files against the tokenizers library and their own format."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corrobora.llm import token_files
from corrobora.llm.token_files import WordEncoder, read_token_files, write_token_files

PATH = P.path("word_bpe_49k.json")
library = Tokenizer.from_file(PATH)
encoder = WordEncoder(PATH)


def ids(text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0xFF), st.sampled_from("ab'sS tTreVE<|>endoftext019 ²Σİé́日")), max_size=60), max_size=4))
def test_encoder_is_the_library(texts):
    assert [x.tolist() for x in encoder.encode(texts)] == [ids(t) for t in texts]


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN", 3)
    rows = [(k * 13 % 40, t, "x") for k, t in enumerate(["", "Hello World's", "日本 é 12", "a" * 5000, "<|endoftext|> x", "   "] * 6)] + [(None, None, None), (3, "twice", "y"), (None, "b", "z"), (-(2**63), "a", "z"), (0, "c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = str(tmp_path / "tokens")
    parts = write_token_files(docs, folder, PATH, 1)
    got = sorted(read_token_files(parts, folder).collect(), key=lambda r: r.start)
    start = 0
    for r, (k, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())), strict=True):
        want = np.array([*ids(t), 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert sum(p.stat().st_size for p in Path(folder).glob("*.tokens")) == 2 * start
    wide = str(tmp_path / "wide")
    assert sorted(map(tuple, read_token_files(write_token_files(docs, wide, PATH, 1, wide=True), wide, wide=True).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = str(tmp_path / "none")
    assert read_token_files(write_token_files(docs, folder, PATH), folder).count() == 0
