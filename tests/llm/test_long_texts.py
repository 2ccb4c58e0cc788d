"""Every operator on texts of more than a megabyte beside short, empty and null ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from corrobora.llm.exact_dedup import exact_dedup
from corrobora.llm.jaccard_join import jaccard_components
from corrobora.llm.katz import katz_scores
from corrobora.llm.line_dedup import line_verdicts
from corrobora.llm.quality import Network, score
from corrobora.llm.secrets import digests
from corrobora.llm.token_files import token_file_digests

RNG = random.Random(11)
WORDS = [RNG.choice(["alpha", "beta", "Gamma", "de", "x1", "longer-one-of-them", "é"]) + str(k % 61) for k in range(170_000)]
LONG = " ".join(WORDS)
NEAR = " ".join([*WORDS[:-50], "another", "end"])
ROWS = [(1, LONG), (2, LONG), (3, NEAR), (4, "short text of a few words"), (5, ""), (6, None), (7, "y" * 1_500_000)]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG.encode()) > 1_000_000
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)


def test_exact_dedup(docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs).collect()}
    for k, text in ROWS:
        same = [i for i, t in ROWS if (t or "") == (text or "")]
        assert got[k] == (max(same), len(same), k == max(same), hashlib.sha256((text or "").encode()).hexdigest())


def test_katz(docs):
    got = {r.doc_id: r for r in katz_scores(docs).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in ROWS}
    tokens = {k: [*(t or "").lower().split(), None] for k, t in ROWS}
    seen = {w for k, ws in tokens.items() if not held[k] for w in ws}
    assert all((got[k].n_tokens, got[k].n_known, got[k].held_out) == (len(ws), sum(w in seen for w in ws), held[k]) for k, ws in tokens.items())


def test_line_dedup(spark):
    lines = [" ".join(WORDS[k : k + 12]) for k in range(0, 160_000, 12)]
    text = "\n".join([*lines, lines[0], lines[5]])
    got = {r.line_no: (r.keep_line, r.kept) for r in line_verdicts(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).where("doc_id = 1").collect()}
    assert len(text) > 1_000_000 and len(got) == len(lines) + 2
    assert got[len(lines)] == (0, False) and got[len(lines) + 1] == (5, False) and got[0] == (0, True)


def test_token_files(spark, docs):
    library, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in token_file_digests(spark, docs, P.path("word_bpe_49k.json"), 1).collect()}
    for k, text in ROWS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (got[k].start, got[k].n_tokens * 4, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += got[k].n_tokens


def test_jaccard(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for k, w in ((k, (t or "").lower().split()) for k, t in ROWS)}
    assert got == {k: (len(s), 1 if k < 4 else k) for k, s in sets.items()}


def test_secrets(spark):
    text = LONG[:700_000] + " token=abcdef1 é " + LONG[:700_000] + " AKIA" + "B" * 16 + " password: 'zzzzzz'"
    r = digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = sorted((m.start(), "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6) + [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]{16,}", text)]
    assert r.spans == ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(found)) and (r.n_assign, r.n_access, r.n_hex) == (2, 1, 0)


def test_quality(docs):
    net = Network.fresh(2)
    got = {r.doc_id: r.score for r in score(docs, net).collect()}
    assert got == pytest.approx({k: float(net.scores([(t or "").encode()])[0]) for k, t in ROWS}, abs=1e-5)
