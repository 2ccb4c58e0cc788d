"""The registered queries: against their oracles, and the digest columns of the others."""

import hashlib
import math
import re
import zlib
from html import unescape
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from test_byte_bpe import reference_ids
from tokenizers import Tokenizer

from corrobora.llm import queries, registry
from corrobora.llm.decontaminate import normalise

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for p in SF.glob("*.parquet"):
        found.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, str(SF))
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(plain(list(r))) for r in df.select(*columns).collect()) == sorted(str(plain(list(r))) for r in want.fetchall())


def test_each_operator_has_one_query():
    assert [n for n in registry.queries() if re.match(r"op\d+_", n)] == list(queries.QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_token_queries(spark, con):
    docs = con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    bpe = {r.doc_id: r for r in queries.op3_byte_bpe(spark, str(SF)).collect()}
    files = {r.doc_id: r for r in queries.op5_token_files(spark, str(SF)).collect()}
    assert len(bpe) == len(files) == len(docs)
    words, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for k, text in docs:
        ids = np.array(reference_ids(text), "<u4").tobytes()
        assert (bpe[k].n_tokens * 4, bpe[k].ids_sha256, bpe[k].decoded_sha256) == (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        ids = np.array([*words.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (files[k].start, files[k].n_tokens * 4, files[k].ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += files[k].n_tokens


def test_verbatim_passages_are_found(spark, con):
    items = [(k, normalise(t or "")) for k, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()]
    got = {r.doc_id: r for r in queries.op10_decontaminate(spark, str(SF)).collect()}
    for k, text in con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        verbatim = {i for i, t in items if t and t in normalise(text)}
        assert verbatim <= set(got[k]["items"])
        assert got[k].contaminated == bool(got[k]["items"])
        assert all(f.edits == 0 for f in got[k].found if f.item_id in verbatim)


def test_scores_and_pages(spark, con):
    got = queries.op8_quality_cnn(spark, str(SF)).collect()
    assert len(got) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    pages = {r.page_id: r for r in queries.op9_html_text(spark, str(SF)).collect()}
    for k, page in con.execute("SELECT page_id, html FROM pages").fetchall():
        inner = "".join(re.findall(r"<article>(.*?)</article>", page, re.S))
        want = unescape(re.sub(r"<!--.*?-->|<script.*?</script>|<[^>]*>", " ", inner, flags=re.S)).split()
        # All of the article and nothing else.
        assert "".join(pages[k].text.split()) == "".join(want) and (want or not inner)


def test_pipeline_query(spark, con):
    got = registry.queries()["pipeline"](spark, str(SF)).collect()
    assert 0 < len(got) < con.execute("SELECT count(*) FROM documents").fetchone()[0]
