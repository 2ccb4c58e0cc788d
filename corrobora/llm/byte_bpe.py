"""Byte-level BPE over a whole table: every distinct pre-token is encoded once, in one global shuffle.

Blocks of documents explode their pre-tokens with positions, collapsed to the distinct words of the block.
The words are dealt by hash; the owner of a bucket encodes each distinct word once and sends its ids back
to every block that asked. The block joins ids to positions and puts its documents together again.
Decoding joins ids to the token-byte table, whose size is the vocabulary's. What travels is per block and
distinct word, so a word that fills a third of the corpus costs its owner one row per block.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm import ragged
from corrobora.llm.common import partitions, released, stable, text_or_empty
from corrobora.llm.wordhash import blocks

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 4 << 20
#: Characters that are pre-tokenised at a time.
SEGMENT = 1 << 20
#: A pre-token of the public pattern never runs across such a place; texts are cut there, for this pattern only.
CUT = re.compile(r"(?<=\S)\s")
#: Distinct words whose ids an owner keeps between blocks.
KNOWN = 500_000

ROW = "block binary, bucket int, a binary, b binary, c binary"
ROWS = pa.schema([("block", pa.binary()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes and their offsets by id; ids without a token have no bytes."""
    table = ranks(path)
    by_id = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        by_id[rank] = token
    return np.frombuffer(b"".join(by_id), np.uint8), ragged.offsets(np.array([len(t) for t in by_id]))


class Numbered(dict):
    """Words to numbers in order of first sight."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def segments(text: str, pattern: str) -> Iterator[str]:
    if pattern != public_tokenizers.PATTERN:
        yield text
        return
    at = 0
    while len(text) - at > SEGMENT:
        cut = CUT.search(text, at + SEGMENT)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def pack(array: np.ndarray) -> bytes:
    """Little-endian, each byte of the numbers apart, compressed."""
    return zstandard.compress(np.ascontiguousarray(array.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _explode(pattern: str, buckets: int, words_only: bool):
    """Blocks of documents to rows of words (bucket >= 0) or to one row of positions (bucket -1)."""
    split = regex.compile(pattern).findall

    def rows(ids: list, texts: list[bytes]) -> Iterator[tuple]:
        words, codes, counts = Numbered(), [], []
        mark = xxhash.xxh3_128()
        for doc_id, text in zip(ids, texts, strict=True):
            mark.update(f"{doc_id},{len(text)}:".encode())
            mark.update(text)
            n = 0
            for part in segments(text.decode("utf-8", "replace"), pattern):
                found = split(part)
                codes.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                n += len(found)
            counts.append(n)
        block = mark.digest()
        spelled = [w.encode() for w in words]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in spelled), np.int64, len(spelled))
        order = np.argsort(bucket, kind="stable")
        if not words_only:
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            doc_ids = pa.array(ids, pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])) as out:
                out.write_batch(pa.record_batch([doc_ids, pa.array(counts, pa.int64())], names=["doc_id", "n"]))
            yield block, -1, sink.getvalue().to_pybytes(), pack(np.concatenate([np.empty(0, np.uint32), *codes])), pack(place)
            return
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            own = [spelled[i] for i in order[edges[k] : edges[k + 1]]]
            yield block, int(k), zstandard.compress(b"".join(own), 3), pack(np.array([len(w) for w in own])), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in blocks(lengths, BLOCK):
                found = list(rows(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()))
                if found:
                    yield pa.record_batch([list(c) for c in zip(*found, strict=True)], schema=ROWS)

    return run


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(path, pattern), {}
        for batch in batches:
            out = []
            for block, bucket, words, lengths in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words, at, ids = zstandard.decompress(words), 0, []
                if len(known) > KNOWN:
                    known.clear()
                for n in unpack(lengths).tolist():
                    word = words[at : at + n]
                    at += n
                    if (got := known.get(word)) is None:
                        got = known[word] = enc._encode_single_piece(word)
                    ids.append(got)
                out.append((block, bucket, pack(np.array([i for w in ids for i in w])), pack(np.array([len(w) for w in ids])), None))
            if out:
                yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=ROWS)

    return run


OUT = "doc_id long, n_tokens long, ids binary"


def _reassemble(finish, schema: pa.Schema):
    """A block's rows together: positions joined with the ids of their words, per document."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        block, bucket, a, b, c = (rows.column(k).to_pylist() for k in range(5))
        # The same block again, once per time that its documents occur as a whole.
        copies = bucket.count(-1)
        docs = pa.ipc.open_stream(a[0]).read_all()
        words: dict[int, tuple] = {}
        for k, x, y in zip(bucket, a, b, strict=True):
            if k >= 0:
                words[k] = (unpack(x), unpack(y))
        flat = np.concatenate([np.empty(0, np.uint32), *(words[k][0] for k in sorted(words))])
        at = ragged.offsets(np.concatenate([np.empty(0, np.uint32), *(words[k][1] for k in sorted(words))]))
        codes, place = unpack(b[0]), unpack(c[0])
        if len(at) - 1 != len(place):
            raise ValueError("the documents changed between two reads; write them as a table first")
        counts = docs.column("n").to_numpy()
        edges = ragged.offsets(counts)
        ids, out = docs.column("doc_id").to_pylist(), []
        for doc_id, x, y in zip(ids, edges[:-1], edges[1:], strict=True):
            out.append((doc_id, *finish(ragged.gather(flat, at, place[codes[x:y]])[0])))
        return pa.table([list(col) for col in zip(*(out * copies), strict=True)], schema=schema)

    return run


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, finish, ddl: str, schema: pa.Schema) -> DataFrame:
    docs = stable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    source = docs.select(F.col("id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("text"))
    n = partitions(docs.sparkSession)
    # A bucket is a partition: hashing its number once more would leave some without any and give others several.
    words = source.mapInArrow(released(_explode(pattern, n, True)), ROW).repartitionById(n, "bucket").mapInArrow(released(_encode(path, pattern)), ROW)
    positions = source.mapInArrow(released(_explode(pattern, n, False)), ROW)
    return positions.unionByName(words).groupBy("block").applyInArrow(_reassemble(finish, schema), ddl)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of every whole text as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself by the ranks in the file ``path`` (base64 token and rank on
    each line), without special tokens. A null text counts as empty and has no ids; a null identifier and
    repeated rows are kept as they are; an empty table gives no rows; other columns are ignored. Input that is
    no stored table is written first, as it is read twice.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return _encoded(docs, path, pattern, id_col, text_col, lambda ids: (len(ids), ids.astype("<u4").tobytes()), OUT, schema)


def decoded_bytes(ids: np.ndarray, path: str) -> bytes:
    flat, at = token_bytes(path)
    return ragged.gather(flat, at, ids)[0].tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, content): the bytes of every row of ids as ``encode`` gives them; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [decoded_bytes(np.frombuffer(x, "<u4"), path) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(run, "doc_id long, content binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what ``encode`` and then ``decode`` give, as digests."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def finish(ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded_bytes(ids, path)).hexdigest()

    return _encoded(docs, path, pattern, id_col, text_col, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", schema)
