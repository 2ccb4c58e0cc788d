"""Overlapping, provenance-carrying chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions import hashing as H
from corrobora.functions import text as T
from corrobora.operators import long_chunks, merkle


def spans(text: str, size: int = 1200, overlap: int = 200) -> list[tuple[int, int]]:
    """Start and end of each chunk of normalised text.

    A chunk ends after the last sentence mark before white space among its last LOOKBACK characters, else
    after the last white space there, else at ``size``; the next one starts ``overlap`` before that end.
    """
    size = max(100, min(100_000, int(size)))
    overlap = max(0, min(size - 1, int(overlap)))
    n = len(text)
    if n <= size:
        return [(0, n)]
    out, start = [], 0
    while start < n:
        end = long_chunks.end_of(text, start, size, n)
        out.append((start, end))
        if end >= n:
            break
        start = end - overlap if end - overlap > start else end
    return out


CHUNKS = "doc_id long, page int, seg int, char_start int, char_end int, text string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("seg", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("text", pa.string())])


def chunk(segments: DataFrame, size: int = 1200, overlap: int = 200, long: int | None = None) -> DataFrame:
    """Rows (doc_id, page, seg, ord, char_start, char_end, text) of segments (doc_id, page, text[, seg]).

    Offsets refer to the normalised text. Blank segments give nothing and use up no ordinal; ordinals run
    over a document's segments from 0. Segments of up to ``long`` characters are cut one by one; longer ones are many
    tasks' work, if there are any.
    """
    seg = F.col("seg") if "seg" in segments.columns else F.lit(0)
    source = segments.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), seg.cast("int").alias("seg"), T.norm_for_chunks(F.coalesce("text", F.lit(""))).alias("text"))
    source = source.where(F.col("text").rlike(T.NOT_SPACE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, page, k, text in zip(*(c.to_pylist() for c in batch.slice(a, 512).columns), strict=True):
                    rows.extend((doc_id, page, k, x, y, text[x:y]) for x, y in spans(text, size, overlap))
                yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_SCHEMA)

    if long is None:
        made = source.mapInArrow(run, CHUNKS)
    else:
        size = max(100, min(100_000, int(size)))
        long = max(long, size)
        made = source.where(F.length("text") <= long).mapInArrow(run, CHUNKS)
        some = source.where(F.length("text") > long)
        made = made.unionByName(long_chunks.chunk_long(some, size, max(0, min(size - 1, int(overlap)))).select(*made.columns))
    from corrobora.sources.documents import ordinals

    return ordinals(made, "doc_id", "seg", "char_start").select("doc_id", "page", "seg", "ord", "char_start", "char_end", "text")


def chunk_id(path, file, page, ordinal):
    """``slug~tag#page#cN``: the tag is six hex digits of the path as a JSON string, the page ``na`` or ``pN``."""
    tag = F.substring(H.short_hash(H.json_string(path)), 1, 6)
    return F.concat(T.slug(file), F.lit("~"), tag, F.lit("#"), F.coalesce(F.concat(F.lit("p"), page.cast("string")), F.lit("na")), F.lit("#c"), ordinal.cast("string"))


def index_tree(chunks: DataFrame, fan: int = merkle.FAN) -> DataFrame:
    """The Merkle tree of an index: each chunk's canonical JSON is hashed where it is, the digests in the order of ``pos``."""
    line = H.canonical(F.struct("char_end", "char_start", "id", "page", "source_file", "text"))
    return merkle.tree(chunks, F.sha2(line, 256), fan)


def index_id(chunks: DataFrame, embedder_id: str, size: int, overlap: int) -> DataFrame:
    """One row (index_id): a hash of the embedder, the parameters and all chunks in the order of ``pos``."""
    head = f'{{"chunk_params":{{"overlap":{overlap},"size":{size}}},"embedder_id":"{embedder_id}"}}'
    nodes = index_tree(chunks)
    above = nodes.where("level > 0")
    # Up to FAN chunks are one node, as in any larger index every chunk is below one.
    if above.isEmpty():
        above = nodes.groupBy(F.lit(1).alias("level")).agg(F.sha2(merkle.joined("node"), 256).alias("h")).withColumn("node", F.lit(0).cast("long"))
    return merkle.top(above).select(F.substring(F.sha2(F.concat(F.lit(head), "h"), 256), 1, 12).alias("index_id"))
