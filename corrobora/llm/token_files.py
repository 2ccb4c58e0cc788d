"""Token ids as flat binary files.

Documents are dealt by ranges of their identifiers. Each range is one part of four files: ``.tokens``
(unsigned 16- or 32-bit integers, little-endian), ``.offsets`` (n + 1 unsigned 64-bit positions of its
documents), ``.ids`` (the documents' signed 64-bit identifiers) and ``.nulls`` (one unsigned 64-bit integer: so many
of the first documents have no identifier, and 0 in its place). The parts' bases are the prefix sums of their token counts. A task writes under a name of its own attempt and renames
at the end, so a repeated or speculative task replaces the same part with the same bytes.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrobora.llm import ragged
from corrobora.llm.common import partitions, scratch, text_or_empty, written
from corrobora.llm.wordhash import blocks

#: Bytes of text that are encoded at a time.
BLOCK = 4 << 20
#: Words whose ids a task remembers.
KNOWN = 300_000

#: The tokenizer's splitting of lower-case Latin-1 text, and the bytes that keep a text off that path.
LATIN = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼½¾]|[^ \t\n\r\f\va-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
UNUSUAL = bytes([0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0])
WORD_END = "</w>"


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Words(dict):
    """Words to numbers in order of first sight; the new ones are also in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Ids of texts as the tokenizers library gives them, with the ids of words remembered.

    Latin-1 texts without unusual characters are split here and their distinct words encoded by the library;
    any other text is encoded by the library as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = Words()
        self.flat, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self) -> None:
        """Encodes the new words as one text; each word's last token carries the mark of a word's end."""
        words, self.known.new = self.known.new, []
        ids = self.whole([" ".join(words)])[0]
        lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(lengths) != len(words) or lengths.sum() != len(ids):
            each = self.whole(words)
            ids, lengths = np.concatenate(each), np.array([len(x) for x in each])
        self.flat = np.concatenate([self.flat, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        words: list[str] = []
        plain, counts, other = [], [], []
        for i, text in enumerate(texts):
            if plain_latin(text):
                found = LATIN.findall(text.lower())
                words += found
                plain.append(i)
                counts.append(len(found))
            else:
                other.append(i)
        if other:
            for i, ids in zip(other, self.whole([texts[i] for i in other]), strict=True):
                out[i] = ids
        if len(self.known) > KNOWN:
            self.forget()
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self.learn()
        flat, lengths = ragged.gather(self.flat, self.at, codes)
        edges = ragged.offsets(lengths)[ragged.offsets(np.array(counts, np.int64))]
        for i, a, b in zip(plain, edges[:-1], edges[1:], strict=True):
            out[i] = flat[a:b]
        return out


def plain_latin(text: str) -> bool:
    """Latin-1 only, without characters that the library treats in ways of its own, and without its markers."""
    if "<|" in text:
        return False
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(raw.translate(None, UNUSUAL)) == len(raw)


def _open(uri: str):
    """A pyarrow file system and the path in it; a bare path is the shared mount itself."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


PARTS = "part int, docs long, tokens long"


def _write(folder: str, path: str, end_id: int | None, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        enc = WordEncoder(path)
        store, root = _open(folder)
        part, attempt = task.partitionId(), task.taskAttemptId()
        names = [f"{root}/{part:06d}.{x}" for x in ("tokens", "offsets", "ids", "nulls")]
        files = [store.open_output_stream(f"{n}.{attempt}") for n in names]
        total = docs = nulls = 0
        files[1].write(np.array([0], "<u8").tobytes())
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in blocks(lengths, BLOCK):
                encoded = enc.encode([t.decode("utf-8", "replace") for t in batch.column(1).slice(a, b - a).to_pylist()])
                tail = [] if end_id is None else [np.array([end_id], np.uint32)]
                flat = np.concatenate([np.empty(0, np.uint32), *(x for ids in encoded for x in (ids, *tail))])
                ends = total + np.cumsum([len(ids) + len(tail) for ids in encoded])
                if len(flat) and int(flat.max()) > np.iinfo(kind).max:
                    raise ValueError(f"id {int(flat.max())} does not fit {kind}")
                files[0].write(flat.astype(kind).tobytes())
                files[1].write(ends.astype("<u8").tobytes())
                files[2].write(batch.column(0).slice(a, b - a).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nulls += batch.column(0).slice(a, b - a).null_count
                total, docs = int(ends[-1]), docs + b - a
        files[3].write(np.array([nulls], "<u8").tobytes())
        for f, n in zip(files, names, strict=True):
            f.close()
            store.move(f"{n}.{attempt}", n)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([docs]), pa.array([total])], names=["part", "docs", "tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None = None, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text's ids to ``folder`` in ascending identifier order; returns (part, docs, tokens, base).

    ``folder`` must be one that all executors reach. Nulls come first, ties are ordered by text, a null text
    counts as empty; with ``end_id`` every document ends in that id, empty ones too. An empty table gives
    parts without documents, or none. Other columns are ignored.
    """
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    # An identifier that repeats, or null, is no single range; how texts begin orders them as the texts do.
    dealt = source.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    parts = written(dealt.mapInArrow(_write(folder, path, end_id, wide), PARTS))
    # One row per part: what this window gathers is the number of parts, not of documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _map(folder: str, part: int, what: str, kind: str) -> np.ndarray:
    """One file, memory-mapped where the folder is mounted, else read."""
    store, root = _open(folder)
    name = f"{root}/{part:06d}.{what}"
    if store.type_name == "local":
        return np.memmap(name, kind, "r") if os.path.getsize(name) else np.empty(0, kind)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(folder: str, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _map(folder, part, "tokens", "<u4" if wide else "<u2")
                at = _map(folder, part, "offsets", "<u8").astype(np.int64)
                ids = _map(folder, part, "ids", "<i8")
                nulls = int(_map(folder, part, "nulls", "<u8")[0])
                for a in range(0, len(ids), 8192):
                    edges = at[a : a + 8193]
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                    own = np.asarray(ids[a : a + 8192])
                    yield pa.record_batch([pa.array(own, mask=np.arange(a, a + len(own)) < nulls), pa.array(base + edges[:-1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())], schema=READ)

    return run


def read_token_files(parts: DataFrame, folder: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts all tokens before it."""
    spread = parts.select("part", "base").repartition(partitions(parts.sparkSession), "part")
    return spread.mapInArrow(_read(folder, wide), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(spark: SparkSession, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the files to a fresh folder that the cluster shares, then reads them back."""
    folder = scratch(spark)
    return read_token_files(write_token_files(docs, folder, path, end_id), folder)
