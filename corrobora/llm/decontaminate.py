"""Finds benchmark passages in documents by the q-gram lemma and banded alignment.

A passage of m characters that occurs with at most e edits keeps at least m - q + 1 - q * e of its q-grams,
on diagonals that lie at most e apart. Shared q-grams are therefore counted in overlapping bands of
2 * (e + 1) diagonals, of which one holds any e + 1 neighbouring ones; bands with enough of them are regions,
and an alignment inside the band, widened by e, decides. Nothing within the budget is missed.

The passages' index goes to every task, in as many blocks as its size needs, each with its own pass; the
documents stay where they are and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import discard, released, text_or_empty, without, written
from corrobora.llm.wordhash import mix

U = np.uint64
#: Characters of passages in one block of the index.
INDEX_CHARS = 8 << 20
#: Characters of a document that are searched at a time; neighbours overlap by the longest passage and its budget.
WINDOW = 1 << 20
SIEVE_BITS = 22


def normalise(text: str) -> str:
    """Lower case, runs of white space to one space, trimmed."""
    return " ".join(text.lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray, q: int) -> np.ndarray:
    if len(c) < q:
        return np.empty(0, U)
    out = c[: len(c) - q + 1].astype(U)
    for k in range(1, q):
        out *= U(0x9E3779B97F4A7C15)
        out += c[k : len(c) - q + 1 + k]
    return mix(out)


@dataclass
class Index:
    """Passages that share a q: their distinct q-grams sorted, and passages and offsets of each from ``at`` on."""

    q: int
    grams: np.ndarray
    at: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    sieve: np.ndarray


@dataclass
class Passages:
    ids: list[int]
    texts: list[str]
    budgets: np.ndarray
    needed: np.ndarray
    by_q: list[Index]

    @property
    def reach(self) -> int:
        return max((len(t) for t in self.texts), default=0) + int(self.budgets.max(initial=0))


def build(items: list[tuple[int, str]], q: int, percent: int) -> Passages:
    """The index of one block of passages; empty ones have no occurrence. A passage takes the largest of q,
    q - 1, ..., 1 for which the lemma asks for one shared q-gram at least."""
    kept = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if t]
    texts = [t for _, t in kept]
    budgets = np.array([len(t) * percent // 100 for t in texts], np.int64)
    qs = np.array([next((k for k in range(q, 1, -1) if len(t) - k + 1 - k * e >= 1), 1) for t, e in zip(texts, budgets, strict=True)], np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    needed = np.maximum(1, lengths - qs + 1 - qs * budgets)
    by_q = []
    for k in sorted(set(qs.tolist())):
        own = np.flatnonzero(qs == k)
        grams = [qgrams(points(texts[i]), k) for i in own]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(flat >> U(64 - SIEVE_BITS)).astype(np.int64)] = True
        item = np.repeat(own, [len(g) for g in grams])[order]
        offset = np.concatenate([np.arange(len(g)) for g in grams])[order]
        known, at = np.unique(flat[order], return_index=True)
        by_q.append(Index(k, known, np.r_[at, len(flat)], item, offset, sieve))
    return Passages([i for i, _ in kept], texts, budgets, needed, by_q)


def regions(text: np.ndarray, index: Index, budgets: np.ndarray, needed: np.ndarray) -> list[tuple[int, int]]:
    """(passage, band) pairs whose band of diagonals holds enough distinct q-grams of the passage."""
    grams = qgrams(text, index.q)
    at = np.flatnonzero(index.sieve[(grams >> U(64 - SIEVE_BITS)).astype(np.int64)])
    if not len(at):
        return []
    place = np.minimum(np.searchsorted(index.grams, grams[at]), len(index.grams) - 1)
    known = index.grams[place] == grams[at]
    at, place = at[known], place[known]
    low = index.at[place]
    count = index.at[place + 1] - low
    total = int(count.sum())
    if not total:
        return []
    place = np.arange(total) + np.repeat(low - (np.cumsum(count) - count), count)
    item, offset, start = index.item[place], index.offset[place], np.repeat(at, count)
    # A passage with fewer q-grams in the whole text than a band needs has no region.
    some = (np.bincount(item, minlength=len(needed)) >= needed)[item]
    if not some.any():
        return []
    item, offset, start = item[some], offset[some], start[some]
    band = (start - offset) // (budgets[item] + 1)
    # Keys of (passage, band): bands are numbered from the least possible one.
    least = -int(index.offset.max()) - 2
    width = len(text) - least + 2
    key = np.concatenate([item * width + band - least, item * width + band - 1 - least])
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    often = np.diff(np.r_[start, len(key)]) >= needed[key[start] // width]
    out = []
    both = np.concatenate([offset, offset])[order]
    ends = np.r_[start[1:], len(key)]
    for a, b in zip(start[often], ends[often], strict=True):
        i = int(key[a]) // width
        if len(set(both[a:b].tolist())) >= needed[i]:
            out.append((i, int(key[a]) % width + least))
    return out


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False) -> tuple[int, int]:
    """Least number of edits that turn the passage into a stretch of text, and that stretch's end.

    Cell (i, j) stands for the passage's first i characters and text before j; only low <= j - i <= high
    count. The stretch may start anywhere, or only at 0 if anchored; of equal ends the first is taken.
    """
    m, n, far = len(passage), len(text), 1 << 30
    width = high - low + 1
    diagonal = np.arange(low, high + 1)
    ramp = np.arange(width)
    row = np.where((diagonal >= 0) & (diagonal <= n), diagonal if anchored else 0, far)
    padded = np.full(m + width + 2, 0xFFFFFFFF, np.uint32)
    at = np.arange(low, low + len(padded))
    inside = (at >= 0) & (at < n)
    padded[inside] = text[at[inside]]
    for i in range(1, m + 1):
        j = diagonal + i
        step = row + (padded[i - 1 : i - 1 + width] != passage[i - 1])
        step = np.where(j >= 1, step, far)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step = np.where((j >= 0) & (j <= n), step, far)
        row = np.minimum.accumulate(step - ramp) + ramp
        row = np.where((j >= 0) & (j <= n), row, far)
    best = int(row.argmin())
    return int(row[best]), best + low + m


def matches(text: str, passages: Passages) -> list[tuple[int, int, int, int]]:
    """(passage number, start, end, edits) of the best occurrence of each passage in normalised text."""
    best: dict[int, tuple[int, int, int]] = {}
    whole = points(text)
    reach = passages.reach
    for at in range(0, max(1, len(whole) - reach), WINDOW):
        part = whole[at : at + WINDOW + reach]
        for index in passages.by_q:
            for i, band in regions(part, index, passages.budgets, passages.needed):
                e = int(passages.budgets[i])
                low, high = band * (e + 1) - e, (band + 2) * (e + 1) - 1 + e
                a, b = max(0, low), min(len(part), high + len(passages.texts[i]) + 1)
                if a >= b:
                    continue
                if (verbatim := text.find(passages.texts[i], at + a, at + b)) >= 0:
                    found = (0, verbatim, verbatim + len(passages.texts[i]))
                    best[i] = min(found, best.get(i, found))
                    continue
                pattern = points(passages.texts[i])
                stretch = part[a:b]
                edits, end = align(pattern, stretch, low - a, high - a)
                if edits > e:
                    continue
                back = align(pattern[::-1], stretch[:end][::-1], -edits, edits, anchored=True)[1]
                found = (edits, at + a + end - back, at + a + end)
                if i not in best or found < best[i]:
                    best[i] = found
    return [(i, s, t, e) for i, (e, s, t) in sorted(best.items())]




HIT = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])


def _search(passages):
    """Adds one block's occurrences to those found before."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("found", pa.list_(HIT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = passages.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [
                    [*before, *({"item_id": held.ids[i], "start": s, "end": t, "edits": e} for i, s, t, e in matches(normalise(text), held))]
                    for text, before in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                ]
                yield pa.record_batch([part.column(0), part.column(1), rows], schema=schema)

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 8, edit_percent: int = 8) -> DataFrame:
    """(doc_id, found): per document the passages it holds, as (item_id, start, end, edits).

    Texts are compared in lower case with white space collapsed and trimmed; start and end count characters
    of the text so normalised. A passage of m characters may have floor(m * edit_percent / 100) insertions,
    deletions and substitutions; its occurrence with fewest edits, then the first, is given. Passages without
    characters, null ones included, occur nowhere; a null document is empty. Rows of documents are kept as
    they come, null and repeated identifiers too. Items without rows give empty lists.
    """
    if q < 1 or edit_percent < 0:
        raise ValueError(f"q {q}, edit_percent {edit_percent}")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), text_or_empty(item_text_col).alias("text"))
    chars = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // INDEX_CHARS))
    kind = "array<struct<item_id:long,start:long,end:long,edits:int>>"
    out = source.withColumn("found", F.array().cast(kind))
    for k in range(passes):
        block = wanted.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(build([(r.item_id, r.text) for r in block], q, edit_percent))
        found = out.mapInArrow(released(_search(index)), f"doc_id long, text string, found {kind}")
        if passes == 1:
            out = found
            break
        # One block of the index is held at a time.
        before, out = out, written(found)
        index.destroy()
        if k:
            discard(before)
    return out.select("doc_id", "found")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items and items (ascending item_ids) of every document; see ``search``."""
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"])))
    return search(docs, items, **options).select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").alias("n_items"), ids.alias("items"), "found")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no passage, with their columns as they are; rows with one identifier go together."""
    bad = contamination(docs, items, id_col=id_col, **options).where("contaminated").select("doc_id")
    return without(docs, bad, F.col(id_col).cast("long"))
