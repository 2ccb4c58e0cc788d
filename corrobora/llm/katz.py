"""A Katz backoff model over words: training, partitioned tables, and scores of whole texts.

p(w|h) = r* / c(h) for an n-gram that training has, else alpha(h) * p(w|h'), where h' is h without its first word;
p(w) = r* / N for a seen word, with what is left for the one unknown word. A context that training lacks hands on to
h' as it is. r* is Katz's Good-Turing count of the order for r <= ``CUT``, and r - ``HIGH`` above it, so that every
context leaves some mass; alpha(h) makes each context sum to one. A text is preceded by one mark in place of all the
words that it lacks before its first.

Work goes by blocks of documents, order by order. A block asks for its distinct words once; the owners of word buckets
add up counts and answer with identifiers. Then, for each order, it asks for its distinct n-grams, a context's known
identifier and a word's; the owners of buckets add up r, and answer with r, with identifiers of what they have, and,
of contexts from which the block backs off, with their sums, from which alpha follows exactly. N-grams are dealt by
context; a context with more than a quarter of a bucket's share of all tokens is dealt by n-gram instead. There are at
most four times as many of these as buckets, so their alphas, and only theirs, go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm import ragged
from corrobora.llm.common import discard, held_out, partitions, stable, text_or_empty, written
from corrobora.llm.wordhash import blocks, mix, word_hashes

U = np.uint64
BLOCK = 8 << 20
#: Bytes of text to a bucket; what an owner holds at a time is some twenty times as much.
BUCKET = 32 << 20
CUT = 5
HIGH = 0.1
#: The end of a text as a word hash, and identifiers that are no word's: an unknown word, a text's start.
#: No word has the hash 0: every word has a length.
END = U(0)
UNKNOWN, START, FIRST_ID = 0, 1, 2


#: Kept, as making one for each blob takes longer than most blobs do.
PACKER, UNPACKER = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def pack(array: np.ndarray) -> bytes:
    """Integers that are not negative, each byte apart, compressed; the number of bytes that the largest one needs
    comes first, and no other bytes follow."""
    array = np.ascontiguousarray(array, "<i8")
    width = -(-int(array.max(initial=1)).bit_length() // 8)
    return bytes([width]) + PACKER.compress(np.ascontiguousarray(array.view(np.uint8).reshape(-1, 8)[:, :width].T))


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(UNPACKER.decompress(memoryview(blob)[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view("<i8").reshape(-1)


@dataclass
class Discount:
    """r* for counts, from the numbers of types seen 1 to CUT + 1 times."""

    ratio: np.ndarray  # of r = 0, 1, ..., CUT

    @classmethod
    def good_turing(cls, types: list[int]) -> Discount:
        """Katz's ratios; if the numbers of types do not give ones between 0 and 1, (r - 1/2) / r."""
        n = [0.0, *map(float, types)]
        r = np.arange(1, CUT + 1)
        plain = np.r_[0.0, (r - 0.5) / r]
        if min(n[1 : CUT + 1]) <= 0:
            return cls(plain)
        most = (CUT + 1) * n[CUT + 1] / n[1]
        raw = np.array([(k + 1) * n[k + 1] / n[k] / k for k in r])
        ratio = (raw - most) / (1 - most) if most < 1 else raw * np.nan
        return cls(np.r_[0.0, ratio] if np.all((ratio > 0) & (ratio < 1)) else plain)

    def kept(self, r: np.ndarray) -> np.ndarray:
        return np.where(r <= CUT, self.ratio[np.minimum(r, CUT)] * r, r - HIGH)

    def left(self, types: np.ndarray, above: np.ndarray) -> np.ndarray:
        """What the discounts leave, from numbers of types with r = 1, ..., CUT and with a higher r."""
        r = np.arange(1, CUT + 1)
        return types @ ((1 - self.ratio[1:]) * r) + HIGH * above


@dataclass
class Words:
    """What training knows of single words."""

    tokens: int
    types: int
    texts: int
    discount: Discount
    unknown: float

    @classmethod
    def of(cls, sums: list[int]) -> Words:
        tokens, types, texts, *by_count = (int(x or 0) for x in sums)
        discount = Discount.good_turing(by_count)
        left = discount.left(np.array(by_count[:CUT], float), types - sum(by_count[:CUT]))
        return cls(tokens, types, texts, discount, float(left) / tokens if tokens else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discount.kept(c) / max(1, self.tokens), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


ROW = "block binary, level int, bucket int, a binary, b binary, c binary, d binary, e binary, f binary, sums array<long>"
ROWS = pa.schema([("block", pa.binary()), ("level", pa.int32()), ("bucket", pa.int32()), *((x, pa.binary()) for x in "abcdef"), ("sums", pa.list_(pa.int64()))])
DOCS = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("n", pa.int64())])


def row(block: bytes | None, level: int, bucket: int, *blobs: bytes | None, sums: list[int] | None = None) -> tuple:
    return block, level, bucket, *blobs, *[None] * (6 - len(blobs)), sums


def rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([list(c) for c in zip(*found, strict=True)] if found else [[] for _ in ROWS], schema=ROWS)


def table_of(found: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([rows(found)])


def columns(batch) -> list[list]:
    return [batch.column(k).to_pylist() for k in range(len(ROWS))]


def _docs_blob(ids: pa.Array, held: pa.Array, n: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, DOCS) as out:
        out.write_batch(pa.record_batch([ids, held, pa.array(n, pa.int64())], schema=DOCS))
    return sink.getvalue().to_pybytes()


def _docs(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of each bucket in an array sorted by bucket."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), slice(edges[k], edges[k + 1])


def _ask_words(buckets: int):
    """Blocks of documents to their distinct words by bucket, and to one row of positions (bucket -1).

    Within a bucket words stand by falling frequency in the block; the code of the i-th word of bucket b is
    i * buckets + b, so small codes are frequent ones and both kinds of rows agree without a list of words.
    """

    def ask(part: pa.RecordBatch) -> list[tuple]:
        texts = part.column(2).to_pylist()
        mark = xxhash.xxh3_128()
        for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
            mark.update(f"{doc_id},{len(text)}:".encode())
            mark.update(text)
        h, at = word_hashes(texts)
        n = np.diff(at) + 1
        found = pa.array(np.insert(h, at[1:], END)).dictionary_encode()
        words, code = found.dictionary.to_numpy(), found.indices.to_numpy()
        train = np.repeat(~part.column(1).to_numpy(zero_copy_only=False), n)
        trained = np.bincount(code[train], minlength=len(words))
        count = np.bincount(code, minlength=len(words))
        order = np.argsort(words)
        bucket = (words[order] % U(buckets)).astype(np.int64)
        order = order[ragged.ordered(bucket, len(code) - count[order])]
        bucket = (words[order] % U(buckets)).astype(np.int64)
        place, out = np.empty(len(words), np.int64), []
        for k, x in _by_bucket(bucket, buckets):
            place[order[x]] = np.arange(x.stop - x.start) * buckets + k
            out.append(row(mark.digest(), 1, k, words[order[x]].tobytes(), pack(trained[order[x]])))
        return [*out, row(mark.digest(), 1, -1, _docs_blob(part.column(0), part.column(1), n), pack(place[code]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for a, b in blocks(lengths, BLOCK):
                yield rows(ask(batch.slice(a, b - a)))

    return run


def _counts(total: np.ndarray) -> list[int]:
    """Numbers of types seen 1 to CUT + 1 times."""
    return np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()


def _answer_words(buckets: int):
    """A bucket of words: to each block its words' identifiers and training counts, then the bucket's sums."""

    def run(asked: pa.Table) -> pa.Table:
        block, _, bucket, words, trained, *_ = columns(asked)
        words, trained = [np.frombuffer(w, U) for w in words], [unpack(t) for t in trained]
        found = pa.array(np.concatenate(words)).dictionary_encode()
        known, code = found.dictionary.to_numpy(), found.indices.to_numpy()
        total = np.bincount(code, np.concatenate(trained), len(known)).astype(np.int64)
        order = np.lexsort((known, -total))
        ids = np.empty(len(known), np.int64)
        ids[order] = FIRST_ID + np.arange(len(known)) * buckets + bucket[0]
        ids[total == 0] = UNKNOWN
        edges = ragged.offsets(np.array([len(w) for w in words]))
        out = [row(b, 1, bucket[0], pack(ids[code[x:y]]), pack(total[code[x:y]])) for b, x, y in zip(block, edges[:-1], edges[1:], strict=True)]
        out.append(row(None, 1, bucket[0], sums=[int(total.sum()), int((total > 0).sum()), int(total[known == END].sum()), *_counts(total)]))
        return table_of(out)

    return run


LACKING = "a block lacks its positions or an answer"


def _number(buckets: int):
    """A block's positions and answers together: its tokens by number, and its words' identifiers and counts."""

    def run(given: pa.Table) -> pa.Table:
        block, _, bucket, a, b, *_ = columns(given)
        answers = {k: (unpack(x), unpack(y)) for k, x, y in zip(bucket, a, b, strict=True) if k >= 0}
        own = [i for i, k in enumerate(bucket) if k < 0]
        if not own:
            raise ValueError(LACKING)
        code = unpack(b[own[0]])
        width = int(code.max()) + buckets + 1
        ids, counts = np.full(width, -1, np.int64), np.zeros(width, np.int64)
        for k, (x, y) in answers.items():
            ids[k : k + len(x) * buckets : buckets], counts[k : k + len(y) * buckets : buckets] = x, y
        answered = ids >= 0
        if not answered[code].all():
            raise ValueError(LACKING)
        vocabulary, first, number = ragged.numbered(ids[answered])
        counts = counts[answered][first]
        ids[answered] = number
        found = row(block[0], 1, -1, a[own[0]], pack(ids[code]), pack(vocabulary), pack(np.where(vocabulary == UNKNOWN, 0, counts)))
        return table_of([found] * len(own))  # a block that occurs twice as a whole stays twice

    return run


class Grams:
    """One numbered block, with its distinct n-grams of one order after another.

    ``item`` is each token's n-gram of the current order by number; ``ids`` and ``r`` are the numbers' identifiers
    and training counts. The last number stands for any n-gram that training cannot have.
    """

    def __init__(self, blobs: tuple, words: Words, buckets: int):
        docs, tokens, vocabulary, counts = blobs
        self.words, self.buckets, self.level = words, buckets, 1
        self.docs = _docs(docs)
        self.n = self.docs.column("n").to_numpy()
        self.at = ragged.offsets(self.n)
        vocabulary = unpack(vocabulary)
        self.w = self.item = unpack(tokens)
        self.word_ids = self.ids = np.r_[vocabulary, UNKNOWN]
        self.r = np.r_[unpack(counts), 0]
        #: Of each token, the count of its n-gram's context; of single words, all tokens.
        self.context = np.full(len(self.w), words.tokens)

    def seen(self) -> np.ndarray:
        return self.r[self.item]

    def up(self) -> None:
        """The next order's contexts and the n-grams to be asked for, by bucket and then by context and word."""
        self.level += 1
        last = len(self.r) - 1
        self.lower, self.lower_context = self.seen(), self.context
        # Contexts by identifier, so that these rise; the start of a text has the lowest.
        order = ragged.rising(self.ids[:last])[1]
        rank = np.empty(last + 1, np.int64)
        rank[order], rank[last] = np.arange(1, last + 1), last + 1
        h = np.empty(len(self.w), np.int64)
        h[1:] = rank[self.item[:-1]]
        h[self.at[:-1]] = 0
        self.h = h
        self.context_ids = np.r_[START, self.ids[order], UNKNOWN]
        self.context_counts = np.r_[self.words.texts, self.r[order], 0]
        del order, rank
        self.context = self.context_counts[h]
        self.askable = self.context > 0
        # What training cannot have, as it lacks the shorter n-gram, is asked for as the unknown word: for the context.
        unknown = len(self.word_ids) - 1
        bits = unknown.bit_length()
        key, first, self.code = ragged.numbered((h << bits | np.where(self.lower > 0, self.w, unknown))[self.askable])
        gram_h = key >> bits
        self.hot = self.context_counts * 4 * self.buckets >= self.words.tokens
        hid, wid = self.context_ids[gram_h].astype(U), self.word_ids[key & ((1 << bits) - 1)].astype(U)
        bucket = (np.where(self.hot[gram_h], mix(hid * U(0x9E3779B97F4A7C15) + wid), mix(hid)) % U(self.buckets)).astype(np.int64)
        small = np.uint16 if self.buckets <= 1 << 16 else np.int64
        #: N-grams by bucket, and by context and word within it; where among them a bucket and a context start.
        self.order = np.argsort(bucket.astype(small), kind="stable")
        self.gram_h, self.gram_w, self.first = gram_h[self.order], wid[self.order].astype(np.int64), first[self.order]
        bucket = bucket[self.order]
        self.edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
        self.starts = np.flatnonzero(ragged.changes(bucket) | ragged.changes(self.gram_h))

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        """Of each bucket: its n-grams, and its contexts."""
        contexts = np.searchsorted(self.starts, self.edges)
        for k in np.flatnonzero(np.diff(self.edges)):
            yield int(k), slice(self.edges[k], self.edges[k + 1]), slice(contexts[k], contexts[k + 1])

    def asked(self, block: bytes) -> list[tuple]:
        train = np.repeat(~self.docs.column("held").to_numpy(), self.n)[self.askable]
        r = np.bincount(self.code[train], minlength=len(self.order))[self.order]
        # What the lower order says is needed once of what training has, and any block that trains on it has it.
        low = np.where(r > 0, self.lower[self.askable][self.first], 0)
        base = np.where(np.maximum.reduceat(r, self.starts) > 0, self.lower_context[self.askable][self.first[self.starts]], 0) if len(r) else r
        h = self.gram_h[self.starts]
        h, sizes = self.context_ids[h] * 2 + self.hot[h], np.diff(self.starts, append=len(r))
        return [
            row(block, self.level, k, pack(ragged.steps(h[c])), pack(sizes[c]), pack(base[c]), pack(self.gram_w[own]), pack(r[own]), pack(low[own]))
            for k, own, c in self.slices()
        ]

    def take(self, answers: dict[int, tuple]) -> tuple[np.ndarray, ...]:
        """Takes the order's answers: counts and identifiers become the block's, and the contexts' sums are given
        back as (numbers of the contexts, types, mass)."""
        k = len(self.order)
        total, ids = np.zeros(k, np.int64), np.full(k, UNKNOWN, np.int64)
        types, mass = [np.empty((0, CUT + 1), np.int64)], [np.empty(0)]
        for bucket, own, _ in self.slices():
            if bucket not in answers:
                raise ValueError(LACKING)
            counts, found, kinds, masses = answers[bucket]
            total[own] = counts = unpack(counts)
            if found:
                ids[own][counts > 0] = np.cumsum(unpack(found))
            if kinds:
                types.append(unpack(kinds).reshape(-1, CUT + 1))
                mass.append(np.frombuffer(masses, float))
        h = self.gram_h[self.starts]
        contexts = h[_backs_off(total, self.starts) & ~self.hot[h]] if len(types) > 1 else h[:0]
        self.r, self.ids = np.zeros(k + 1, np.int64), np.full(k + 1, UNKNOWN, np.int64)
        self.r[self.order], self.ids[self.order] = total, ids
        self.item = np.full(len(self.w), k)
        self.item[self.askable] = self.code
        # The next order has its own of these, and they would stand beside its.
        del self.lower, self.lower_context, self.askable, self.code, self.order, self.gram_h, self.gram_w, self.first, self.edges, self.starts
        return contexts, np.concatenate(types), np.concatenate(mass)


def _backs_off(total: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Has a context an n-gram among those asked for that training lacks?"""
    return np.minimum.reduceat(total, starts) == 0 if len(starts) else np.empty(0, bool)


def _answers(level: list, bucket: list, blobs: list[list]) -> dict[int, dict[int, tuple]]:
    """A block's answers by order and bucket; a block that occurs twice gets the same ones twice."""
    out: dict[int, dict[int, tuple]] = {}
    for k, b, *found in zip(level, bucket, *blobs, strict=True):
        if b >= 0:
            out.setdefault(k, {})[b] = tuple(found)
    return out


def _climb(given, words: Words, buckets: int) -> tuple[Grams, dict[int, dict[int, tuple]], list[bytes]]:
    block, level, bucket, *blobs, _ = columns(given)
    own = [i for i, k in enumerate(bucket) if k < 0]
    if not own:
        raise ValueError(LACKING)
    return Grams(tuple(blobs[k][own[0]] for k in range(4)), words, buckets), _answers(level, bucket, blobs[:4]), [block[i] for i in own]


def _ask_pairs(words: Words, buckets: int):
    """Order two needs no answers before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grams, _, blocks_ = _climb(batch.slice(k, 1), words, buckets)
                grams.up()
                yield rows(grams.asked(blocks_[0]))

    return run


def _ask_longer(words: Words, buckets: int):
    """A block with the answers of all orders below: its questions for the next one."""

    def run(given: pa.Table) -> pa.Table:
        grams, answers, own = _climb(given, words, buckets)
        for k in sorted(answers):
            grams.up()
            grams.take(answers[k])
        grams.up()
        return table_of(grams.asked(own[0]) * len(own))

    return run


def _answer_grams(level: int, lower: Discount, buckets: int, last: bool):
    """A bucket of n-grams: to each block its r, identifiers unless it is the last order, and contexts' sums; of hot
    contexts their sums.

    The sums of a context are its numbers of types with r = 1, ..., CUT and above, and the sum of the lower order's
    p(w|h') over what was seen after it. Contexts whose identifiers are asked with the lowest bit set are hot; theirs
    come in one row of bucket -2 (block null), as other buckets hold the rest of them.
    """

    def run(asked: pa.Table) -> pa.Table:
        block, _, bucket, hs, sizes, bases, ws, trained, lowers, _ = columns(asked)
        contexts, sizes = [np.cumsum(unpack(x)) for x in hs], np.concatenate([unpack(x) for x in sizes])
        #: Of each row, where its contexts and its n-grams start.
        at = ragged.offsets(np.array([len(x) for x in contexts]))
        edges = ragged.offsets(sizes)
        h, _, number = ragged.numbered(np.concatenate(contexts))
        w, r, low, base = (np.concatenate([unpack(x) for x in blobs]) for blobs in (ws, trained, lowers, bases))
        found, order = ragged.rising(ragged.paired(np.repeat(number, sizes), w))
        new = ragged.changes(found)
        code = np.empty(len(w), np.int64)
        code[order] = np.cumsum(new) - 1
        context = np.repeat(number, sizes)[order[new]]
        total = np.bincount(code, r, len(context)).astype(np.int64)
        seen = total > 0
        ids = FIRST_ID + (np.cumsum(seen) - 1) * buckets + bucket[0]
        # Rows that train on an n-gram say the same of it, as do those that train on a context.
        trains, some = r > 0, base > 0
        lows, under = np.zeros(len(context), np.int64), np.ones(len(h), np.int64)
        lows[code[trains]], under[number[some]] = low[trains], base[some]
        p = np.where(seen, lower.kept(lows) / under[context], 0.0)
        types = np.bincount(context * (CUT + 2) + np.minimum(total, CUT + 1), minlength=len(h) * (CUT + 2)).reshape(-1, CUT + 2)[:, 1:]
        mass = np.add.reduceat(p, np.flatnonzero(ragged.changes(context)))
        hot = h % 2 == 1
        counts, given = total[code], ids[code]
        # Contexts from which a block backs off; the block tells them by the same rule.
        backs_off = _backs_off(counts, edges[:-1]) & ~hot[number]
        out = []
        for b, i, j in zip(block, at[:-1], at[1:], strict=True):
            own = counts[edges[i] : edges[j]]
            told = None if last else pack(ragged.steps(given[edges[i] : edges[j]][own > 0]))
            sums = number[i:j][backs_off[i:j]]
            out.append(row(b, level, bucket[0], pack(own), told, pack(types[sums].reshape(-1)), mass[sums].tobytes()))
        out.append(row(None, level, bucket[0], sums=_counts(total)))
        if hot.any():
            out.append(row(None, level, -2, pack(h[hot] // 2), pack(types[hot].reshape(-1)), mass[hot].tobytes()))
        return table_of(out)

    return run


def log_left(discount: Discount, types: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 of c(h) * alpha(h): the counts that the context leaves, over the mass of what was not seen after it."""
    left = discount.left(types[:, :CUT].astype(float), types[:, CUT].astype(float))
    return np.log10(left) - np.log10(1 - mass)


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(words: Words, discounts: list[Discount], buckets: int, hot: list[tuple[np.ndarray, np.ndarray]]):
    """A numbered block and its answers: the score of each token from the lowest order up, added by document."""

    def run(given: pa.Table) -> pa.Table:
        grams, answers, own = _climb(given, words, buckets)
        count = grams.seen()
        score = np.log10(words.p(count))
        for k, (discount, (ids, alphas)) in enumerate(zip(discounts, hot, strict=True), 2):
            grams.up()
            contexts, types, mass = grams.take(answers.get(k, {}))
            left = np.full(len(grams.context_ids), np.nan)
            left[contexts] = log_left(discount, types, mass)
            if len(ids):
                at = np.minimum(np.searchsorted(ids, grams.context_ids), len(ids) - 1)
                known = grams.hot & (ids[at] == grams.context_ids)
                left[known] = alphas[at[known]]
            # A context that training lacks hands on as it is.
            log_c = np.log10(np.maximum(grams.context_counts, 1))
            down = np.where(grams.context_counts > 0, left - log_c, 0.0)
            with np.errstate(divide="ignore"):
                kept = np.log10(discount.kept(grams.r))
            score = np.where(grams.seen() > 0, kept[grams.item] - log_c[grams.h], score + down[grams.h])
        if np.isnan(score).any():
            raise ValueError("a context's sums are missing")
        sums = [ragged.sums(v, grams.at) for v in ((count > 0).astype(np.int64), words.base(count), score)]
        part = pa.record_batch([grams.docs.column("doc_id").combine_chunks(), grams.docs.column("held").combine_chunks(), grams.n, *sums], schema=SCORES)
        return pa.Table.from_batches([part] * len(own))

    return run


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), *((f"t{i}", pa.int64()) for i in range(CUT + 1)), ("mass", pa.float64())])
    for batch in batches:
        for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield pa.record_batch([unpack(a), *unpack(b).reshape(-1, CUT + 1).T, np.frombuffer(c, float)], schema=schema)


def _sums(table: DataFrame, n: int) -> list[int]:
    return list(table.where("sums is not null").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n))).first())


class Katz:
    """A model of some order trained on the rows that are not held out, with all rows numbered by its words."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 1, order: int = 3):
        if order < 1:
            raise ValueError(f"order {order}")
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
        source = source.select("doc_id", held_out(modulus, remainder).alias("held"), "text")
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(3 * partitions(docs.sparkSession), -(-size // BUCKET))
        asked = written(source.mapInArrow(_ask_words(self.n), ROW))
        #: Words by bucket, then blocks as numbers, then n-grams by bucket, order by order.
        word_table = written(asked.where("bucket >= 0").groupBy("bucket").applyInArrow(_answer_words(self.n), ROW))
        self.words = Words.of(_sums(word_table, 3 + CUT + 1))
        self.blocks = written(asked.where("bucket < 0").unionByName(word_table.where("block is not null")).groupBy("block").applyInArrow(_number(self.n), ROW))
        discard(asked, word_table)
        self.discounts, self.hot, self.tables = [], [], []
        lower = self.words.discount
        for level in range(2, order + 1):
            if level == 2:
                asked = self.blocks.mapInArrow(_ask_pairs(self.words, self.n), ROW)
            else:
                asked = self._with_answers(sums=False).groupBy("block").applyInArrow(_ask_longer(self.words, self.n), ROW)
            self.tables.append(written(asked.groupBy("bucket").applyInArrow(_answer_grams(level, lower, self.n, level == order), ROW)))
            lower = Discount.good_turing([x or 0 for x in _sums(self.tables[-1], CUT + 1)])
            self.discounts.append(lower)
            self.hot.append(self._hot(self.tables[-1], lower))

    def _with_answers(self, sums: bool = True) -> DataFrame:
        """The blocks with all answers to them, without the contexts' sums where only questions are to follow."""
        given, none = self.blocks, F.lit(None).cast("binary")
        for table in self.tables:
            answers = table.where("block is not null")
            given = given.unionByName(answers if sums else answers.withColumns({"c": none, "d": none}))
        return given

    def _hot(self, table: DataFrame, discount: Discount) -> tuple[np.ndarray, np.ndarray]:
        """The hot contexts' alphas: at most four times as many as there are buckets."""
        kinds = [f"t{i}" for i in range(CUT + 1)]
        parts = table.where("block is null and bucket = -2").select("a", "b", "c").mapInArrow(_hot_rows, "id long, " + ", ".join(f"{k} long" for k in kinds) + ", mass double")
        found = parts.groupBy("id").agg(*(F.sum(k).alias(k) for k in kinds), F.sum("mass").alias("mass")).toArrow().sort_by("id")
        types = np.stack([found.column(k).to_numpy() for k in kinds], 1)
        return found.column("id").to_numpy(), log_left(discount, types, found.column("mass").to_numpy())

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
        found = self._with_answers().groupBy("block").applyInArrow(_score(self.words, self.discounts, self.n, self.hot), SCORE)
        return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.words.tokens).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 1, order: int = 3) -> DataFrame:
    r"""Trains on the rows whose crc32 of the identifier does not leave ``remainder`` and scores all rows.

    Words are runs of bytes other than space and \x09-\x0D with A-Z lowered, then comes one end. A null text
    counts as empty and is one end; a null identifier counts as ''. n_known counts tokens that occur in
    training. base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens; score adds the log10
    probabilities of the model of that ``order``, both rounded to six decimals. Without training rows every token
    is unknown with probability one. Repeated rows train and are scored as often as they occur; an empty table
    gives no rows; other columns are ignored. Words are told apart by 64-bit hashes; all else is by number. Input
    that is no stored table is written first, as it is read twice, for its size and for its words.
    """
    return Katz(stable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "id", "text", modulus, remainder, order).scores()
