r"""Scoring by a hierarchical Pitman-Yor language model.

Tokens are lower-cased words and one end of text. The context of a token is the whole word
before it (or the start of the text); contexts share as parent the restaurant of their
class (64: the start, words that end a sentence, and 62 by the last two bytes), and classes
share the root, whose base is uniform over all known words and one unknown. No context is
left out or merged, so the model grows with the corpus.

The model lives in *buckets* of words and is never whole anywhere:

1. Texts are dealt into shards of about ``SHARD_BYTES``. A shard sends each bucket the
   distinct pairs of word and context of its texts with their counts in training texts.
2. A bucket adds up the counts. Every pair starts with one table.
3. ``burn`` Gibbs sweeps (see seating.py) draw the numbers of tables of each bucket's words.
4. All totals are shared: tables of each context (a join), of classes and root, and the
   discounts are drawn from their conditionals on a grid.
5. Buckets repeat the first sweeps (they are seeded, so nothing was stored), go on for
   ``keep`` sweeps and average the probabilities, and answer each shard's pairs.
6. Shards ask their contexts' buckets for back-off weights, look up all tokens and add up.

Within a round of sweeps a bucket sees other buckets' totals as they were when last shared
(its own changes count at once), the usual parallel approximation of Gibbs sampling. Words
with over a part 1/HOT_PARTS of all tokens, fewer than that many, are split over buckets
by context; their upper levels are drawn on the driver when totals are shared. The
averaged back-off weight and the averaged probability given the class are multiplied as if
they varied independently.

Words are known by 60 bits of their hash, contexts in a bucket by their class and 34 bits.
Defined cases: a null text is empty and has its end as only token; a null id counts as the
empty string for the split; repeated rows each count and each get their row; with no
training tokens every probability is that of the base; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.llm.common import chunked, discard, give_back, materialise, mix64, word_hashes
from dyadica.llm.seating import CLASSES, Core, Parent, Seats, Totals, binned, draw, draw_discount, rho

END = 0
#: Stands for the end of a text among lower-cased words, none of which has this letter.
_MARK = b"A"
SHARD_BYTES = 6 << 20
#: Shards by buckets.
SHARDS_EACH = 1
#: Shards at least, where each has a megabyte, so that small inputs use all cores.
LEAST_SHARDS = 16
HOT_PARTS = 4096
#: Tokens that a worker counts at once when it looks for hot words.
HELD = 1_000_000
_HASH = 34
_CTX = (1 << 40) - 1
#: Words and contexts of a shard or bucket are paired in one number: place of the word, then context.
_PAIR = 40


def _keys(words: list[bytes]) -> np.ndarray:
    """60 bits of the hash of each word."""
    return np.maximum(word_hashes(words) >> np.uint64(4), np.uint64(1)).astype(np.int64)


def _words(texts: list[bytes]) -> pa.Array:
    r"""The lower-cased words ``[^\x20\x09-\x0D]+`` of each text, a mark after each text's."""
    joined = np.frombuffer(b" ".join([x for t in texts for x in (t.lower(), _MARK)]), np.uint8)
    own = (joined > 32) | (joined != 32) & (joined - np.uint8(9) > 4)  # 9 to 13 are spaces too
    begin = own.copy()
    begin[1:] &= ~own[:-1]
    letters, begin = joined[own], np.flatnonzero(begin[own])
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(letters))), pa.py_buffer(letters)])


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each token, keys by number, contexts that numbers make for the next token, offsets of texts). Only distinct words become objects and are hashed."""
    cut = _words(texts).dictionary_encode()
    token, words = cut.indices.to_numpy(), cut.dictionary
    del cut
    begin, letters = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1), np.frombuffer(words.buffers()[2], np.uint8)
    raw, at = letters.tobytes(), begin.tolist()
    words = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
    end = words.index(_MARK) if words else 0
    keys, lens = _keys(words), np.diff(begin)
    tail = begin[1:] - 1
    last = letters[tail].astype(np.uint64)
    before = np.where(lens > 1, letters[np.maximum(tail - 1, 0)], 0).astype(np.uint64)
    kind = np.where(np.isin(last, np.frombuffer(b".!?", np.uint8).astype(np.uint64)), 1, 2 + (mix64(last << np.uint64(8) | before) % np.uint64(CLASSES - 2)).astype(np.int64)).astype(np.int64)
    after = kind << _HASH | (keys & ((1 << _HASH) - 1))
    keys[end : end + 1], after[end : end + 1] = END, 0
    return token, keys, after, np.concatenate([[0], np.flatnonzero(token == end) + 1])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys (60 bits), contexts (class, then 34 bits of the hash of the word before), and the offset of each text's tokens."""
    token, keys, after, offsets = _cut(texts)
    return keys[token], np.concatenate([[0], after[token]])[:-1], offsets


@dataclass(frozen=True)
class Layout:
    """Into how many buckets words are dealt, and the words that are split with the number of their parts."""

    buckets: int
    hot: np.ndarray
    parts: np.ndarray

    def bucket(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        h = mix64(words.astype(np.uint64))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
            split = self.hot[at] == words
            h[split] += mix64(contexts[split].astype(np.uint64)) % self.parts[at[split]].astype(np.uint64)
        return (h % np.uint64(self.buckets)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.diff(x, prepend=x[0] - 1)) if len(x) else np.zeros(0, np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the place of each element among them; hashed, so that only distinct ones are sorted."""
    place, values = pd.factorize(x)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], rank[place]


def _narrow(contexts: np.ndarray) -> bytes:
    """Contexts in five bytes each."""
    return contexts.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.int64).ravel()


class Pairs:
    """A shard's distinct pairs of word and context by bucket, word and context, and which of them each token is."""

    def __init__(self, texts: list[bytes], trains: np.ndarray, layout: Layout):
        token, keys, after, self.offsets = _cut(texts)
        self.words, rank = _distinct(keys)
        word = rank[token] << _PAIR
        word[1:] |= after[token[:-1]]
        # each of them has a token after it
        after.sort()
        self.contexts = after[_runs(after)]
        del token, keys, after, rank
        both, self.token = np.unique(word, return_inverse=True)
        del word
        n = np.bincount(self.token, np.repeat(trains, np.diff(self.offsets)), len(both)).astype(np.int64)
        bucket = layout.bucket(self.words[both >> _PAIR], both & _CTX)
        order = np.argsort(bucket.astype(np.uint16) if layout.buckets <= 1 << 16 else bucket, kind="stable")  # by digits, where short
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.token = place[self.token]
        self.word, self.context, self.n, self.bucket = (both >> _PAIR)[order], (both & _CTX)[order], n[order], bucket[order]

    def parts(self) -> Iterator[tuple[int, slice]]:
        begin = _runs(self.bucket)
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(self.bucket)).tolist(), strict=True):
            yield int(self.bucket[a]), slice(a, b)

    def contexts_by(self, buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Distinct contexts by their own bucket (the remainder of their number), and where each bucket's stand."""
        contexts = self.contexts
        bucket = contexts % buckets
        order = np.argsort(bucket, kind="stable")
        begin = _runs(bucket[order])
        return contexts[order], [(int(bucket[order[a]]), slice(a, b)) for a, b in zip(begin.tolist(), np.append(begin[1:], len(order)).tolist(), strict=True)]

    def packed(self, part: slice) -> bytes:
        """Three sizes, words, contexts of each word, contexts (5 bytes), counts (1 byte, then those of 255 or more)."""
        word, contexts, n = self.word[part], self.context[part], self.n[part]
        begin = _runs(word)
        many = n[n >= 255]
        sizes = np.array([len(begin), len(word), len(many)], np.int64)
        each = np.diff(np.append(begin, len(word))).astype(np.int32)
        return b"".join([sizes.tobytes(), self.words[word[begin]].tobytes(), each.tobytes(), _narrow(contexts), np.minimum(n, 255).astype(np.uint8).tobytes(), many.tobytes()])


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, contexts of each word, contexts, counts) of packed pairs."""
    words, pairs, many = np.frombuffer(blob, np.int64, 3).tolist()
    at = 24
    keys = np.frombuffer(blob, np.int64, words, at)
    each = np.frombuffer(blob, np.int32, words, at := at + 8 * words)
    contexts = _wide(blob[(at := at + 4 * words) : at + 5 * pairs])
    n = np.frombuffer(blob, np.uint8, pairs, at := at + 5 * pairs).astype(np.int64)
    n[n == 255] = np.frombuffer(blob[at + pairs :], np.int64, many)
    return keys, each.astype(np.int64), contexts, n


class Bucket:
    """The pairs of all shards in a bucket, added up."""

    def __init__(self, blobs: list[bytes]):
        asked = [unpacked(b) for b in blobs]
        self.words, at = _distinct(np.concatenate([a[0] for a in asked]))
        self.word_at = np.split(at, np.cumsum([len(a[0]) for a in asked])[:-1])
        both = np.concatenate([np.repeat(w, a[1]) << _PAIR | a[2] for w, a in zip(self.word_at, asked, strict=True)])
        n, ends = np.concatenate([a[3] for a in asked]), np.cumsum([len(a[2]) for a in asked])[:-1]
        del asked
        self.both, at = np.unique(both, return_inverse=True)
        del both
        self.pair_at = np.split(at, ends)
        self.n = np.bincount(at, n, len(self.both)).astype(np.int64)
        self.seen = self.n > 0

    def core(self) -> Core:
        both, n = self.both[self.seen], self.n[self.seen]
        entry_of = both >> _HASH  # word and class
        begin = _runs(entry_of)
        entry = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(both))))
        more = n > 1
        keys = entry_of[begin]
        return Core(self.words, keys >> (_PAIR - _HASH), keys & (CLASSES - 1), np.bincount(entry[~more], minlength=len(begin)), entry[more], both[more] & _CTX, n[more])


_FOUND = "what int, bucket int, shard int, key long, a double, b double, c double, blob binary"
_KINDS = pa.schema([("what", pa.int32()), ("bucket", pa.int32()), ("shard", pa.int32()), ("key", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64()), ("blob", pa.binary())])
#: What rows hold: contexts; sums by class; sums by word of the split ones; bins of tables; others; packed pairs or answers.
CONTEXT, CLASS, SPLIT, BINS, SUMS, BLOB = range(6)
#: Packed pairs are held in so many folders by bucket, and answered and deleted one after the other.
FOLDERS = 4


def _rows(what: int | np.ndarray, n: int, **columns) -> pa.RecordBatch:
    """n rows of one kind (or a kind each), columns not named null."""
    cols = {"what": np.full(n, what, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _KINDS], schema=_KINDS)


def _blobs(table: pa.Table) -> tuple[list[bytes], list[int]]:
    """Packed pairs and their shards, by shard."""
    order = np.argsort(table["shard"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    return table["blob"].to_pylist(), table["shard"].to_pylist()


def hot_words(docs: DataFrame, buckets: int) -> Layout:
    """Words with more than a part 1/HOT_PARTS of all tokens, each in as many parts as keep one to a quarter of a bucket."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            counted = pa.chunked_array(held).value_counts()
            words, n = counted.field("values"), counted.field("counts").to_numpy()
            often = np.flatnonzero(n * HOT_PARTS > size)
            words = words.take(pa.array(often)).to_pylist()
            keys = np.where([w == _MARK for w in words], END, _keys(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.append(keys, -1)), pa.array(np.append(n[often], size))], names=["word", "n"])

        for _, texts in chunked(batches, "text"):
            held.append(_words(texts))
            size += len(held[-1])
            if size >= HELD:
                yield flushed()
                held, size = [], 0
        if size:
            yield flushed()

    counted = materialise(docs.select("text").mapInArrow(kernel, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "hot")
    total = (counted.where("word = -1").first() or {"n": 0})["n"]
    often = sorted((r["word"], r["n"]) for r in counted.where((F.col("word") >= 0) & (F.col("n") * HOT_PARTS > total)).collect())
    return Layout(buckets, np.array([w for w, _ in often], np.int64), np.array([max(1, min(buckets, math.ceil(4 * buckets * n / total))) for _, n in often], np.int64))


def _sums(found: DataFrame, what: int, *keys: str) -> list[tuple]:
    rows = found.where(F.col("what") == what).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).collect()
    return sorted(tuple(r) for r in rows)


def _by_class(rows: list[tuple], at: int) -> np.ndarray:
    out = np.zeros(CLASSES, np.int64)
    for r in rows:
        out[r[0]] = int(r[at])
    return out


def _split_table(rows: list[tuple], hot: np.ndarray, at: int) -> np.ndarray:
    """Sums (key, class, ...) of split words by word and class."""
    out = np.zeros((len(hot), CLASSES), np.int64)
    for r in rows:
        out[np.searchsorted(hot, r[0]), r[1]] = int(r[at])
    return out


def _merged(layout: Layout):
    """A bucket's sums: its core, and what it adds to contexts, classes, split words and all."""

    def kernel(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        held = Bucket(_blobs(table)[0])
        core = held.core()
        context, n = (held.both & _CTX)[held.seen], held.n[held.seen]
        contexts, at = np.unique(context, return_inverse=True)
        wanted = np.zeros(len(contexts), bool)
        wanted[at[n > 1]] = True
        count = np.bincount(held.both[held.seen] >> _PAIR, n, len(held.words))  # of each word in training
        split = np.isin(held.words, layout.hot)
        inside = np.bincount(core.pair_entry, minlength=len(core.entry_word)) + core.once
        cold = ~split[core.entry_word]
        tables = np.bincount(core.entry_word[cold], minlength=len(held.words))
        often = np.flatnonzero(~cold)
        out = [
            _rows(BLOB, 1, bucket=[bucket], blob=[pickle.dumps(core, 5)]),
            _rows(CONTEXT, len(contexts), bucket=np.where(wanted, bucket, -1), key=contexts, a=np.bincount(at, n, len(contexts)), b=np.bincount(at, minlength=len(contexts))),
            _rows(CLASS, CLASSES, key=np.arange(CLASSES), a=np.bincount(core.entry_class[cold], inside[cold], CLASSES), b=np.bincount(core.entry_class[cold], minlength=CLASSES)),
            _rows(SPLIT, len(often), key=held.words[core.entry_word[often]], shard=core.entry_class[often], a=inside[often]),
            _rows(SPLIT, int((split & (count > 0)).sum()), key=held.words[split & (count > 0)], shard=np.full(int((split & (count > 0)).sum()), -1), a=count[split & (count > 0)]),
            # customers of a level once and twice, by which discounts start
            _rows(SUMS, 4, key=np.arange(4), a=[(~split & (count > 0)).sum(), (n == 1).sum(), (inside == 1).sum(), (tables == 1).sum()], b=[count[~split].sum(), (n == 2).sum(), (inside == 2).sum(), (tables == 2).sum()]),
        ]
        give_back()
        return pa.Table.from_batches(out, _KINDS)

    return kernel


@dataclass(frozen=True)
class Model:
    """Answers to all shards about their pairs and their contexts (shard, bucket, blob), and what all words share."""

    answers: DataFrame
    contexts: DataFrame
    totals: Totals
    train_tokens: int


def _context_tables(right: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    keys = right["key"].to_numpy()
    order = np.argsort(keys)
    return keys[order], right[name].to_numpy().astype(np.int64)[order]


def _seeded(seed: int, bucket: int, phase: int) -> np.random.Generator:
    return np.random.default_rng([seed, bucket, phase])


def _burnt(first: Totals, burn: int, seed: int):
    """What a bucket's words add to all totals after ``burn`` sweeps."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = left["bucket"][0].as_py()
        core = pickle.loads(left["blob"][0].as_py())
        contexts, tables = _context_tables(right, "t0")
        seats = Seats(core, first, contexts, tables)
        rng = _seeded(seed, bucket, 0)
        for _ in range(burn):
            seats.sweep(rng)
        more = np.bincount(seats.ctx, seats.pt - 1, len(contexts))
        cold = ~seats.hot[core.entry_word]
        often = np.flatnonzero(~cold)
        out = [
            _rows(CONTEXT, int((more > 0).sum()), key=contexts[more > 0], a=more[more > 0]),
            _rows(CLASS, CLASSES, key=np.arange(CLASSES), a=np.bincount(core.entry_class[cold], seats.ce[cold], CLASSES), b=np.bincount(core.entry_class[cold], seats.te[cold], CLASSES)),
            _rows(SPLIT, len(often), key=core.keys[core.entry_word[often]], shard=core.entry_class[often], a=seats.own[often]),
            _rows(SUMS, 1, key=[0], a=[seats.c0[~seats.hot].sum()], b=[seats.t0[~seats.hot].sum()]),
        ]
        word = ~seats.hot & (seats.c0 > 0)
        for level, n, t in ((0, seats.c0[word], seats.t0[word]), (1, seats.ce[cold], seats.te[cold]), (2, core.pair_n, seats.pt)):
            keys, many, sum_n, sum_t = binned(n, t)
            out.append(_rows(BINS, len(keys), shard=np.full(len(keys), level), key=keys, a=many, b=sum_n, c=sum_t))
        give_back()
        return pa.Table.from_batches(out, _KINDS)

    return kernel


def _shared(first: Totals, found: DataFrame, restaurants: list[tuple[float, float]], seed: int) -> Totals:
    """Totals after the first sweeps, the split words' upper levels drawn, and new discounts."""
    rng = np.random.default_rng([seed, 1 << 40])
    classes = _sums(found, CLASS, "key")
    sums = {r[0]: r for r in _sums(found, SUMS, "key")}
    c0, t0 = (int(x) for x in sums[0][1:3]) if sums else (0, 0)
    C, T = _by_class(classes, 1), _by_class(classes, 2)
    ce = _split_table(_sums(found, SPLIT, "key", "shard"), first.hot, 2)
    te, root = first.hot_tables.copy(), first.hot_root.copy()
    d0, d1, _ = first.discounts
    s = first.strength
    w, k = np.nonzero(ce > 1)
    if len(w):
        t = te[w, k]
        te[w, k] = draw(rng, ce[w, k], t, (T + te.sum(0))[k] - t, Parent(te.sum(1)[w] - t, root[w], rho(te.sum(1), root, d0)[w], c0 + te.sum() - t, d0), d1, s)
        at = np.flatnonzero(te.sum(1) > 1)
        root[at] = np.minimum(root[at], te.sum(1)[at])
        root[at] = draw(rng, te.sum(1)[at], root[at], t0 + root.sum() - root[at], Parent(log_base=first.log_base), d0, s)
    seated = {0: [], 1: [], 2: []}
    for level, _, many, n, t in _sums(found, BINS, "shard", "key"):
        seated[level].append((many, n / many, t / many))
    T, C = T + te.sum(0), C + ce.sum(0)
    C0, T0 = c0 + int(te.sum()), t0 + int(root.sum())
    seated[1] += [(1.0, a, b) for a, b in zip(ce[w, k].tolist(), te[w, k].tolist(), strict=True)]
    seated[0] += [(1.0, a, b) for a, b in zip(te.sum(1).tolist(), root.tolist(), strict=True) if a]
    many = {0: [(1.0, T0)] if T0 else [], 1: [(1.0, x) for x in T.tolist() if x], 2: restaurants}
    discounts = tuple(draw_discount(rng, seated[level], many[level], s) for level in range(3))
    return Totals(C, T, C0, T0, discounts, s, first.words, first.hot, ce, te, root)


def _answered(first: Totals, second: Totals, counts: np.ndarray, burn: int, keep: int, seed: int):
    """Answers to each shard, and the mean tables beyond one of each context, after ``burn`` sweeps and over ``keep`` more. counts: of the split words in training."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = left["bucket"][0].as_py()
        blobs, shards = _blobs(left)
        held = Bucket(blobs)
        core = held.core()
        contexts, tables = _context_tables(right, "t0")
        seats = Seats(core, first, contexts, tables)
        rng = _seeded(seed, bucket, 0)
        for _ in range(burn):
            seats.sweep(rng)
        seats.share(second, _context_tables(right, "t1")[1])
        rng = _seeded(seed, bucket, 1)
        asked = held.both >> _HASH  # words and classes that pairs ask for
        begin = _runs(asked)
        asked = asked[begin]
        word, kind = asked >> (_PAIR - _HASH), asked & (CLASSES - 1)
        trained = core.entry_word << (_PAIR - _HASH) | core.entry_class
        entry = np.minimum(np.searchsorted(trained, asked), max(0, len(trained) - 1))
        entry = np.where(trained[entry] == asked, entry, -1) if len(trained) else np.full(len(asked), -1)
        given, tables = np.zeros(len(asked)), np.zeros(len(core.pair_n))
        for _ in range(keep):
            seats.sweep(rng)
            given += seats.given_class(word, kind, entry) / keep
            tables += seats.pt / keep
        d2 = second.discounts[2]
        own = np.where(held.seen, held.n - d2, 0.0)
        own[held.n > 1] = core.pair_n - d2 * tables
        count = np.bincount(held.both >> _PAIR, held.n, len(held.words)).astype(np.int64)
        if len(second.hot):
            at = np.minimum(np.searchsorted(second.hot, held.words), len(second.hot) - 1)
            split = second.hot[at] == held.words
            count[split] = counts[at[split]]
        of_pair = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(held.both))))
        answers = []
        for words, pairs in zip(held.word_at, held.pair_at, strict=True):
            entries = of_pair[pairs]
            answers.append(b"".join([count[words].tobytes(), own[pairs].astype("<f4").tobytes(), given[entries[_runs(entries)]].astype("<f4").tobytes()]))
        more = np.bincount(seats.ctx, tables - 1, len(contexts))
        out = [_rows(BLOB, len(shards), bucket=np.full(len(shards), bucket), shard=shards, blob=answers), _rows(CONTEXT, int((more > 0).sum()), key=contexts[more > 0], a=more[more > 0])]
        del held, seats, core, blobs, answers
        give_back()
        return pa.Table.from_batches(out, _KINDS)

    return kernel


def _discount(one: float, two: float) -> float:
    """Where a discount starts: by how many words have one customer and two."""
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.05


def deal(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """docs (doc_id, text, held_out) with ``shard``, by a hash of id and text, and how many shards there are."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes), min(LEAST_SHARDS, size >> 20))
    shard = F.pmod(F.xxhash64("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))), F.lit(shards)).cast("int")
    return docs.withColumn("shard", shard).repartition(shards, "shard"), shards


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Texts (null: empty) and whether each is held out."""
    return [x or b"" for x in table["text"].cast(pa.large_binary()).to_pylist()], np.array(table["held_out"].to_pylist(), bool)


def fit(dealt: DataFrame, layout: Layout, burn: int = 2, keep: int = 3, strength: float = 1.0, seed: int = 7) -> Model:
    """Train on the rows of dealt that are not held out, and answer the pairs of all rows. Probabilities are averaged over ``keep`` sweeps."""

    def ask(table: pa.Table) -> pa.Table:
        texts, out = _texts(table)
        shard = table["shard"][0].as_py()
        pairs = Pairs(texts, ~out, layout)
        parts = list(pairs.parts())
        contexts, place = pairs.contexts_by(layout.buckets)
        rows = [_rows(BLOB + np.array([b % FOLDERS for b, _ in parts]), len(parts), bucket=[b for b, _ in parts], shard=np.full(len(parts), shard), blob=[pairs.packed(p) for _, p in parts]), _rows(CONTEXT, len(place), bucket=[b for b, _ in place], shard=np.full(len(place), shard), blob=[_narrow(contexts[p]) for _, p in place])]
        give_back()
        return pa.Table.from_batches(rows, _KINDS)

    asked = materialise(dealt.groupBy("shard").applyInArrow(ask, _FOUND), "asked", "what")
    by_bucket = lambda df: df.repartition(layout.buckets, "bucket")
    summed = materialise(by_bucket(asked.where(F.col("what") >= BLOB)).groupBy("bucket").applyInArrow(_merged(layout), _FOUND), "summed", "what")
    contexts = materialise(summed.where(F.col("what") == CONTEXT).groupBy("key").agg(F.sum("a").cast("long").alias("c"), F.sum("b").cast("long").alias("t0")), "contexts")

    sums = {r[0]: r for r in _sums(summed, SUMS, "key")}
    split = _sums(summed, SPLIT, "key", "shard")
    ce = _split_table([r for r in split if r[1] >= 0], layout.hot, 2)
    counts = np.zeros(len(layout.hot), np.int64)
    for r in split:
        if r[1] < 0:
            counts[np.searchsorted(layout.hot, r[0])] = int(r[2])
    te = (ce > 0).astype(np.int64)
    root = (counts > 0).astype(np.int64)
    classes = _sums(summed, CLASS, "key")
    C, T = _by_class(classes, 1) + ce.sum(0), _by_class(classes, 2) + te.sum(0)
    words = int(sums[0][1]) + int(root.sum()) if sums else 0
    start = tuple(_discount(*sums[k][1:3]) if sums else 0.05 for k in (3, 2, 1))
    first = Totals(C, T, int(T.sum()), words, start, strength, words, layout.hot, ce, te, root)
    train_tokens = int(sums[0][2] + counts.sum()) if sums else 0

    wanted = summed.where((F.col("what") == CONTEXT) & (F.col("bucket") >= 0)).select("bucket", "key")
    wanted = materialise(wanted.join(contexts.select("key", "t0"), "key"), "wanted")
    discard(summed, f"what={CONTEXT}")
    cores = summed.where(F.col("what") == BLOB).select("bucket", "blob")
    burnt = cores.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_burnt(first, burn, seed), _FOUND)
    burnt = materialise(burnt, "burnt", "what")
    discard(summed)
    excess = lambda df: df.where(F.col("what") == CONTEXT).groupBy("key").agg(F.sum("a").alias("more"))
    after = contexts.join(excess(burnt), "key", "left").select("key", "c", "t0", (F.col("t0") + F.coalesce("more", F.lit(0))).cast("long").alias("t1"))
    after = materialise(after, "after")
    discard(contexts)
    size = F.when(F.col("t1") <= 64, F.col("t1")).otherwise(1000 + F.floor(F.log2("t1") * 16))
    restaurants = [(r["n"], r["t"] / r["n"]) for r in after.where("t1 > 0").groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum("t1").alias("t")).orderBy("size").collect()]
    second = _shared(first, burnt, restaurants, seed)

    before, wanted = wanted, materialise(wanted.join(after.select("key", "t1"), "key"), "wanted")
    discard(before)
    kernel = _answered(first, second, counts, burn, keep, seed)
    answers = []
    for folder in range(FOLDERS):
        mine = asked.where(F.col("what") == BLOB + folder)
        theirs = wanted.where(F.col("bucket") % FOLDERS == folder)
        found = by_bucket(mine).groupBy("bucket").cogroup(by_bucket(theirs).groupBy("bucket")).applyInArrow(kernel, _FOUND)
        answers.append(materialise(found, "answers", "what"))
        discard(asked, f"what={BLOB + folder}")
    answers = reduce(DataFrame.union, answers)
    known = after.join(excess(answers), "key", "left").select("key", F.col("c").cast("double").alias("a"), (F.col("t0") + F.coalesce("more", F.lit(0.0))).alias("b"))
    known = known.withColumn("bucket", F.pmod("key", F.lit(layout.buckets)).cast("int"))
    here = by_bucket(asked.where(F.col("what") == CONTEXT)).groupBy("bucket").cogroup(by_bucket(known).groupBy("bucket")).applyInArrow(_weighed, _FOUND)
    here = materialise(here.select("shard", "bucket", "blob"), "weights")
    for table in (asked, wanted, after, burnt):
        discard(table)
    return Model(answers.where(F.col("what") == BLOB).select("shard", "bucket", "blob"), here, second, train_tokens)


def _weighed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Customers and tables of the contexts that each shard asks for, 0 where they have none."""
    keys = right["key"].to_numpy()
    order = np.argsort(keys)
    held = np.stack([np.append(right[x].to_numpy()[order], 0.0) for x in "ab"]).astype("<f4")
    keys, blobs = keys[order], []
    for blob in left["blob"].to_pylist():
        asked = _wide(blob)
        at = np.searchsorted(keys, asked)
        at[at < len(keys)] = np.where(keys[at[at < len(keys)]] == asked[at < len(keys)], at[at < len(keys)], len(keys))
        blobs.append(held[:, at].tobytes())
    return pa.Table.from_batches([_rows(CONTEXT, len(blobs), bucket=left["bucket"].to_numpy(), shard=left["shard"].to_numpy(), blob=blobs)], _KINDS)


def score(dealt: DataFrame, model: Model, layout: Layout, shards: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row that :func:`fit` saw."""
    totals, train_tokens = model.totals, model.train_tokens
    s, d2 = totals.strength, totals.discounts[2]

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, out = _texts(left)
        pairs = Pairs(texts, ~out, layout)
        held = dict(zip(right["bucket"].to_pylist(), right["blob"].to_pylist(), strict=True))
        contexts, place = pairs.contexts_by(layout.buckets)
        known = np.concatenate([np.frombuffer(held[-1 - b], "<f4").reshape(2, -1) for b, _ in place], axis=1).astype(float)
        order = np.argsort(contexts)
        at = order[np.searchsorted(contexts, pairs.context, sorter=order)]
        c, t = known[0, at], known[1, at]
        weight, behind = s + d2 * t, s + c
        p, count = np.zeros(len(pairs.word)), np.zeros(len(pairs.word), np.int64)
        for b, part in pairs.parts():
            raw = held[b]
            word = pairs.word[part]
            begin = _runs(word)
            n = len(word)
            count[part] = np.repeat(np.frombuffer(raw, np.int64, len(begin)), np.diff(np.append(begin, n)))
            own = np.frombuffer(raw, "<f4", n, 8 * len(begin)).astype(float)
            entry = word << (_PAIR - _HASH) | pairs.context[part] >> _HASH
            entries = _runs(entry)
            given = np.repeat(np.frombuffer(raw, "<f4", len(entries), 8 * len(begin) + 4 * n).astype(float), np.diff(np.append(entries, n)))
            p[part] = (own + weight[part] * given) / behind[part]
        known, base, own = (count > 0).astype(np.int64), np.log10((count + 1) / (train_tokens + totals.words + 1)), np.log10(p)
        begin, of = pairs.offsets[:-1], pairs.token
        rows = [left["doc_id"].combine_chunks(), left["held_out"].combine_chunks(), np.diff(pairs.offsets), np.add.reduceat(known[of], begin), np.full(len(texts), train_tokens, np.int64), np.add.reduceat(base[of], begin), np.add.reduceat(own[of], begin)]
        give_back()
        return pa.Table.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in rows], schema=_OUT)

    right = model.answers.union(model.contexts.withColumn("bucket", -1 - F.col("bucket")))
    return dealt.groupBy("shard").cogroup(right.repartition(shards, "shard").groupBy("shard")).applyInArrow(kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scores(docs: DataFrame, shard_bytes: int = SHARD_BYTES, **options) -> DataFrame:
    """Scores of all rows of docs (doc_id, text, held_out) by a model of those not held out."""
    dealt, shards = deal(docs, shard_bytes)
    layout = hot_words(docs, -(-shards // SHARDS_EACH))
    return score(dealt, fit(dealt, layout, **options), layout, shards)


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out): held out are the ids whose CRC-32 as text leaves 2 modulo 7."""
    crc = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc % 7 == 2).alias("held_out"))


def op4(docs: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return scores(split(docs))
