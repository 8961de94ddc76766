r"""Benchmark decontamination with a broadcast set of normalised n-grams.

Texts are lower-cased (A-Z) and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
A benchmark window is 10 consecutive words of an item, or the whole item if it has
fewer. The set holds the sorted hashes of all windows with where each stands in the
items' normalised text; a document's words are looked up in the sorted hashes of the
benchmark's words, and only stretches of known words are scanned with rolling hashes.
Every hash hit is verified against the item's words, so results are exact.

The set is broadcast in blocks of at most ``block_words`` item words: a benchmark
within one block takes one pass over the documents; a larger one takes one pass for
each block, the hits travelling with the rows, so that no executor ever holds more
than a block.

Defined cases: a null text has no words, on either side; empty items give no window;
items with equal words all count; a null item_id is written as the empty string;
rows with a null or repeated doc_id each get their row; an empty benchmark hits
nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.llm.common import chunked, fresh, materialise, word_hashes

WINDOW = 10
#: Words of benchmark items in one broadcast block, at about 60 bytes each (see the test).
BLOCK_WORDS = 1_000_000
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class Windows:
    """A block of benchmark windows in arrays: the items' words end to end, and for each width the sorted hashes of its windows with the word where each begins."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        lists = [normalised(t) for _, t in items]
        counts = np.array([len(x) for x in lists], np.int64)
        words = [w for x in lists for w in x]
        self.first = np.cumsum(counts) - counts  # of each item, among all words
        lens = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.concatenate([[0], np.cumsum(lens + 1)])  # of each word, in the text
        self.text = b" ".join(words)
        hashes = word_hashes(words)
        self.vocabulary = np.unique(hashes)
        self.widths = {}
        width_of = np.minimum(counts, window)
        item = np.repeat(np.arange(len(items)), counts)
        left = np.repeat(self.first + counts, counts) - np.arange(len(words))  # words of the item from each word on
        for width in np.unique(width_of[width_of > 0]).tolist():
            at = np.flatnonzero((width_of[item] == width) & (left >= width))
            rolled = self._hash(hashes, width)[at]
            order = np.argsort(rolled, kind="stable")
            self.widths[width] = (rolled[order], at[order].astype(np.int32))

    @staticmethod
    def _hash(hashes: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            out = out * _MULTIPLIER + hashes[k : k + len(out)]
        return out

    def occurrences(self, words: list[bytes], offsets: np.ndarray) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, width, items) of every occurrence in the texts that hold the words from offset to offset."""
        if not len(self.vocabulary) or not words:
            return
        hashes = word_hashes(words)
        known = self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)] == hashes
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        gaps = np.concatenate([[0], np.cumsum(~known)])
        for width, (held, at) in self.widths.items():
            n = len(words) - width + 1
            if n <= 0:
                continue
            starts = np.flatnonzero((gaps[width:] == gaps[:n]) & (text[:n] == text[width - 1 :]))
            if not len(starts):
                continue
            found = self._hash(hashes, width)[starts]
            lo, hi = np.searchsorted(held, found, "left"), np.searchsorted(held, found, "right")
            memo: dict[bytes, set[int]] = {}
            for i, a, b in zip(starts[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                said = b" ".join(words[i : i + width])
                if said not in memo:
                    memo[said] = self._items(said, at[a:b], width)
                if memo[said]:
                    yield i, width, memo[said]

    def _items(self, said: bytes, at: np.ndarray, width: int) -> set[int]:
        """The items of those windows that consist of the words said."""
        same = [k for k in at.tolist() if self.text[self.begin[k] : self.begin[k + width] - 1] == said]
        return set((np.searchsorted(self.first, same, "right") - 1).tolist()) if same else set()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, streamed to the driver partition by partition, in blocks of at most ``block_words`` words (or one item)."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.encode(F.col(text_col), "UTF-8")).toLocalIterator():
        text = bytes(row[1] or b"")
        n = len(normalised(text))
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        block.append((row[0] or "", text))
        held += n
    if block:
        yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, names: tuple[str, str, str] = ("__words", "__hits", "__items"), finish=None) -> DataFrame:
    """The rows of docs, all columns, with three more by names: how many words, numbers of the words hit, ids of the items (sorted as strings). Columns of these names are an error. finish (rows, texts, hits, numbers of words -> rows of docs): what the last pass makes of them instead, in the same worker."""
    if taken := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns {sorted(taken)}: give other names")
    spark = docs.sparkSession
    out = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.array().cast("array<int>"), names[2]: F.array().cast("array<string>")})
    schema = out.schema
    columns = schema.names
    blocks = _blocks(benchmark, id_col, item_text, block_words)
    block = next(blocks, [])
    while True:
        held = spark.sparkContext.broadcast(Windows(block, window))
        following = next(blocks, None)

        last = finish if following is None else None

        def kernel(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            windows = held.value
            for part, texts in chunked(batches, text_col):
                lists = [normalised(t) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                hits = [set(x) for x in part.column(len(columns) - 2).to_pylist()]
                items = [set(x) for x in part.column(len(columns) - 1).to_pylist()]
                for first, width, of in windows.occurrences([w for x in lists for w in x], offsets):
                    t = int(np.searchsorted(offsets, first, "right")) - 1
                    hits[t].update(range(first - int(offsets[t]), first - int(offsets[t]) + width))
                    items[t].update(windows.ids[k] for k in of)
                if last:
                    yield last(part, texts, hits, np.diff(offsets).tolist())
                    continue
                new = [pa.array(np.diff(offsets)), pa.array([sorted(x) for x in hits], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns) - 3], *new], names=columns)

        out = out.mapInArrow(kernel, docs.schema if last else schema)
        if following is None:
            return out
        out = materialise(out, "hits")
        block = following


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of docs without the spans that occur in the benchmark: from the first character of a run of hit words to its last; a document of which no word is left goes. Documents without a hit are left as they are."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def finish(part: pa.RecordBatch, texts: list[bytes], hits: list[set[int]], n_words: list[int]) -> pa.RecordBatch:
        old = part.column(at)
        new = [None if null else cut(t, h) if h else t.decode("utf-8", "replace") for null, t, h in zip(old.is_null().to_pylist(), texts, hits, strict=True)]
        stays = pa.array([not h or len(h) < n for h, n in zip(hits, n_words, strict=True)])
        cols = list(part.columns[: len(schema.names)])
        cols[at] = pa.array(new, old.type)
        return pa.RecordBatch.from_arrays(cols, names=schema.names).filter(stays)

    names = tuple(fresh(docs, n) for n in ("__words", "__hits", "__items"))
    out = find_hits(docs, benchmark, text_col=text_col, names=names, finish=finish, **options)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(schema[length_col].dataType))
    return out


def cut(text: bytes, hits: set[int]) -> str:
    """The text without its hit words, and without what stands between two of them in a row."""
    clean = text.translate(_KEEP)
    out, kept_to, at, last_hit = [], 0, 0, None
    for k, w in enumerate(clean.split()):
        begin = clean.index(w, at)
        at = begin + len(w)
        if k in hits:
            if last_hit != k - 1:
                out.append(text[kept_to:begin])
            kept_to, last_hit = at, k
    return b"".join([*out, text[kept_to:]]).decode("utf-8", "replace")


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of the contract: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.size("__hits").cast("long")
    return found.select("doc_id", F.col("__words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
