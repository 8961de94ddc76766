r"""Exact substring dedup by seed and extend.

A window is 20 consecutive words of one document. Each word covered by a window
whose words also start earlier (smaller document, or the same one before) goes.

Seeds are winnowed anchors: of the 15 six-word grams in a window, the rightmost
with the least hash. Equal windows choose equal anchors, so equal windows meet in
a join on anchors. An anchor occurrence stands for the run of windows that chose
it; the run extends up to 14 words to either side of the anchor, and its *class*
digests all its words. Occurrences of a class agree in full: all but the earliest
go. Where an anchor has several classes, the match ends inside the run: there the
earliest occurrence of each class is extended window by window against those of
the other classes. Covered windows join up to maximal repeats of 20 words or more.

Words are compared by a 64-bit hash; anchors with classes and windows by 128 bits over
those. Nothing is collected by anchor, class or window: minima are combined before the
shuffle and joined back with hot keys salted, so that one passage in a third of all
documents stays spread out. Only a
document's own runs come together in one row.

Defined cases: a null text has no words; fewer than 20 words are kept whole; windows
of repeated rows (same id and text) start equally early, so neither takes from the
other; ids are taken as unique, and where rows with different texts share one, a run
found in one counts in each; a null id sorts before all others; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.llm.common import chunked, join_hot, materialise, mix64, word_hashes, word_lists

WINDOW, GRAM = 20, 6
_SPAN = 32  # a run of windows is first * 32 + (windows - 1): at most 15 windows choose one anchor occurrence
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _rolled(h: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of ``width`` neighbours each."""
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(multiplier) + h[k : k + len(out)]
    return out


def _ranges(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, multiplier: int) -> np.ndarray:
    """Polynomial hashes of h[lo:hi], of at most WINDOW + 14 values each."""
    out = np.zeros(len(lo), np.uint64)
    width = hi - lo
    for k in range(int(width.max(initial=0))):
        on = width > k
        out[on] = out[on] * np.uint64(multiplier) + h[lo[on] + k]
    return out


def anchors(h: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts given by their word hashes: (text, anchor, class, first window, windows) of each anchor occurrence, by position."""
    choices = window - gram + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(h) - window + 1
    if n <= 0 or not (valid := text[:n] == text[window - 1 :]).any():
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = mix64(_rolled(h, gram, _MULTIPLIERS[0]))
    best, least = np.arange(n), grams[:n].copy()
    for k in range(1, choices):
        other = grams[k : k + n]
        take = other <= least
        least[take] = other[take]
        best[take] = (np.arange(n) + k)[take]
    begin = np.flatnonzero(valid & np.concatenate([[True], (best[1:] != best[:-1]) | ~valid[:-1] | (text[1:n] != text[: n - 1])]))
    stop = np.flatnonzero(valid & np.concatenate([(best[1:] != best[:-1]) | ~valid[1:] | (text[1:n] != text[: n - 1]), [True]]))
    at = best[begin]
    whole = _ranges(h, begin, stop + window, _MULTIPLIERS[1])
    shape = ((at - begin) * _SPAN + (stop - begin)).astype(np.uint64)
    return text[begin], grams[at], mix64(whole ^ mix64(shape + np.uint64(1))), begin - offsets[text[begin]], stop - begin + 1


def _repeated(text: np.ndarray, anchor: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where an anchor occurrence has an equal one before it in its text."""
    order = np.lexsort((np.arange(len(text)), kind, anchor, text))
    same = (text[order][1:] == text[order][:-1]) & (anchor[order][1:] == anchor[order][:-1]) & (kind[order][1:] == kind[order][:-1])
    out = np.zeros(len(text), bool)
    out[order[1:][same]] = True
    return out


def _seeds(docs: DataFrame, whole: bool) -> DataFrame:
    """Anchor occurrences (h, and if whole also c, doc_id and span), each class once a document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunked(batches, "text"):
            words, offsets = word_lists(texts, lower=False)
            text, anchor, kind, first, many = anchors(word_hashes(words), offsets)
            keep = ~_repeated(text, anchor, kind)
            cols = [pa.array(anchor[keep].view(np.int64))]
            if whole:
                cols += [pa.array(kind[keep].view(np.int64)), part.column(0).take(pa.array(text[keep])), pa.array(first[keep] * _SPAN + many[keep] - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "c", "doc_id", "span"][: len(cols)])

    return docs.mapInArrow(kernel, "h long, c long, doc_id long, span long" if whole else "h long")


def _windows(docs_with_spans: DataFrame) -> DataFrame:
    """(p, q, doc_id, start) of each window in the spans of a document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunked(batches, "text"):
            words, offsets = word_lists(texts, lower=False)
            h = word_hashes(words)
            p, q = (mix64(_rolled(h, WINDOW, m)) for m in _MULTIPLIERS[1:])
            spans = part.column(part.schema.get_field_index("spans")).to_pylist()
            sizes = [len(x) for x in spans]
            flat = np.array([y for x in spans for y in x], np.int64)
            doc = np.repeat(np.arange(len(texts)), sizes)
            many = flat % _SPAN + 1
            doc, first = np.repeat(doc, many), np.repeat(flat // _SPAN, many)
            start = first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
            # an id that several rows share brings every row's spans to each
            fits = start + WINDOW <= np.diff(offsets)[doc]
            doc, start = doc[fits], start[fits]
            at = offsets[doc] + start
            yield pa.RecordBatch.from_arrays([pa.array(p[at].view(np.int64)), pa.array(q[at].view(np.int64)), part.column(0).take(pa.array(doc)), pa.array(start)], names=["p", "q", "doc_id", "start"])

    return docs_with_spans.mapInArrow(kernel, "p long, q long, doc_id long, start long")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the runs of windows of each document (doc_id, text) that start earlier elsewhere; repeats of an anchor's class inside one document are left to :func:`kept`."""
    shared = materialise(_seeds(docs, whole=False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    seeds = materialise(join_hot(_seeds(docs, whole=True), shared, ["h"], "n").drop("n"), "seeds")
    classes = materialise(seeds.groupBy("h", "c").agg(F.min(F.struct("doc_id", "span")).alias("least"), F.count("*").alias("n")), "classes")
    several = materialise(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "several")
    edges = join_hot(classes, several, ["h"], "k").select(F.col("least.doc_id").alias("doc_id"), F.col("least.span").alias("span"))
    need = edges.groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
    windows = materialise(_windows(docs.join(need, docs.doc_id.eqNullSafe(need.doc_id)).select(docs.doc_id, "text", "spans")), "windows")
    earliest = materialise(windows.groupBy("p", "q").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.count("*").alias("n")).where("n > 1"), "earliest")
    late = F.struct("doc_id", "start") != F.col("least")
    extended = join_hot(windows, earliest, ["p", "q"], "n").where(late).select("doc_id", (F.col("start") * _SPAN).alias("span"))
    equal = join_hot(seeds, classes.where("n > 1"), ["h", "c"], "n").where(F.struct("doc_id", "span") != F.col("least")).select("doc_id", "span")
    return equal.union(extended).groupBy("doc_id").agg(F.collect_set("span").alias("spans"))


def kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one space."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunked(batches, "text"):
            words, offsets = word_lists(texts, lower=False)
            text, anchor, kind, first, many = anchors(word_hashes(words), offsets)
            again = _repeated(text, anchor, kind)
            lo, n = [(offsets[text] + first)[again]], [many[again]]
            for i, spans in enumerate(part.column(part.schema.get_field_index("spans")).to_pylist()):
                if spans:
                    x = np.array(spans, np.int64)
                    lo.append(offsets[i] + x // _SPAN)
                    n.append(x % _SPAN + 1)
            lo, n = np.concatenate(lo), np.concatenate(n)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, lo, 1)
            np.add.at(change, np.minimum(lo + n + WINDOW - 1, len(words)), -1)
            stays = np.cumsum(change)[:-1] == 0
            left = [b" ".join([words[k] for k in (np.flatnonzero(stays[a:b]) + a).tolist()]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            total = np.concatenate([[0], np.cumsum(~stays)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(found, docs.doc_id.eqNullSafe(found.doc_id), "left").select(docs.doc_id, "text", "spans").mapInArrow(kernel, "doc_id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept(own, materialise(repeats(own), "repeats"))


def op2(docs: DataFrame) -> DataFrame:
    """The digest of the contract: doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
