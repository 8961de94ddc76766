r"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint is the bitwise majority of the XXH64 values of its 4-word
shingles. Fingerprints at 4 or fewer differing bits are linked. A fingerprint is
cut into three segments (22, 21 and 21 bits). Of at most four differing bits, either
some segment holds none, and then one of five blocks of the other two holds none; or
two segments hold one each, and then half of the second holds none. So a fingerprint
has 145 variants: a segment with a block of the others, and a segment with one of its
bits deleted and half of another one. Each keeps 29 to 32 bits, so that few fingerprints
share a variant by chance; fingerprints linked agree in one at least. Every variant holds
one of five routes whole (the first segment, a half of one of the others), so a fingerprint
is shuffled five times, not 145: the kernel makes a route's variants where they meet,
verifies by distance and yields a spanning forest, never all pairs of a bucket.

Defined cases: a null or empty text, or one without words, has fingerprint zero,
linked like any other; a text of one to three words is one shingle; repeated rows
each get their row, a null ``doc_id`` stays null and counts as no candidate for
``component_id`` (null only if a component has no other id); an empty table gives
an empty result; columns other than the id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.llm.common import MOST_BROADCAST, chunked, components, fresh, join_hot, materialise, word_lists

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _masks() -> list[int]:
    """The bits that each variant keeps; of any four bits or fewer, some variant keeps none."""
    bits = [range(at, at + width) for at, width in SEGMENTS]
    mask = lambda kept: sum(1 << b for b in kept)
    out = []
    for own in bits:
        rest = [b for other in bits if other is not own for b in other]
        out += [mask(own) | mask(rest[i * len(rest) // 5 : (i + 1) * len(rest) // 5]) for i in range(5)]
    for x, y in ((0, 1), (0, 2), (1, 2)):
        half = len(bits[y]) // 2
        out += [(mask(bits[x]) | mask(part)) & ~(1 << gone) for gone in bits[x] for part in (bits[y][:half], bits[y][half:])]
    return out


MASKS = _masks()


def _routes() -> list[tuple[int, list[int]]]:
    """(bits that decide where a fingerprint goes, variants that keep them all); each variant is in one route."""
    halves = [(at, at + width // 2, at + width) for at, width in SEGMENTS[1:]]
    spans = [(0, SEGMENTS[0][1])] + [(a, b) for lo, mid, hi in halves for a, b in ((lo, mid), (mid, hi))]
    routes = [((1 << b) - (1 << a), []) for a, b in spans]
    for m in MASKS:
        next(held for part, held in routes if part & m == part).append(m)
    return routes


ROUTES = _routes()
#: Comparisons within one bucket before it is split by further bits.
MOST_COMPARED = 1 << 24


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Unsigned fingerprints of UTF-8 texts."""
    words, offsets = word_lists(texts, lower=True)
    counts = np.diff(offsets)
    out = np.zeros(len(texts), np.uint64)
    if not words:
        return out
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.cumsum(shingles) - shingles
    begin = np.repeat(offsets[:-1] - first, shingles) + np.arange(shingles.sum())
    width = np.repeat(np.minimum(counts, SHINGLE), shingles)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[begin].tolist(), ends[begin + width - 1].tolist(), strict=True)), np.uint64, len(begin))
    some = np.flatnonzero(shingles)
    step = 1 << 16  # texts' bits are summed in blocks of whole texts
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(first[some], first[some[at]] + step, "right")) - 1)
        lo, hi = first[some[at]], first[some[to]] if to < len(some) else len(hashes)
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[some[at:to]] - lo, axis=0, dtype=np.int32)
        out[some[at:to]] = np.packbits(ones * 2 > shingles[some[at:to], None], axis=1, bitorder="little").view(np.uint64).ravel()
        at = to
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; fp holds the 64 bits as a signed long."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunked(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(texts).view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"doc_id {kind}, fp long")


def _forest(n: int, pairs: list[np.ndarray]) -> np.ndarray:
    """Rows (root, member) of a spanning forest of pairs of places under n, the root the least place."""
    a, b = np.concatenate([np.zeros((0, 2), np.int64), *pairs]).T
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]
    on = np.flatnonzero(label != np.arange(n))
    return np.column_stack([label[on], on])


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= distance


def _grown(fps: np.ndarray, mask: int, distance: int) -> np.ndarray:
    """:func:`forest` of one bucket: components grow point by point, and what is reached is compared no more."""
    pairs, rest, compared = [], np.arange(len(fps)), 0
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            compared += len(rest)
            near = _near(fps[rest], fps[front.pop()], distance)
            if near.any():
                found, rest = rest[near], rest[~near]
                pairs.append(np.column_stack([np.full(len(found), root), found]))
                front += found.tolist()
            if compared > MOST_COMPARED:  # of the bits not kept, pairs agree in one of these blocks
                bits = [b for b in range(64) if not mask >> b & 1]
                cut = [bits[i * len(bits) // (distance + 1) : (i + 1) * len(bits) // (distance + 1)] for i in range(distance + 1)]
                return forest(fps, [mask | sum(1 << b for b in block) for block in cut], distance)
    return _forest(len(fps), pairs)


def forest(fps: np.ndarray, masks: list[int], distance: int) -> np.ndarray:
    """Rows (root, member), places in the distinct signed ``fps``: a spanning forest of all that is linked within buckets of some mask."""
    label = np.arange(len(fps))
    for mask in masks:
        keys = fps.view(np.uint64) & np.uint64(mask)
        ordered = np.sort(keys)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        at = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, keys), len(shared) - 1)] == keys)
        at = at[np.argsort(keys[at], kind="stable")]
        begin = np.flatnonzero(np.diff(keys[at], prepend=~keys[at[:1]]))
        size = np.diff(begin, append=len(at))
        hub = np.repeat(at[begin], size)
        near = _near(fps[at], fps[hub], distance)
        pairs = [np.column_stack([hub, at])[near & (label[at] != label[hub])]]
        # left to compare: a far one, a third, and not yet all in one component
        several = np.minimum.reduceat(label[at], begin) < np.maximum.reduceat(label[at], begin)
        for i in np.flatnonzero((np.add.reduceat(~near, begin) > 0) & (size > 2) & several).tolist():
            own = at[begin[i] : begin[i] + size[i]]
            pairs.append(own[_grown(fps[own], mask, distance)])
        if sum(map(len, pairs)):
            on = np.flatnonzero(label != np.arange(len(fps)))
            tree = _forest(len(fps), [np.column_stack([label[on], on]), *pairs])
            label[tree[:, 1]] = tree[:, 0]
    on = np.flatnonzero(label != np.arange(len(fps)))
    return np.column_stack([label[on], on])


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints ``fp`` that connect what is linked at ``distance`` (4 at most) or fewer bits.

    A fingerprint goes to the task of each route's bits. There all that share a variant
    are compared and a spanning forest is yielded: at most one pair a fingerprint and
    route, however many are linked.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the variants hold for a distance of 4 at most")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        route, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        for r, (_, masks) in enumerate(ROUTES):
            own = np.unique(fps[route == r])
            a, b = forest(own, masks, distance).T
            yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], names=["a", "b"])

    parts = ", ".join(f"{part - (1 << 64) if part >> 63 else part}L" for part, _ in ROUTES)
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism * 4, prints.count() * len(ROUTES) >> 20)
    sent = prints.select(F.explode(F.array(*[F.lit(r).cast("byte") for r in range(len(ROUTES))])).alias("route"), "fp").repartition(tasks, "route", F.expr(f"fp & array({parts})[route]"))
    return materialise(sent.mapInArrow(kernel, "a long, b long"), "variants").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)``: component_id is the smallest id reachable over links, the row's own included. Fingerprints and components that many rows share are salted where rows meet their component's id."""
    rows = materialise(fingerprints(docs, id_col, text_col), "prints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(prints, distance))
    linked = materialise(prints.join(roots.hint("merge"), prints.fp == roots.node).select("fp", "least", "root"), "linked")
    label = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "labels")
    far = join_hot(linked, label, ["root"], "members").select("fp", "component_id")
    ids = materialise(prints.join(far.hint("merge"), "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "ids")
    return join_hot(rows, ids, ["fp"], "n").select("doc_id", "fp", "component_id")


#: Ids that are broadcast to leave out rows (the driver builds their table); more meet in a shuffle.
MOST_IDS = MOST_BROADCAST


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of docs of which one stays of each group of linked fingerprints: the one with the smallest id; of rows that share that id, the least by their columns in order.

    Rows that share an id are one document, which stays if it is least in the group of any
    of them. Rows without an id are one document too, which stays only where no row of its
    group has an id. Only ids are compared: texts are shuffled where over MOST_IDS ids go,
    or an id that stays has several rows, and then only those rows.
    """
    near = near_duplicates(docs, id_col, text_col, distance)
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    verdict = materialise(near.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(own).alias("stays")).where("NOT stays OR n > 1"), "verdict")
    goes, several = verdict.where("NOT stays").select("doc_id"), verdict.where("stays").select("doc_id")
    kind, out = (fresh(docs, n) for n in ("__id", "__row"))
    small = verdict.count() <= MOST_IDS
    met = lambda ids: (F.broadcast(ids) if small else ids.hint("merge")).withColumnRenamed("doc_id", kind)
    same = docs[f"`{id_col}`"].eqNullSafe(F.col(kind))
    left = docs.join(met(goes), same, "left_anti")
    if several.isEmpty():
        return left
    same = left[f"`{id_col}`"].eqNullSafe(F.col(kind))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(met(several), same, "left_semi").groupBy(F.col(f"`{id_col}`").alias(kind)).agg(F.min(row).alias(out))
    return left.join(met(several), same, "left_anti").union(one.select(f"{out}.*"))


def op1(docs: DataFrame) -> DataFrame:
    """The digest of the contract: doc_id, fingerprint in 16 hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
