r"""Sharding by a hypergeometric communication matrix.

Rows lie in source parts (by a hash, so that retried tasks and later jobs see the
same parts). The exact numbers of rows that each part sends to each shard are drawn
from the multivariate hypergeometric law whose row sums are the parts' sizes and
whose column sums are the shards' sizes, equal to within one. Each part puts its own
rows in random order and cuts that order at those numbers; the rows are exchanged;
each shard is put in random order again. That is a uniform permutation with exact
shard sizes. The matrix is drawn as a tree: the driver draws groups of parts by shards
(the square root of the number of parts in rows), and a task for each group draws its
parts' rows with the group's own seed, which is the same law.

Random orders sort by seeded hashes. Sorting one shard is cut into slices by the
high bits of the hash, so that a shard's order takes many tasks.

Defined cases: a null text has no bytes; a null id is a value; rows equal in id and
text are interchangeable and each gets its place; shards differ by at most one row,
the first ones larger; fewer rows than shards leave shards empty; an empty table
gives an empty result; other columns pass through :func:`spread`, but for those named
``shard`` or ``slot``, which are replaced unless they are in the key.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadica.llm.common import materialise, without

SHARDS, PARTS, SEED = 40, 256, 20_240_601
#: Rows of a part or slice that one task sorts, on average.
ROWS_EACH = 100_000


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric variate. Beyond the library's range: inversion outwards from the mode, whose cost is the standard deviation."""
    if not good or not n:
        return 0
    if not bad:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int | list[int]) -> np.ndarray:
    """Rows from each part to each shard, given both sums."""
    if sum(parts) != sum(shards):
        raise ValueError("both sides hold the same rows")
    rng = np.random.default_rng(seed)
    left = list(shards)
    out = np.zeros((len(parts), len(shards)), np.int64)
    for i, n in enumerate(parts):
        rest = sum(left)
        for j, size in enumerate(left):
            rest -= size
            out[i, j] = x = _draw(rng, size, rest, n)
            n -= x
        for j in range(len(left)):
            left[j] -= int(out[i, j])
    return out


def part_rows(dealt: DataFrame, shards: int, parts: int, seed: int) -> tuple[DataFrame, int]:
    """(__part, __ends: running sums of its rows by shard) of each part of dealt that has rows, and the number of all rows."""
    wide = max(1, math.isqrt(parts - 1) + 1)  # parts in a group
    sizes = materialise(dealt.groupBy("__part").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("__part") / wide).cast("int")), "sizes")
    groups = [(r["group"], r["n"]) for r in sizes.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").collect()]
    total = sum(n for _, n in groups)
    matrix = communication_matrix([n for _, n in groups], [total // shards + (j < total % shards) for j in range(shards)], seed)
    sums = {g: row for (g, _), row in zip(groups, matrix.tolist(), strict=True)}

    def drawn(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__part")
        own = communication_matrix(rows["n"].tolist(), sums[int(key[0])], [seed, 1, int(key[0])])
        return pd.DataFrame({"__part": rows["__part"], "__ends": np.cumsum(own, axis=1).tolist()})

    return sizes.groupBy("group").applyInPandas(drawn, "__part int, __ends array<long>"), total


def spread(rows: DataFrame, key: list[str], shards: int = SHARDS, parts: int | None = None, seed: int = SEED) -> DataFrame:
    """The columns of rows, then ``shard`` (int) and ``slot`` (long, gapless from 0): a uniform shuffle. key: columns that tell rows apart."""
    mixed = lambda salt: F.xxhash64(F.lit(f"{seed}:{salt}"), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key])
    if {"shard", "slot"} & {k.lower() for k in key}:
        raise ValueError("key columns may not be named shard or slot")
    rows = rows.select(*[rows[f"`{c}`"] for c in without(rows.columns, "shard", "slot")])
    if parts is None:
        parts = max(PARTS, math.ceil(rows.count() / ROWS_EACH))
    dealt = rows.withColumn("__part", F.pmod(mixed("part"), F.lit(parts)).cast("int"))
    ends, total = part_rows(dealt, shards, parts, seed)
    ends = materialise(ends, "matrix")
    local = Window.partitionBy("__part").orderBy(mixed("local"), *key)
    # the window has the rows by part already, so that the matrix comes to them and they stay
    sent = dealt.withColumn("__rank", F.row_number().over(local)).join(ends, "__part")
    sent = sent.withColumn("shard", F.expr("size(filter(__ends, e -> e < __rank))").cast("int"))
    slices = max(1, 2 ** math.ceil(math.log2(max(1, total / shards / ROWS_EACH * 4))))
    sent = sent.withColumn("__order", mixed("shard")).withColumn("__slice", F.expr(f"shiftrightunsigned(__order, 40) % {slices}").cast("int")).drop("__part", "__rank", "__ends")
    sent = materialise(sent, "sent")
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "__slice").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", "__slice").orderBy("__order", *key)
    placed = sent.withColumn("__at", F.row_number().over(inside) - 1).join(offsets, ["shard", "__slice"])
    return placed.select(*rows.columns, "shard", (F.col("__before") + F.col("__at")).cast("long").alias("slot"))


def op9(docs: DataFrame) -> DataFrame:
    """The digest of the contract: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    own = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = spread(own, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
