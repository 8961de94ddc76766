"""What the operators share: cutting lineage in the shared folder, word arrays, star contraction."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine where the session names no folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Fewer keys than this each hold more than this part of all rows; such hot keys are broadcast.
HOT, SALTS = 1000, 64
#: Rows that a join may broadcast: the driver builds their table in its heap, so its limit is on rows, not on the bytes of compressed files that Spark goes by.
MOST_BROADCAST = 200_000
#: Text bytes that a Python kernel handles at a time; bounds its memory whatever the batch holds.
CHUNK_BYTES = 4 << 20

_owned: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application under spark.checkpoint.dir, which all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or LOCAL_CHECKPOINTS
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone already; its folder is left to the cluster's cleaner
        pass


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    folder = shared_folder(spark)
    if folder not in _owned:
        _owned.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex[:12]}"


#: The session's setting by which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet (in folders by a column, if one is given) in the shared folder and read it back: lineage ends there, and lost executors cost nothing that was written. The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if by else out  # folders' columns are read last
    out.written_to = path
    return out


def discard(table: DataFrame, part: str = "") -> None:
    """Delete a table that :func:`materialise` made, or one of its folders, when nothing is left to read it."""
    _remove(table.sparkSession, table.written_to + (f"/{part}" if part else ""))


def without(columns: list[str], *names: str) -> list[str]:
    """The columns that are not named so, in any case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have: the name itself, or with underscores before it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with a written table that has one row a key and in ``weight`` how many of ``rows`` have that key.

    Keys with more than 1/HOT of all those rows, fewer than HOT, are broadcast to mark
    their rows, which get one of SALTS salts by their other columns; the table's rows of
    such keys are repeated for each salt. So no task gets all rows of one key. A table of
    over MOST_BROADCAST rows is not broadcast, however small its files.
    """
    total, keys = table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count("*")).first()
    hot = F.col(weight) * HOT > total
    marked = rows.join(F.broadcast(table.where(hot).select(*on, F.lit(True).alias("__hot"))), on, "left")
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on] or on), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.withColumn("__salt", F.explode(salts))
    if keys > MOST_BROADCAST:
        right = right.hint("merge")
    return marked.withColumn("__salt", salt).drop("__hot").join(right, [*on, "__salt"], how).drop("__salt")


def local_path(uri: str) -> str | None:
    """The path of a file URI or plain path, which every machine mounts if it lies in the shared folder; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def publish(spark: SparkSession, image: bytes, label: str) -> str | None:
    """Write a file that the driver has made to the shared folder, for workers to map; None where that is no mounted folder."""
    path = local_path(shared_path(spark, label))
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(image)
    return path


def chunked(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` text bytes each, and their texts as UTF-8 (null: empty)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
        begin = held = 0
        for i, t in enumerate(texts):
            if held and held + len(t) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0
            held += len(t)
        if len(texts) > begin:
            yield batch.slice(begin), texts[begin:]
        batch = texts = None
    give_back()


def give_back() -> None:
    """Return memory that is free to the machine: Spark keeps a worker waiting for further tasks beside executors that need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the C library that has it
        ctypes.CDLL(None).malloc_trim(0)


def word_lists(texts: list[bytes], lower: bool) -> tuple[list[bytes], np.ndarray]:
    r"""All words ``[^\x20\x09-\x0D]+`` in a row, and the offsets of each text's words in them (one more than texts)."""
    lists = [(t.lower() if lower else t).split() for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return [w for x in lists for w in x], offsets


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the smallest node.

    Large-star and small-star contraction: each step is a partial minimum per
    node joined back to the edges; hubs' edges are salted (:func:`join_hot`), minima
    are combined before the shuffle. Every round is written to the shared folder. Nodes without an edge get no row; an
    edge from a node to itself gives it one.
    """
    loops = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    e = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_hot(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_hot(large, least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "small")
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return loops.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
