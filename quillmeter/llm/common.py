"""Helpers that several operators share: checkpoints, word hashing, connected components."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def prepare(df: DataFrame) -> SparkSession:
    """The session of df, with a checkpoint folder and batches small enough for long texts.

    The folder comes from spark.checkpoint.dir; only where that is unset on one machine, as in
    tests, is a temporary one made. On a cluster a folder of one machine would lose what others
    wrote, so there a missing setting is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "quillmeter-checkpoints"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    prepare(spark.range(0))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder, so that later stages survive lost executors."""
    prepare(df)
    return df.checkpoint(eager=True)


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately; the size is bounded."""

    MOST = 1_000_000

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, by doubling; shorter inputs give none."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)

    def build(size: int) -> np.ndarray:
        if size == 1:
            return hashes
        half = build(size // 2)
        step = np.uint64(pow(BASE, size // 2, 1 << 64))
        whole = half[: len(half) - size // 2] * step + half[size // 2 :]
        return whole[:-1] * np.uint64(BASE) + hashes[size - 1 :] if size % 2 else whole

    return mixed(build(k))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges(a, b); the component is its smallest id.

    Each round lets every vertex hook on to its smallest neighbour, follows that pointer once
    more, and contracts the graph; vertices, labels and edges stay distributed and each round is
    checkpointed. Self-loops only name a vertex; nulls are not ids.
    """
    prepare(edges)
    edges = cut(edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    edges = edges.where("a <> b")
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        parent = cut(parent)
        if parent.isEmpty():
            break
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = cut(parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")))
        labels = cut(labels.join(parent, labels.component == parent.v, "left").select("id", F.coalesce("p", "component").alias("component")))
        first, second = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(first, "a").join(second, "b").where("pa <> pb")
        edges = cut(edges.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError("the components did not settle")
    return labels
