"""Helpers that several operators share: folders, batches, tokens, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch on its way to Python: a batch of long texts has to fit a worker's memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors share: what ``spark.checkpoint.dir`` names, else the session's own checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
        base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="llm-")
    return base.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, kind: str = "stage") -> DataFrame:
    """The frame, written to the shared folder and read again: cuts lineage and outlives executors."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches of the session, unless it sets a smaller bound itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know only ASCII, which is what is asked for.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by contraction: (a, b) pairs of longs -> (node, component), its smallest node.

    Each round points every node at the smallest of its neighbours and itself, then contracts the edges by these
    pointers until none is left. Rounds only move aggregated rows; a node with very many neighbours is folded
    before it is shuffled. Each round's edges and pointers are written, so lineage stays short. Empty edges: no rows.
    """
    spark = edges.sparkSession
    edges = saved(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "pointers")
        if nodes is None:
            nodes = to.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            nodes = nodes.join(to.withColumnRenamed("a", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        nodes = saved(nodes, "nodes")
        left, right = to.toDF("a", "x"), to.toDF("b", "y")
        edges = saved(
            edges.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
    return nodes if nodes is not None else spark.createDataFrame([], "node long, component long")


class Scratch:
    """Folders of one run below the shared folder, deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession, kind: str) -> None:
        self._spark, self._root, self._count = spark, new_folder(spark, kind), 0

    def saved(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """The frame, written and read again."""
        self._count += 1
        path = f"{self._root}/{self._count}"
        df.write.parquet(path, compression=compression)
        return self._spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        context = self._spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self._root)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def finite(v: Column) -> Column:
    """Whether an array of doubles is there and has neither null nor non-finite components."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column) -> np.ndarray:
    """Vectors of an Arrow list column, a row each; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.ListArray:
    """Rows of integers as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int64()))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    out = np.floor(scale * x)
    if out.size and np.abs(out).max() >= 2**55:
        raise ArithmeticError(f"A component beyond {2**55 // scale} leaves the range of exact distances")
    return out.astype(np.int64)


def widened(terms: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The integer arrays, in a type that holds the sum of ``terms`` squared differences between them: 64 bits, or Python's."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return [a.astype(np.int64 if terms * (2 * most) ** 2 < 2**62 else object) for a in arrays]


def joined_evenly(rows: DataFrame, facts: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` joined (inner, nulls equal) with ``facts``, one row per value of ``key`` and its number of rows in ``size``.

    Values with more than 1/``share`` of all rows, of which there are fewer than ``share``, are broadcast; the others
    are shuffled, so that no task gets more rows of one value than that share. Drops ``size``.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * share > total
    facts = facts.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    few = F.broadcast(facts.where(hot).drop(size))
    rest = rows.join(few, same, "left_anti").join(facts.where(~hot).drop(size), same)
    return rows.join(few, same).unionByName(rest).drop("_key")
