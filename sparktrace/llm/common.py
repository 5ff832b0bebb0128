"""Helpers shared by the training-data operators: input tables, shared storage, graph components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; texts may be long, so batches are short.
BATCH_ROWS = 512


def prepared(spark: SparkSession) -> SparkSession:
    """Short batches for Python workers, and shuffle files that go as soon as the query that made them is done."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Note how to drop what an operator keeps in a worker from task to task."""
    _kept[owner] = clear


def tidy(owner: str = "") -> None:
    """Workers live on from stage to stage: drop what other operators keep in this one and hand freed memory back to the system."""
    for name, clear in _kept.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs in this process (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths of the tables that are stored inside."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield made
    finally:
        _scratch.reset(token)


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives the loss of any executor."""
    spark = prepared(df.sparkSession)
    path = f"{shared_dir(spark)}/t{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _scratch.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def freed(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def named(docs: DataFrame, *columns: str, name: str = "doc_id") -> DataFrame:
    """doc_id as a string beside the columns: pandas would turn integers into floats where some are null."""
    return docs.select(F.col(name).cast("string").alias(name), *columns)


def safe(df: DataFrame) -> DataFrame:
    """df with its integer columns as strings, since pandas would turn those with nulls into floats; cast them back by the schema."""
    return df.select(*(F.col(f"`{n}`").cast("string").alias(n) if t in ("tinyint", "smallint", "int", "bigint") else F.col(f"`{n}`") for n, t in df.dtypes))


def numbered(df: DataFrame, *names: str) -> DataFrame:
    """Ids that named made strings, as integers again."""
    return df.withColumns({n: F.col(n).cast("long") for n in names or ("doc_id",)})


#: Rounds of contraction; each takes a constant share of the nodes away, so this many are never needed.
ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both bigint: (node, component), component an arbitrary member.

    Each round every node points to the neighbour (or itself) of least random priority and the
    graph is contracted, so a constant share of the nodes goes per round and chains don't slow it.
    Minima combine before the shuffle; nothing is collected but a row count. An isolated node or a
    self-loop gives no row; null ends are ignored; repeated edges are harmless.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("a <> b").select("a", "b").distinct())
    names = None
    for turn in range(ROUNDS + 1):
        if edges.isEmpty():
            break
        if turn == ROUNDS:
            raise RuntimeError(f"components of a graph did not settle in {ROUNDS} rounds")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        prio = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("id"))
        to = both.groupBy("a").agg(F.min(prio("b")).alias("m")).select(F.col("a").alias("node"), F.least(prio("a"), "m")["id"].alias("component"))
        to = stored(to)
        if names is None:
            names = to
        else:
            step = to.select(F.col("node").alias("component"), F.col("component").alias("next"))
            old, names = names, stored(names.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
            freed(spark, [old.stored_at])
        at = lambda end: to.select(F.col("node").alias(end), F.col("component").alias(f"{end}2"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2")
        old, edges = edges, stored(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        freed(spark, [old.stored_at] + ([to.stored_at] if to is not names else []))
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names
