"""What the operators of this subpackage share: input, scratch tables, Arrow batches and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once. Long texts are sliced further by `slices`.
ROWS_PER_BATCH = 1000
#: Up to so many links are settled by one task, without rounds over all partitions.
SETTLED = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches: rows here hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Unset, a local master gets a temporary folder, a cluster the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _local_scratch()
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


@cache
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="scratch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: a cut in the lineage that survives the loss of executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def quoted(df: DataFrame) -> str:
    """The schema as DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def row_key(*columns: str):
    """A key of one row's content, in 128 bits: repeated rows share it, different texts under one id don't."""
    return F.struct(F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *reversed(columns)).alias("k2"))


def first_by_hash(rows: DataFrame, count: int, most: int, column: str) -> DataFrame:
    """The first `most` of `count` rows with different values of `column`, by its hash.

    Of a large table only rows with a low hash are ordered, about twice as many as are wanted, so that no task sends
    `most` rows of its own.
    """
    place = F.xxhash64(column)
    share = (2 * most + 100) / max(count, 1)
    near = rows.where(place < int(share * 2**64) - 2**63) if share < 1 else rows
    return near.orderBy(place, column).limit(most)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000):
    """Parts of a batch whose `column` holds about `most_bytes` at most (one row at least)."""
    at = batch.schema.get_field_index(column)
    start, size = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


class Groups:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up, self.left = list(range(n)), n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.left -= 1
        return True


def settled(batches):
    """Rows (node, component) of the links (u, v) of one task: places are in the order of the nodes, so a group's root is its smallest node."""
    ends = [np.zeros((2, 0), np.int64), *[np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]]
    nodes, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    groups = Groups(len(nodes))
    for i, j in place.reshape(2, -1).T.tolist():
        groups.join(i, j)
    root = np.array([groups.find(i) for i in range(len(nodes))], np.int64)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (`a`, `b`) links: a written table of rows (`node`, `component`), the smallest node of each.

    Alternating large-star and small-star steps until nothing changes, or until SETTLED links or fewer are left, which
    one task settles; every step is a pair of shuffles, nothing is collected but two counters. A hub is one key of a plain
    join, which adaptive execution can split. Each step's table is deleted when the next one is written.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = written(edges.where("a != b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before or sign["n"] == 0:
            break
        if sign["n"] <= SETTLED:
            out = written(now.coalesce(1).mapInArrow(settled, "node bigint, component bigint"), "components")
            discard(now)
            return out
        before = sign
        turned = now.select(F.col("v").alias("u"), F.col("u").alias("v"))  # u > v in `now`: here are the larger neighbours
        least = now.unionByName(turned).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = turned.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "large")  # one row an edge; the repeats go with those of the small step
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(down, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select(F.col("k").alias("u"), F.col("m").alias("v")))
        small = written(small.distinct(), "small")
        discard(now, large)
        now = small
    nodes = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = written(nodes.unionByName(tops), "components")
    discard(now)
    return out
