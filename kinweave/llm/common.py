"""Shared pieces of the training-data operators: shared-folder tables, id anti-joins, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java regex class.
SPACE = r"[ \t-\r]"
#: A list of ids or keys is broadcast up to so many rows (8 to 40 bytes each); beyond it, it is shuffled.
BROADCAST_ROWS = 500_000


#: Bytes of one batch of rows on its way to a Python worker (Spark's own default is 64 MB, for each of many workers).
BATCH_BYTES = 4_000_000
#: A key with so many rows is hot: there are few of these, and they are looked up by broadcast.
HOT_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; without that setting nothing is written."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # One process: its warehouse folder is shared by all there is.
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    return f"{base.rstrip('/')}/kinweave"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by bytes, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "64m", "67108864"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def return_heap(spark: SparkSession) -> None:
    """Have executors collect their garbage, so that heap which earlier steps took goes back to the system.

    A Java heap that has grown stays grown until a full collection, and Python workers need their memory beside it.
    A few tasks for each core, so that every executor gets some.
    """
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def by_key(df: DataFrame, key: str, tag: str) -> DataFrame:
    """`df` materialized in buckets of `key`, one for each shuffle partition: joins on `key` don't shuffle it again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"kinweave_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._kinweave_path, out._kinweave_table = path, table
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    if table := getattr(df, "_kinweave_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    path = getattr(df, "_kinweave_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows, else as it is (a shuffled join follows)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def join_skewed(left: DataFrame, right: DataFrame, key: str | list[str], n: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """`left` joined (inner or left) to the one row of `right` for its `key`; column `n` of `right`: how many rows `left` has of it.

    Up to `limit` rows of `right` are broadcast.  Beyond it only keys with HOT_ROWS rows or more are (of which there
    are few), so that no task gets all rows of one; the others are shuffled.
    """
    if right.count() <= limit:
        return left.join(F.broadcast(right), key, how)
    hot = bounded(right.where(F.col(n) >= HOT_ROWS))
    rest = left.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(right.where(F.col(n) < HOT_ROWS), key, how)
    return left.join(hot, key).unionByName(rest)


def located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """`docs` and a column that tells each row's place: file and row number, equal each time it is read.

    A table that isn't read from Parquet files as it is gets written to the shared folder first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if not (plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation")) or not plan.simpleString(1).endswith("parquet"):
        docs = materialize(docs, "located")
    m = docs.metadataColumn("_metadata")
    return docs, F.concat_ws("#", m["file_path"], m["row_index"].cast("string"))


def is_train(doc_id: Column) -> Column:
    """False for held-out documents: crc32 of the id's decimal text divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of training rows whose label is 0 or 1; ids with both labels are left out."""
    rows = labels.where(is_train(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    y = F.col(label).cast("int")
    return rows.agg(F.min(y).alias("y"), F.max(y).alias("most")).where("y = most").select("doc_id", "y")


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows of `df` at most, chosen by a hash of `key`; all rows when there are fewer."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of long edges (u, v): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds; the number of rounds grows with the logarithm of the
    diameter.  Each round is written to the shared folder, the one before is deleted.  Only minima per node are
    aggregated (with map-side combine), so a node with a third of all edges is no hot group; AQE splits its join.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        discard(now)
        now, sign = after, _signature(after)
        if sign == before:
            break
        before = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
