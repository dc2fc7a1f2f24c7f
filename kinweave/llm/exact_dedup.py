"""Exact de-duplication with disk-backed streaming state.

A signature log (digest, code points, doc_id, content locator) is written for every run; a Structured Streaming query
folds it into keyed RocksDB state, one entry per digest and never expired: how many rows carry it, and the locator
and identifier of the row that stays.  A later run with the same `state_dir` appends to the log and continues from
the state.  A locator is the file and row number a text was read from (texts that don't come from Parquet files are
written to the shared folder first).  On every hit (a digest met twice) the full normalised bytes are compared: those
of the present run with each other, and with the text that the state's locator leads to when the digest was known
before, so two texts that share a digest are still told apart.

Defined results: null text counts as empty, so all empty and null texts form one group; a null doc_id sorts after
all others; fully repeated rows (equal doc_id and text) form a group of which exactly one row stays, the one of the
earliest run, then of the smallest locator; extra columns, whatever their names, are ignored by `dedup` and kept by
`drop_copies`; an empty table gives an empty result; very long texts are compared whole.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import SPACE, bounded, delete, discard, join_skewed, located, materialize, new_path

LOG_SCHEMA = "doc_id bigint, n_points bigint, run string, locator string, text_sha256 string"
STATE_SCHEMA = "text_sha256 string, group_size bigint, first struct<neg_points:bigint,id_order:bigint,run:string,locator:string,doc_id:bigint>, batch_id bigint"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def signatures(docs: DataFrame, place: Column, run: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The log's rows; `place` tells where each row's content is."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        F.lit(run).alias("run"),
        place.alias("locator"),
        digest(normalized(F.col("text"))).alias("text_sha256"),
    )


def _winner() -> Column:
    """Most code points first, then smallest doc_id (null last); run and locator tell repeated rows apart."""
    return F.struct((-F.col("n_points")).alias("neg_points"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id_order"), "run", "locator", "doc_id")


def _updates(spark: SparkSession, state_dir: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(f"{state_dir}/updates")


def fold(spark: SparkSession, state_dir: str) -> DataFrame:
    """Fold what the log holds and the state has not seen; the changed entries of all runs, with their batch."""
    rocksdb = "spark.sql.streaming.stateStore.rocksdb"
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # The memory goes back as soon as a partition's state is on disk.
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        f"{rocksdb}.boundedMemoryUsage": "true",
        f"{rocksdb}.maxMemoryUsageMB": "128",
        # Without preallocated files: 4 MB for each partition's manifest, however little state it has.
        f"{rocksdb}.allowFAllocate": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        log = spark.readStream.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{state_dir}/log")
        state = log.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(_winner()).alias("first"))

        def put(batch: DataFrame, batch_id: int) -> None:
            # Idempotent for a repeated micro-batch.
            batch.write.mode("overwrite").parquet(f"{state_dir}/updates/batch_id={batch_id}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return _updates(spark, state_dir)


def contents(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """`wanted` with column `norm`: the normalised text that each `locator` leads to.

    Only paths of files come to the driver, which lists them to read them anyhow.
    """
    files = [r[0] for r in wanted.select(F.substring_index("locator", "#", 1)).distinct().collect()]
    if not files:
        return wanted.withColumn("norm", F.lit(None).cast("string")).limit(0)
    source = spark.read.schema("text string").parquet(*[unquote(f) for f in files])
    m = source.metadataColumn("_metadata")
    return source.select(F.concat_ws("#", m["file_path"], m["row_index"].cast("string")).alias("locator"), normalized(F.col("text")).alias("norm")).join(bounded(wanted), "locator")


def dedup(docs: DataFrame, state_dir: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document of this and, with a kept `state_dir`, all earlier runs.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, run, locator (the row's own), keep_run, keep_locator.
    """
    spark, own = docs.sparkSession, state_dir is None
    state_dir = state_dir or new_path(spark, "dedup")
    docs, place = located(docs)
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    known = -1
    if not own and exists(spark, f"{state_dir}/updates"):
        known = _updates(spark, state_dir).agg(F.max("batch_id")).first()[0]
        known = -1 if known is None else known
    signatures(docs, place, run, digest).write.mode("append").parquet(f"{state_dir}/log")
    log = spark.read.schema(LOG_SCHEMA).parquet(f"{state_dir}/log")
    # The newest entry of a digest is the state; only digests met twice matter from here on.
    entries = fold(spark, state_dir).groupBy("text_sha256").agg(
        F.max_by(F.struct("group_size", "first"), "batch_id").alias("s"),
        F.max(F.when(F.col("batch_id") <= known, F.struct("batch_id", "first"))).alias("before"),
        F.max("batch_id").alias("newest"),
    )
    hits = materialize(entries.where("s.group_size > 1").select("text_sha256", "s.group_size", "s.first", "before.first.locator", "newest"), "hits")

    # Full bytes on hits: copies collapse in each map task before any text is shuffled.
    text = docs.select(normalized(F.col("text")).alias("norm")).withColumn("text_sha256", digest(F.col("norm")))
    on_hit = text.join(bounded(hits.select("text_sha256")), "text_sha256", "left_semi")
    variants = on_hit.groupBy("text_sha256", "norm").agg(F.count("*").alias("n"))
    met_again = hits.where((F.col("newest") > known) & F.col("locator").isNotNull()).select("text_sha256", "locator") if known >= 0 else None
    if met_again is not None:
        variants = variants.select("text_sha256", "norm").unionByName(contents(spark, met_again).select("text_sha256", "norm")).distinct()
    clash = materialize(variants.groupBy("text_sha256").count().where("count > 1").select("text_sha256"), "clash")

    out = join_skewed(log, hits.select("text_sha256", "group_size", "first"), "text_sha256", "group_size", "left", 100_000)
    single = F.col("group_size").isNull()
    out = out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("run") == F.col("first.run")) & (F.col("locator") == F.col("first.locator"))).alias("kept"),
        "text_sha256",
        "run",
        "locator",
        F.coalesce("first.run", "run").alias("keep_run"),
        F.coalesce("first.locator", "locator").alias("keep_locator"),
    )
    if not clash.isEmpty():
        out = _told_apart(log, out, clash)
    if own:
        out = materialize(out, "judged")
        delete(spark, state_dir)
        discard(hits)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _told_apart(log: DataFrame, out: DataFrame, clash: DataFrame) -> DataFrame:
    """Regroup the rows of colliding digests by their bytes, read through the locators of all runs."""
    rows = contents(log.sparkSession, log.join(clash, "text_sha256", "left_semi"))
    whole = Window.partitionBy("text_sha256", "norm")
    order = whole.orderBy(_winner())
    first = F.first(_winner()).over(order)
    rows = rows.withColumn("w", first).withColumn("group_size", F.count("*").over(whole)).withColumn("kept", F.row_number().over(order) == 1)
    rows = rows.select("doc_id", F.col("w.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256", "run", "locator", F.col("w.run").alias("keep_run"), F.col("w.locator").alias("keep_locator"))
    return out.join(clash, "text_sha256", "left_anti").unionByName(rows)


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that an equal text replaces, whatever their doc_id; of fully repeated rows one stays."""
    docs, place = located(docs)
    gone = bounded(dedup(docs).where("not kept").select(F.col("locator").alias("__locator")))
    return docs.join(gone, place == gone["__locator"], "left_anti")
