"""Structured Streaming over the record log: current state by micro-batches, and windowed rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beliefloom.operators.changefeed import apply_changes
from beliefloom.plans.core_problems import claim_changes

#: Parts of the changes kept, by a hash of the claim; a batch reads only those parts that its claims are in.
PARTS = 256
RECORDS = "store string, seq long, t string, actor string, type string, payload string, prev_hash string, hash string, sig string, received_at timestamp_ntz"


def read_records(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def maintain(records: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the live claims of a stream of records under ``folder``.

    Each micro-batch writes its changes under changes/batch=n/part=k; a change may come late, again or out of order, so
    the claims it touches are replayed from all their changes, which are in the parts that the batch has too, and their
    rows written under state/batch=n (live or not).  compact() merges what finished batches wrote.
    Writing a batch again overwrites that batch's own files, so a restart repeats nothing.  Order is that of seq, not
    of arrival, and nothing is dropped by a watermark.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = claim_changes(df).withColumn("part", F.pmod(F.xxhash64("store", "claim_id"), F.lit(PARTS)).cast("int"))
        new.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/changes/batch={n}")
        every = spark.read.schema(f"{_ddl(new)}, batch long").parquet(f"{folder}/changes").where(F.col("batch") <= n)
        mine = every.where(F.col("batch") == n)
        parts = [r[0] for r in mine.select("part").distinct().collect()]
        touched = mine.select("store", "claim_id").where("store IS NOT NULL AND claim_id IS NOT NULL").distinct()
        every = every.where(F.col("part").isin(parts)).drop("batch", "part")
        # The same change sent again in a later batch has another lowest seq there; the lowest of all counts.
        mine = every.join(touched, ["store", "claim_id"], "left_semi")
        live = apply_changes(_lowest(mine), ["store", "claim_id"], "seq", "op", ["score"]).withColumn("live", F.lit(True))
        out = touched.join(live, ["store", "claim_id"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
        out.write.mode("overwrite").parquet(f"{folder}/state/batch={n}")

    w = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def compact(spark: SparkSession, folder: str, upto: int) -> None:
    """Merges the state of batches 0 to ``upto`` of a stream that is not running into one batch, each claim once.

    The merged batch is written beside and takes the place of batch ``upto``; the batches before it are deleted after.
    """
    fs = lambda x: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")
    files = fs("state").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    s = spark.read.parquet(f"{folder}/state").where(F.col("batch") <= upto)
    s.groupBy("store", "claim_id").agg(F.max_by(F.struct("live", "score"), "batch").alias("s")).select("store", "claim_id", "s.score", "s.live").write.parquet(f"{folder}/merged-{upto}")
    files.delete(fs(f"state/batch={upto}"), True)
    files.rename(fs(f"merged-{upto}"), fs(f"state/batch={upto}"))
    for st in list(files.listStatus(fs("state"))):
        name = st.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < upto:
            files.delete(st.getPath(), True)


def _lowest(changes: DataFrame) -> DataFrame:
    """Changes of several batches with each content once, at its lowest seq."""
    return changes.groupBy("store", "claim_id", "content", "op").agg(F.min("seq").alias("seq"), F.min("score").alias("score"))


def current(spark: SparkSession, folder: str) -> DataFrame:
    """store, claim_id, score of the claims that are live after all batches so far."""
    s = spark.read.parquet(f"{folder}/state")
    last = s.groupBy("store", "claim_id").agg(F.max_by(F.struct("live", "score"), "batch").alias("s"))
    return last.where("s.live").select("store", "claim_id", "s.score")


def rates(records: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records per store, type and window of arrival; a derived figure, so rows later than ``late`` may be left out."""
    r = records.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", late)
    return r.groupBy("store", "type", F.window("at", width)).agg(F.count("*").alias("n")).select("store", "type", F.col("window.start").alias("start"), "n")
