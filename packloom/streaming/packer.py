"""Streaming counterparts: a packer that carries its unfinished chunk, and running expert counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packloom.config import PackConfig
from packloom.operators.packing import Tokenizer, append_eos, by_space, pack, tokenize
from packloom.plans.stash import discard


def _carry(spark: SparkSession, state: str, batch_id: int) -> tuple[int, DataFrame | None]:
    """Chunks written before a batch, and its carried tail, from the state that the batch before it left."""
    if not batch_id:
        return 0, None
    rows = spark.read.parquet(f"{state}/batch={batch_id - 1}")
    return rows.first()["chunks"], rows.select("tokens")


def pack_stream(docs: DataFrame, out: str, state: str, checkpoint: str, config: PackConfig = PackConfig(), tokenizer: Tokenizer = by_space, key: str = "doc_id") -> StreamingQuery:
    """Write (chunk_id, tokens) to ``out`` as documents arrive, ordered by ``key`` within each trigger.

    State is one row per batch: chunks written so far and the tail. A batch reads that of the batch before and overwrites
    its own folders, so a replay after a failure changes nothing; older state is deleted, as only the last batch can be
    replayed. The tail, shorter than one chunk, enters the next batch as a document before all others.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done, tail = _carry(spark, state, batch_id)
        tokens = append_eos(tokenize(batch, key, "text", tokenizer), config.eos)
        if tail is not None:
            low = tokens.agg(F.coalesce(F.min(key), F.lit(0)).alias("m")).first()["m"]
            tokens = tokens.unionByName(tail.filter(F.size("tokens") > 0).select(F.lit(low - 1).alias(key), "tokens"))
        chunks = pack(tokens, config.width, key, keep_tail=True).withColumn("chunk_id", F.col("chunk_id") + done)
        whole = chunks.filter(F.size("tokens") == config.width)
        whole.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        n = spark.read.parquet(f"{out}/batch={batch_id}").count()
        rest = chunks.filter(F.size("tokens") < config.width).select("tokens")
        empty = spark.createDataFrame([([],)], "tokens array<string>")
        rest = rest.unionByName(empty).orderBy(F.desc(F.size("tokens"))).limit(1)
        rest.select("tokens", F.lit(done + n).cast("long").alias("chunks")).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        discard(spark, f"{state}/batch={batch_id - 2}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_stream(routed: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Running (expert, n) counts of a stream with an ``expert`` column, in a memory table."""
    counts = routed.groupBy("expert").agg(F.count(F.lit(1)).alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
