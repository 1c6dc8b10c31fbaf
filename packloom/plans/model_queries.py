"""Registered queries of model composition, sinks and streams. Weights follow a rule that both sides can state."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions import tensor
from packloom.operators import routing
from packloom.plans import queries as q
from packloom.plans.registry import SQL, query
from packloom.plans.stash import shared_dir
from packloom.sources import checkpoints
from packloom.streaming import packer

LANES, INNER, OUT = 64, 8, 16


def weights(rows: int, columns: int, shift: int) -> list[list[float]]:
    return [[math.cos((o + 1) * (i + 1) + shift) / 8 for i in range(columns)] for o in range(rows)]


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _dense(source: str, out: int, shift: int, bias: str = "0") -> str:
    """(vec_id, o, y): a projection of the list ``e`` of ``source``."""
    return f"SELECT vec_id, o, sum(v * cos((o + 1) * i + {shift}) / 8) + {bias} AS y FROM (SELECT vec_id, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM {source}), (SELECT range AS o FROM range({out})) GROUP BY vec_id, o"


VEC = "x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


@query("linear_projection", f"WITH {VEC} SELECT vec_id, o::INTEGER AS dim, round(y, 6) + 0.0 AS value FROM ({_dense('x', OUT, 0, '0.1::DOUBLE * o')})")
def linear_projection(spark: SparkSession, d: str) -> DataFrame:
    return q._lanes(q._vec(spark, d).withColumn("y", tensor.linear(F.col("x"), weights(OUT, LANES, 0), [0.1 * o for o in range(OUT)])))


@query("feed_forward", f"""WITH {VEC}, a AS ({_dense('x', 2 * INNER, 1)}), b AS ({_dense('x', 2 * INNER, 2)}), p AS (SELECT vec_id, o, a.y * b.y AS v FROM a JOIN b USING (vec_id, o)),
g AS (SELECT vec_id, o // 2 AS o, least(max(v) FILTER (WHERE o % 2 = 0), 7) AS g, least(greatest(max(v) FILTER (WHERE o % 2 = 1), -7), 7) AS l FROM p GROUP BY vec_id, o // 2),
h AS (SELECT vec_id, list(g / (1 + exp(-1.702 * g)) * (l + 1) ORDER BY o) AS e FROM g GROUP BY 1)
SELECT vec_id, o::INTEGER AS dim, round(y, 6) + 0.0 AS value FROM ({_dense('h', OUT, 3)})""")
def feed_forward(spark: SparkSession, d: str) -> DataFrame:
    y = tensor.feed_forward(F.col("x"), weights(2 * INNER, LANES, 1), weights(2 * INNER, LANES, 2), weights(OUT, INNER, 3))
    return q._lanes(q._vec(spark, d).withColumn("y", y))


@query("qk_norm_rope", f"""WITH {VEC}, s AS (SELECT vec_id, h, e[h * 32 + 1 : h * 32 + 32] AS e FROM x, (SELECT range AS h FROM range(2))),
n AS (SELECT vec_id, h, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e) / 32 + 1e-5)) AS e FROM s),
a AS (SELECT vec_id, h, e, i, i % 16 AS l, (vec_id % {q.SEQ}) / pow(10000, (i % 16) / 16.0) AS t FROM n, (SELECT range AS i FROM range(32)))
SELECT vec_id, (h * 32 + i)::INTEGER AS dim, round(CASE WHEN i < 16 THEN e[l + 1] * cos(t) - e[l + 17] * sin(t) ELSE e[l + 17] * cos(t) + e[l + 1] * sin(t) END, 6) + 0.0 AS value FROM a""")
def qk_norm_rope(spark: SparkSession, d: str) -> DataFrame:
    _, f = tensor.yarn_frequencies(32)
    return q._lanes(q._vec(spark, d).withColumn("y", tensor.norm_and_rotate(F.col("x"), 2, F.col("vec_id") % q.SEQ, f)))


@query("shared_expert_add", f"""WITH {q.GATE}, l AS (SELECT token_id, e, unnest(range(1, len(e) + 1)) AS i FROM x),
r AS (SELECT l.token_id, i, sum(l.e[i] * w[i] * p) AS v FROM l JOIN k USING (token_id) JOIN ex USING (expert) GROUP BY 1, 2)
SELECT token_id, (i - 1)::INTEGER AS dim, round(e[i] * cos(i) / 8 + coalesce(v, 0), 6) + 0.0 AS value FROM l LEFT JOIN r USING (token_id, i)""")
def shared_expert_add(spark: SparkSession, d: str) -> DataFrame:
    vec, experts, gated = q._gated(spark, d)
    routed = routing.dispatched(vec, routing.top_k(gated, q.TOP), experts)
    return routing.lanes(routing.add_shared(routed, weights(1, LANES, 0)[0])).withColumn("value", F.round("value", 6) + 0.0)


@query("config_schedule", "SELECT event_id AS step, round(3e-4 * CASE WHEN s < 5000 THEN s / 5000.0 ELSE greatest(0.01, 0.01 + 0.99 * 0.5 * (1 + cos(pi() * least((s - 5000) / 495000.0, 1)))) END, 12) AS rate FROM (SELECT event_id, event_id * 60 AS s FROM events)")
def config_schedule(spark: SparkSession, d: str) -> DataFrame:
    rate = tensor.cosine_schedule(F.col("event_id") * 60, warmup=5000, total=500_000, floor=0.01)
    return q.read(spark, d, "events").select(F.col("event_id").alias("step"), F.round(rate, 12).alias("rate"))


# --- sinks, read back ----------------------------------------------------------------------------------------------


@query("metrics_sink", "SELECT 'run' AS run, event_id AS step, event_type AS key, value FROM events")
def metrics_sink(spark: SparkSession, d: str) -> DataFrame:
    to = _folder(spark, "metrics")
    checkpoints.append_metrics(q.read(spark, d, "events").select(F.lit("run").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("key"), "value"), to)
    return spark.read.parquet(to)


@query("routing_log", f"WITH {q.GATE} SELECT printf('expert %d: %.2f%%', expert, percent) AS line FROM used")
def routing_log(spark: SparkSession, d: str) -> DataFrame:
    to = _folder(spark, "log")
    checkpoints.append_log(routing.log_lines(routing.utilization(q._counts(spark, d))), to)
    return spark.read.text(to).withColumnRenamed("value", "line")


@query("checkpoint_state", "SELECT vec_id, len(embedding)::INTEGER AS width FROM embeddings")
def checkpoint_state(spark: SparkSession, d: str) -> DataFrame:
    to = _folder(spark, "state")
    checkpoints.save_state(q.read(spark, d, "embeddings"), to, 42)
    return checkpoints.load_state(spark, to, 42).select("vec_id", F.size("embedding").alias("width"))


# --- streams -------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    path = f"{d}/{table}.parquet"
    whole = q.read(spark, d, table)
    files = spark.readStream.schema(whole.schema)
    if any(f.endswith(f"/{table}.parquet") for f in whole.inputFiles()):
        return files.option("pathGlobFilter", f"{table}.parquet").parquet(d)
    return files.parquet(path)


@query("stream_pack", SQL["pack_sequences"])
def stream_pack(spark: SparkSession, d: str) -> DataFrame:
    """All files in one trigger, so that chunks follow doc_id as in the batch query."""
    to = _folder(spark, "packed")
    packer.pack_stream(_stream(spark, d, "documents").select("doc_id", "text"), f"{to}/out", f"{to}/state", f"{to}/checkpoint", q.C).awaitTermination()
    rows = spark.read.parquet(f"{to}/out")
    return rows.select("chunk_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("stream_expert_counts", f"SELECT event_id % {q.EXPERTS} AS expert, count(*) AS n FROM events GROUP BY 1")
def stream_expert_counts(spark: SparkSession, d: str) -> DataFrame:
    name = f"expert_counts_{uuid.uuid4().hex}"
    routed = _stream(spark, d, "events").select((F.col("event_id") % q.EXPERTS).alias("expert"))
    packer.count_stream(routed, name, _folder(spark, "counts")).awaitTermination()
    return spark.table(name)
