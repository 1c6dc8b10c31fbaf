"""Mixture-of-experts routing as DataFrames: gate, top-k, counts, balance, dispatch and combine; attention joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions.tensor import dot, let, softmax


#: Experts of a layer; a model has a handful, and a table of more is refused before it is collected into one row.
MAX_EXPERTS = 4096


def _few(experts: DataFrame) -> DataFrame:
    n = experts.limit(MAX_EXPERTS + 1).count()
    if n > MAX_EXPERTS:
        raise ValueError(f"more than {MAX_EXPERTS} experts")
    return experts


def gate(tokens: DataFrame, experts: DataFrame) -> DataFrame:
    """(token_id, x, scores): softmax over experts. ``experts`` (expert, w) has a model's fixed handful of rows, which
    become one row of one array before they meet the tokens, so tokens are not shuffled."""
    experts = _few(experts)
    listed = experts.agg(F.array_sort(F.collect_list(F.struct("expert", "w"))).alias("_e"))
    logits = F.transform("_e", lambda e: dot(F.col("x"), e["w"]))
    return tokens.crossJoin(F.broadcast(listed)).select("token_id", "x", logits.alias("z")).select("token_id", "x", softmax(F.col("z")).alias("scores"))


def top_k(gated: DataFrame, k: int, bias: list[float] | None = None, scale: float = 1.0) -> DataFrame:
    """(token_id, expert, slot, weight): the k best biased scores choose, unbiased scores weigh; ties to the lower id."""
    shift: Column = F.array(*[F.lit(float(b)) for b in bias]) if bias else None
    ranked = F.transform("scores", lambda s, i: F.struct((-(s + (F.get(shift, i) if bias else 0.0))).alias("o"), i.alias("expert"), s.alias("weight")))
    best = F.slice(F.array_sort(ranked), 1, k)
    rows = gated.select("token_id", F.posexplode(best).alias("slot", "x"))
    return rows.select("token_id", F.col("x.expert").alias("expert"), "slot", (F.col("x.weight") * scale).alias("weight"))


def bincount(spark: SparkSession, routed: DataFrame, experts: int) -> DataFrame:
    """(expert, n) for every expert, zeros included."""
    n = routed.groupBy("expert").agg(F.count(F.lit(1)).alias("n"))
    ids = spark.range(experts).select(F.col("id").cast("int").alias("expert"))
    return ids.join(n, "expert", "left").select("expert", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by_interval(routed: DataFrame, step: Column, every: int) -> DataFrame:
    """(epoch, expert, n): counters that start anew after each ``every`` steps."""
    return routed.groupBy(F.floor(step / every).alias("epoch"), "expert").agg(F.count(F.lit(1)).alias("n"))


def utilization(counts: DataFrame) -> DataFrame:
    """(expert, n, percent); no rows if nothing was routed."""
    total = counts.agg(F.sum("n").alias("total")).filter("total > 0")
    return counts.crossJoin(F.broadcast(total)).select("expert", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def balance(used: DataFrame) -> DataFrame:
    """Mean, extremes and population deviation of percents, and 100 * min / max."""
    top = F.max("percent")
    return used.agg(F.avg("percent").alias("mean"), top.alias("most"), F.min("percent").alias("least"), F.stddev_pop("percent").alias("deviation"), F.when(top > 0, 100 * F.min("percent") / top).otherwise(0.0).alias("balance"))


def variation(counts: DataFrame) -> DataFrame:
    """The coefficient of variation of counts in percent, 0 without tokens."""
    mean = F.avg("n")
    return counts.agg(mean.alias("mean"), F.when(mean > 0, 100 * F.stddev_pop("n") / mean).otherwise(0.0).alias("cv"))


def usage_chart(used: DataFrame, cells: int = 50) -> DataFrame:
    """(expert, n, percent, bar), the busiest first."""
    return used.withColumn("bar", F.repeat(F.lit("█"), F.floor(F.col("percent") * cells / 100).cast("int"))).orderBy(F.desc("n"), "expert")


def lanes(rows: DataFrame, y: str = "y", key: str = "token_id") -> DataFrame:
    """(key, dim, value): one row a lane of an array."""
    return rows.select(key, F.posexplode(y).alias("dim", "value"))


def dispatched(tokens: DataFrame, routed: DataFrame, experts: DataFrame) -> DataFrame:
    """(token_id, x, y): y is the weighted sum of the chosen experts' outputs x * w; zeros without a slot.

    Slots are few, so whole arrays are brought together by token and added there, never a row a lane."""
    sent = routed.join(F.broadcast(_few(experts)), "expert").groupBy("token_id").agg(F.collect_list(F.struct("weight", "w")).alias("slots"))
    none = F.array().cast("array<struct<weight:double,w:array<double>>>")
    rows = tokens.join(sent, "token_id", "left").withColumn("slots", F.coalesce("slots", none))
    mixed = F.aggregate("slots", F.transform("x", lambda _: F.lit(0.0)), lambda acc, s: F.zip_with(acc, s["w"], lambda a, w: a + w * s["weight"]))
    return rows.select("token_id", "x", F.zip_with("x", mixed, lambda a, b: a * b).alias("y"))


def combine(tokens: DataFrame, routed: DataFrame, experts: DataFrame) -> DataFrame:
    """(token_id, dim, value) of ``dispatched``."""
    return lanes(dispatched(tokens, routed, experts))


def attended(q: DataFrame, kv: DataFrame, group: int, sink: float | None = None) -> DataFrame:
    """(b, head, pos, y): causal grouped-query attention within each sequence ``b``.

    q: (b, head, pos, q); kv: (b, kv_head, pos, k, v). Each kv head serves ``group`` query heads. A ``sink`` logit joins
    the denominator and no value. Sequences are short blocks, so the pair join is bounded by rows times block length.
    """
    left = q.withColumn("kv_head", F.floor(F.col("head") / group).cast("int"))
    right = kv.withColumnRenamed("pos", "k_pos")
    pairs = left.join(right, ["b", "kv_head"]).filter("k_pos <= pos")
    scored = pairs.select("b", "head", "pos", "k_pos", "v", (dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q").cast("double"))).alias("z"))
    rows = scored.groupBy("b", "head", "pos").agg(F.array_sort(F.collect_list(F.struct("k_pos", "z", "v"))).alias("ks"))
    top = F.array_max(F.col("ks.z")) if sink is None else F.greatest(F.array_max(F.col("ks.z")), F.lit(sink))
    zeros = F.transform(F.get("ks", F.lit(0))["v"], lambda _: F.lit(0.0))

    def mixed(us: Column, total: Column) -> Column:
        return F.aggregate(us, zeros, lambda acc, s: F.zip_with(acc, s["v"], lambda a, v: a + v * (s["u"] / total)))

    def shares(t: Column) -> Column:
        rest = F.lit(0.0) if sink is None else F.exp(F.lit(sink) - t)
        us = F.transform("ks", lambda s: F.struct(F.exp(s["z"] - t).alias("u"), s["v"].alias("v")))
        return let(us, lambda x: let(F.aggregate(x, rest, lambda a, s: a + s["u"]), lambda total: mixed(x, total)))

    return rows.select("b", "head", "pos", let(top, shares).alias("y"))


def attention(q: DataFrame, kv: DataFrame, group: int, sink: float | None = None) -> DataFrame:
    """(b, head, pos, dim, value) of ``attended``."""
    return attended(q, kv, group, sink).select("b", "head", "pos", F.posexplode("y").alias("dim", "value"))


def add_shared(routed: DataFrame, shared: list[float]) -> DataFrame:
    """(token_id, y): ``routed`` (token_id, x, y) plus the output x * shared of the expert that every token visits."""
    dense = F.zip_with("x", F.array(*[F.lit(float(v)) for v in shared]), lambda a, b: a * b)
    return routed.select("token_id", F.zip_with("y", dense, lambda a, b: a + b).alias("y"))


def log_lines(used: DataFrame) -> DataFrame:
    """One ``line`` an expert, its share with two decimals."""
    return used.select(F.format_string("expert %d: %.2f%%", F.col("expert"), F.col("percent")).alias("line"))
