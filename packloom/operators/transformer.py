"""The decoder on small shapes: blocks, full forward pass, and greedy generation over a key and value cache.

Rows are positions (b, pos, x); weights are literals of the plan, so shapes are those of a small model. Attention joins
the positions of one sequence, which the model's context bounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.config import ModelConfig
from packloom.functions import tensor
from packloom.operators.evaluation import last_position
from packloom.operators.routing import attended
from packloom.plans.stash import small, stash

Matrix = list[list[float]]


@dataclass(frozen=True)
class Linear:
    weights: Matrix
    bias: list[float] | None = None

    def __call__(self, x: Column) -> Column:
        return tensor.linear(x, self.weights, self.bias)


@dataclass(frozen=True)
class FeedForward:
    first: Matrix
    third: Matrix
    second: Matrix

    def __call__(self, x: Column) -> Column:
        return tensor.feed_forward(x, self.first, self.third, self.second)


@dataclass(frozen=True)
class Layer:
    """Keys and values are narrower than queries where fewer heads serve them."""

    q: Linear
    k: Linear
    v: Linear
    o: Linear
    gate: Linear
    experts: list[FeedForward]
    shared: FeedForward


@dataclass(frozen=True)
class Model:
    config: ModelConfig
    embedding: Matrix
    unembedding: Linear
    layers: list[Layer] = field(default_factory=list)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _heads(x: str, count: int, width: int) -> Column:
    return F.array(*[F.slice(x, h * width + 1, F.lit(width)) for h in range(count)])


def projections(rows: DataFrame, layer: Layer, c: ModelConfig) -> DataFrame:
    """(b, pos, x, q, k, v) with an array a head: projected from the normalised row, queries and keys normalised by head
    and then rotated to their position."""
    concentration, f = tensor.yarn_frequencies(c.head_dim, c.rope_base, c.rope_scale, c.initial_context, c.rope_alpha, c.rope_beta)
    if concentration != 1.0:
        raise ValueError("small shapes are not scaled beyond their context")
    rows = rows.withColumn("h", tensor.rms_norm(F.col("x")))
    turn = lambda y, n: tensor.norm_and_rotate(y, n, F.col("pos"), f)
    rows = rows.select("b", "pos", "x", turn(layer.q(F.col("h")), c.heads).alias("q"), turn(layer.k(F.col("h")), c.kv_heads).alias("k"), layer.v(F.col("h")).alias("v"))
    return rows.select("b", "pos", "x", _heads("q", c.heads, c.head_dim).alias("q"), _heads("k", c.kv_heads, c.head_dim).alias("k"), _heads("v", c.kv_heads, c.head_dim).alias("v"))


def attention_block(rows: DataFrame, layer: Layer, c: ModelConfig, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """x + o(attention(norm(x))) for new positions, and their keys and values (b, kv_head, pos, k, v).

    With a ``cache`` of earlier positions only the new ones are projected; each sees the cache and those up to itself.
    """
    made = stash(projections(rows, layer, c))
    kv = made.select("b", "pos", F.posexplode(F.arrays_zip("k", "v")).alias("kv_head", "y")).select("b", "kv_head", "pos", "y.k", "y.v")
    seen = kv if cache is None else cache.unionByName(kv)
    q = made.select("b", "pos", F.posexplode("q").alias("head", "q"))
    y = attended(q, seen, c.heads // c.kv_heads).groupBy("b", "pos").agg(F.sort_array(F.collect_list(F.struct("head", "y"))).alias("ys"))
    y = y.select("b", "pos", F.flatten(F.col("ys.y")).alias("y"))
    return made.select("b", "pos", "x").join(y, ["b", "pos"]).select("b", "pos", _plus(F.col("x"), layer.o(F.col("y"))).alias("x")), kv


def expert_block(rows: DataFrame, layer: Layer, c: ModelConfig, rate: float = 0.0, training: bool = False) -> DataFrame:
    """x + the weighted outputs of the chosen experts + the shared expert's, of the normalised row. An expert is
    evaluated only for rows that chose it. ``rate`` drops lanes of the sum in training mode only."""
    rows = rows.withColumn("h", tensor.rms_norm(F.col("x"))).withColumn("g", tensor.softmax(layer.gate(F.col("h"))))
    ranked = F.array_sort(F.transform("g", lambda s, i: F.struct((-s).alias("o"), i.alias("i"))))
    rows = rows.withColumn("chosen", F.transform(F.slice(ranked, 1, c.experts_per_token), lambda s: s["i"]))

    def of(e: int, expert: FeedForward) -> Column:
        out = F.transform(expert(F.col("h")), lambda v: v * F.get("g", F.lit(e)))
        return F.when(F.array_contains("chosen", F.lit(e)), out).otherwise(F.transform("h", lambda _: F.lit(0.0)))

    y = reduce(_plus, [of(e, x) for e, x in enumerate(layer.experts)], layer.shared(F.col("h")))
    rows = rows.select("b", "pos", "x", y.alias("y"))
    return rows.select("b", "pos", _plus(F.col("x"), tensor.dropout(F.col("y"), rate, F.concat_ws("|", "b", "pos"), training)).alias("x"))


def decoder_block(rows: DataFrame, layer: Layer, c: ModelConfig, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    rows, kv = attention_block(rows, layer, c, cache)
    return stash(expert_block(rows, layer, c)), kv


def embed(tokens: DataFrame, model: Model) -> DataFrame:
    """(b, pos, x) of (b, pos, token)."""
    table = tokens.sparkSession.createDataFrame(list(enumerate(model.embedding)), "token int, x array<double>")
    return tokens.withColumn("token", F.col("token").cast("int")).join(small(table, len(model.embedding)), "token").select("b", "pos", "x")


def forward(tokens: DataFrame, model: Model, caches: list[DataFrame] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(b, pos, logits) of new positions (b, pos, token), and each layer's keys and values of them."""
    rows, made = embed(tokens, model), []
    for k, layer in enumerate(model.layers):
        rows, kv = decoder_block(rows, layer, model.config, caches[k] if caches else None)
        made.append(kv)
    return rows.select("b", "pos", model.unembedding(tensor.rms_norm(F.col("x"))).alias("logits")), made


def generate(prompts: DataFrame, model: Model, steps: int, eos: int) -> DataFrame:
    """(b, pos, token): the likeliest next token, ``steps`` times, ties to the lower id; a sequence ends with its ``eos``.

    Each step runs the new position alone over the cache, which grows by that position and is written once a step.
    """
    caches: list[DataFrame] | None = None
    new, out = prompts.select("b", "pos", "token"), []
    for _ in range(steps):
        logits, made = forward(new, model, caches)
        caches = [stash(kv if caches is None else caches[k].unionByName(kv)) for k, kv in enumerate(made)]
        last = last_position(logits, "b", "pos")
        token = (F.array_position("logits", F.array_max("logits")) - 1).cast("int")
        new = stash(last.select("b", (F.col("pos") + 1).alias("pos"), token.alias("token")))
        out.append(new)
        new = new.filter(F.col("token") != eos)
    return reduce(lambda a, b: a.unionByName(b), out)
