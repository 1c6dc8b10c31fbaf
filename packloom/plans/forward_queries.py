"""Registered queries of the decoder on tiny shapes. Weights follow a rule that both sides can state, and sequences are
the rows of ``embeddings`` in eights, whose tokens come from their ids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.config import ModelConfig
from packloom.operators import transformer
from packloom.operators.transformer import FeedForward, Layer, Linear, Model
from packloom.plans import queries as q
from packloom.plans.model_queries import weights
from packloom.plans.registry import query
from packloom.plans.stash import stash

D, HEADS, WIDTH, INNER, VOCAB, LENGTH, LAYERS, STEPS, EOS = 8, 2, 4, 4, 12, 8, 2, 3, 0
CONFIG = ModelConfig(heads=HEADS, kv_heads=1, hidden=D, intermediate=INNER, layers=LAYERS, experts=2, experts_per_token=1, head_dim=WIDTH, vocab=VOCAB)


def _ffn(shift: int) -> FeedForward:
    return FeedForward(weights(2 * INNER, D, shift), weights(2 * INNER, D, shift + 1), weights(D, INNER, shift + 2))


def _layer(n: int) -> Layer:
    s = 100 * n
    return Layer(
        Linear(weights(D, D, s + 1)), Linear(weights(WIDTH, D, s + 2)), Linear(weights(WIDTH, D, s + 3)), Linear(weights(D, D, s + 4)),
        Linear(weights(2, D, s + 5)), [_ffn(s + 10), _ffn(s + 13)], _ffn(s + 31),
    )


MODEL = Model(CONFIG, [[math.cos((t + 1) * (i + 1) + 9) for i in range(D)] for t in range(VOCAB)], Linear(weights(VOCAB, D, 50), [0.01 * o for o in range(VOCAB)]), [_layer(n) for n in range(LAYERS)])


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    vec = q.read(spark, d, "embeddings")
    return vec.select(F.floor(F.col("vec_id") / LENGTH).alias("b"), (F.col("vec_id") % LENGTH).cast("int").alias("pos"), ((F.col("vec_id") * 7 + F.floor(F.col("vec_id") / 5)) % VOCAB).cast("int").alias("token"))


def _lin(e: str, out: int, shift: str) -> str:
    return f"list_transform(range({out}), lambda o_: list_sum(list_transform({e}, lambda v_, i_: v_ * cos((o_ + 1) * i_ + {shift}) / 8)))"


def _rms(e: str) -> str:
    return f"list_transform({e}, lambda v_: v_ / sqrt(list_dot_product({e}, {e}) / len({e}) + 1e-5))"


def _rope(x: str) -> str:
    one = lambda a, b, t, sign: f"{x}[{a}] * cos(pos / {t}) {sign} {x}[{b}] * sin(pos / {t})"
    return f"[{one(1, 3, '1.0', '-')}, {one(2, 4, '100.0', '-')}, {one(3, 1, '1.0', '+')}, {one(4, 2, '100.0', '+')}]"


def _gated(a: str, b: str) -> str:
    """The gate of the lane-wise product of two lists."""
    p = lambda k: f"({a}[{k}] * {b}[{k}])"
    g, line = f"least({p('2 * j_ + 1')}, 7)", f"least(greatest({p('2 * j_ + 2')}, -7), 7)"
    return f"list_transform(range({INNER}), lambda j_: {g} / (1 + exp(-1.702 * {g})) * ({line} + 1))"


def block_sql(tag: str, n: int) -> str:
    """Common table expressions from x{n}{tag} (b, pos, e) to x{n + 1}{tag}, with k and v of the layer in r{n}{tag}."""
    s, t = 100 * n, f"{n}{tag}"
    ys = ", ".join(f"sum(u * v[{j}]) / sum(u)" for j in range(1, WIDTH + 1))
    add = f"list_transform(range(1, {D + 1}), lambda j_: "
    return f"""
p{t} AS MATERIALIZED (SELECT b, pos, e, {_lin('h', D, f'{s + 1}')} AS q, {_lin('h', WIDTH, f'{s + 2}')} AS k, {_lin('h', WIDTH, f'{s + 3}')} AS v FROM (SELECT b, pos, e, {_rms('e')} AS h FROM x{t})),
n{t} AS MATERIALIZED (SELECT b, pos, e, v, {_rms('q1')} AS q1, {_rms('q2')} AS q2, {_rms('k')} AS k FROM (SELECT b, pos, e, v, k, q[1:4] AS q1, q[5:8] AS q2 FROM p{t})),
r{t} AS MATERIALIZED (SELECT b, pos, e, v, [{_rope('q1')}, {_rope('q2')}] AS q, {_rope('k')} AS k FROM n{t}),
a{t} AS MATERIALIZED (SELECT m.b, m.pos, h, exp(list_dot_product(m.q[h], c.k) / 2.0) AS u, c.v FROM r{t} m JOIN r{t} c ON m.b = c.b AND c.pos <= m.pos CROSS JOIN (VALUES (1), (2)) hs(h)),
f{t} AS MATERIALIZED (SELECT b, pos, flatten(list(y ORDER BY h)) AS y FROM (SELECT b, pos, h, [{ys}] AS y FROM a{t} GROUP BY 1, 2, 3) GROUP BY 1, 2),
y{t} AS MATERIALIZED (SELECT b, pos, {add} e[j_] + o[j_]) AS e FROM (SELECT b, pos, {_lin('y', D, f'{s + 4}')} AS o FROM f{t}) JOIN r{t} USING (b, pos)),
z{t} AS MATERIALIZED (SELECT b, pos, e, h, {_lin('h', 2, f'{s + 5}')} AS z FROM (SELECT b, pos, e, {_rms('e')} AS h FROM y{t})),
g{t} AS MATERIALIZED (SELECT b, pos, e, h, CASE WHEN z[1] >= z[2] THEN 0 ELSE 3 END AS c, 1 / (1 + exp(-abs(z[1] - z[2]))) AS w FROM z{t}),
i{t} AS MATERIALIZED (SELECT b, pos, e, c, w, {_lin('h', 2 * INNER, f'{s + 10} + c')} AS a1, {_lin('h', 2 * INNER, f'{s + 11} + c')} AS a3, {_lin('h', 2 * INNER, f'{s + 31}')} AS s1, {_lin('h', 2 * INNER, f'{s + 32}')} AS s3 FROM g{t}),
j{t} AS MATERIALIZED (SELECT b, pos, e, w, {_lin('ag', D, f'{s + 12} + c')} AS ya, {_lin('sg', D, f'{s + 33}')} AS ys FROM (SELECT b, pos, e, c, w, {_gated('a1', 'a3')} AS ag, {_gated('s1', 's3')} AS sg FROM i{t})),
x{n + 1}{tag} AS MATERIALIZED (SELECT b, pos, {add} e[j_] + w * ya[j_] + ys[j_]) AS e FROM j{t})"""


def forward_sql(tag: str, source: str) -> str:
    """Common table expressions up to l{tag} (b, pos, l), the logits of ``source`` (b, pos, token)."""
    blocks = ", ".join(block_sql(tag, n) for n in range(LAYERS))
    logits = f"list_transform(range({VOCAB}), lambda o_: 0.01 * o_ + list_sum(list_transform(h, lambda v_, i_: v_ * cos((o_ + 1) * i_ + 50) / 8)))"
    return f"""x0{tag} AS MATERIALIZED (SELECT b, pos, list_transform(range({D}), lambda i_: cos((token + 1) * (i_ + 1) + 9)) AS e FROM {source}), {blocks},
l{tag} AS MATERIALIZED (SELECT b, pos, {logits} AS l FROM (SELECT b, pos, {_rms('e')} AS h FROM x{LAYERS}{tag}))"""


TOKENS = f"t0 AS MATERIALIZED (SELECT vec_id // {LENGTH} AS b, (vec_id % {LENGTH})::INTEGER AS pos, ((vec_id * 7 + vec_id // 5) % {VOCAB})::INTEGER AS token FROM embeddings)"
LANES = "(SELECT b, pos, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS dim FROM {0})"


def _out(rows: DataFrame, array: str) -> DataFrame:
    return rows.select("b", "pos", F.posexplode(array).alias("dim", "v")).select("b", "pos", "dim", (F.round("v", 6) + 0.0).alias("value"))


def generation_sql() -> str:
    parts = [TOKENS]
    for s in range(STEPS):
        parts.append(forward_sql(f"_{s}", f"t{s}"))
        parts.append(f"n{s} AS MATERIALIZED (SELECT b, pos + 1 AS pos, (list_position(l, list_max(l)) - 1)::INTEGER AS token FROM l_{s} QUALIFY row_number() OVER (PARTITION BY b ORDER BY pos DESC) = 1)")
        parts.append(f"t{s + 1} AS MATERIALIZED (SELECT * FROM (SELECT * FROM t{s} UNION ALL SELECT * FROM n{s}) WHERE b IN (SELECT b FROM n{s} WHERE token <> {EOS}))")
    made = " UNION ALL ".join(f"SELECT * FROM n{s}" for s in range(STEPS))
    return f"WITH {', '.join(parts)} SELECT b, pos::INTEGER AS pos, token FROM ({made})"


@query("attention_projections", f"WITH {TOKENS}, {forward_sql('', 't0')} SELECT b, pos, (i - 1)::INTEGER AS dim, round(e[i], 6) + 0.0 AS value FROM (SELECT b, pos, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT b, pos, list_concat(flatten(q), list_concat(k, v)) AS e FROM r0))")
def attention_projections(spark: SparkSession, d: str) -> DataFrame:
    """The queries of two heads, then the one key and the one value that both read."""
    rows = transformer.projections(transformer.embed(_tokens(spark, d), MODEL), MODEL.layers[0], CONFIG)
    return _out(rows.withColumn("y", F.concat(F.flatten("q"), F.flatten("k"), F.flatten("v"))), "y")


@query("decoder_block", f"WITH {TOKENS}, {forward_sql('', 't0')} SELECT b, pos, dim::INTEGER AS dim, round(v, 6) + 0.0 AS value FROM {LANES.format('x1')}")
def decoder_block(spark: SparkSession, d: str) -> DataFrame:
    return _out(transformer.decoder_block(transformer.embed(_tokens(spark, d), MODEL), MODEL.layers[0], CONFIG)[0], "x")


@query("forward_logits", f"WITH {TOKENS}, {forward_sql('', 't0')} SELECT b, pos, (dim - 1)::INTEGER AS dim, round(v, 6) + 0.0 AS value FROM (SELECT b, pos, unnest(l) AS v, generate_subscripts(l, 1) AS dim FROM l)")
def forward_logits(spark: SparkSession, d: str) -> DataFrame:
    return _out(transformer.forward(_tokens(spark, d), MODEL)[0], "logits")


@query("cached_attention", f"WITH {TOKENS}, {forward_sql('', 't0')} SELECT b, pos, dim::INTEGER AS dim, round(v, 6) + 0.0 AS value FROM {LANES.format('x1')} WHERE pos >= 5")
def cached_attention(spark: SparkSession, d: str) -> DataFrame:
    """The first block of the last positions over a cache of the earlier ones: the rows that the whole pass gives."""
    x = transformer.embed(_tokens(spark, d), MODEL)
    _, kv = transformer.attention_block(x.filter("pos < 5"), MODEL.layers[0], CONFIG)
    return _out(transformer.decoder_block(x.filter("pos >= 5"), MODEL.layers[0], CONFIG, stash(kv))[0], "x")


@query("greedy_generation", generation_sql())
def greedy_generation(spark: SparkSession, d: str) -> DataFrame:
    return transformer.generate(_tokens(spark, d), MODEL, STEPS, EOS)
