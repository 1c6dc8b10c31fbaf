"""Small-shape tensor formulas on array columns: norms, activations, rotary positions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, also where ``body`` uses it inside a function of lanes."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rms_norm(x: Column, scale: Column | float = 1.0, eps: float = 1e-5) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x)
    scale = F.lit(scale) if isinstance(scale, int | float) else scale
    return let(F.sqrt(mean + eps), lambda m: F.transform(x, lambda v: v / m * scale))


def swiglu(x: Column, alpha: float = 1.702, limit: float = 7.0) -> Column:
    """Even lanes gate (bounded above), odd lanes are linear (bounded on both sides)."""

    def pair(i: Column) -> Column:
        g = F.least(F.get(x, 2 * i), F.lit(limit))
        line = F.least(F.greatest(F.get(x, 2 * i + 1), F.lit(-limit)), F.lit(limit))
        return g / (1 + F.exp(-alpha * g)) * (line + 1)

    return F.transform(F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1), pair)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = let(top, lambda t: F.transform(scores, lambda z: F.exp(z - t)))
    return let(raised, lambda r: let(F.aggregate(r, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(r, lambda u: u / total)))


def yarn_frequencies(head_dim: int, base: float = 10_000.0, scale: float = 1.0, initial: int = 2048, alpha: float = 1.0, beta: float = 32.0) -> tuple[float, list[float]]:
    """The concentration, and the inverse frequency of each lane pair, blended between interpolation and extrapolation."""
    half = head_dim // 2
    periods = [base ** (2 * i / head_dim) for i in range(half)]
    if scale <= 1.0:
        return 1.0, [1 / p for p in periods]
    edge = lambda turns: half * math.log(initial / (turns * 2 * math.pi)) / math.log(base)
    low, high = edge(beta), edge(alpha)
    if not 0 < low < high < half - 1:
        raise ValueError("rotary cut-offs are out of order")
    share = [1 - min(max((i - low) / (high - low), 0.0), 1.0) for i in range(half)]
    return 0.1 * math.log(scale) + 1, [(1 - s) / (scale * p) + s / p for s, p in zip(share, periods, strict=True)]


def rope(x: Column, position: Column, frequencies: list[float], concentration: float = 1.0) -> Column:
    """Rotate lane i with lane i + d/2."""
    half = len(frequencies)
    f = F.array(*[F.lit(v) for v in frequencies])
    angle = lambda i: position * F.get(f, i)
    lanes = F.sequence(F.lit(0), F.lit(half - 1))
    a, b = (lambda i: F.get(x, i)), (lambda i: F.get(x, i + half))
    first = F.transform(lanes, lambda i: (a(i) * F.cos(angle(i)) - b(i) * F.sin(angle(i))) * concentration)
    second = F.transform(lanes, lambda i: (b(i) * F.cos(angle(i)) + a(i) * F.sin(angle(i))) * concentration)
    return F.concat(first, second)


def cosine_schedule(step: Column, rate: float = 3e-4, warmup: int = 2000, total: int = 100_000, floor: float = 0.0) -> Column:
    """Linear warm-up, then half a cosine down to ``floor`` of the rate."""
    done = F.least((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(1.0))
    cosine = F.greatest(F.lit(floor), floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * done)))
    return rate * F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(cosine)


def linear(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """One dot product a row of ``weights``, plus its bias. The weights are a literal, bounded by the model's size."""
    numbers = lambda w: ", ".join(f"{float(v)!r}D" for v in w)
    rows = F.expr("array(" + ", ".join(f"named_struct('w', array({numbers(w)}), 'b', {float(b)!r}D)" for w, b in zip(weights, bias or [0.0] * len(weights), strict=True)) + ")")
    return let(x, lambda v: F.transform(rows, lambda r: dot(v, r["w"]) + r["b"]))


def feed_forward(x: Column, first: list[list[float]], third: list[list[float]], second: list[list[float]]) -> Column:
    """Two projections to 2 * I lanes, multiplied lane by lane, gated down to I lanes and projected back."""
    return linear(let(F.zip_with(linear(x, first), linear(x, third), lambda a, b: a * b), swiglu), second)


def norm_and_rotate(x: Column, heads: int, position: Column, frequencies: list[float]) -> Column:
    """Each head's lanes normalised, then rotated by their position."""
    width = 2 * len(frequencies)
    return F.concat(*[let(rms_norm(F.slice(x, h * width + 1, width)), lambda v: rope(v, position, frequencies)) for h in range(heads)])


def at_offset(rows: DataFrame, table: DataFrame, positions: int, most: int = 1 << 17) -> DataFrame:
    """Rows (pos, offset) joined with the lines (pos, …) of a position table at pos + offset. The table is broadcast if it
    has at most ``most`` positions."""
    table = table.withColumnRenamed("pos", "_at")
    return rows.join(F.broadcast(table) if positions <= most else table, F.col("pos") + F.col("offset") == F.col("_at")).drop("_at")


def init_deviation(name: str, layers: int) -> float:
    """The deviation of a tensor's first values by its name; 0 for biases, -1 for scales, which start at 1."""
    if "norm" in name:
        return -1.0
    if name.endswith(".b"):
        return 0.0
    if ".gate." in name:
        return 0.01
    return 0.02 / math.sqrt(2 * layers) if name.endswith((".o.w", ".w2.w")) else 0.02


def init_values(shapes: DataFrame, layers: int, seed: int) -> DataFrame:
    """(name, i, value) of tensors (name, shape): normal values from the MD5 of name, index and seed."""
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    name = F.col("name")
    deviation = (
        F.when(F.contains(name, F.lit("norm")), -1.0).when(F.endswith(name, F.lit(".b")), 0.0).when(F.contains(name, F.lit(".gate.")), 0.01)
        .when(F.endswith(name, F.lit(".o.w")) | F.endswith(name, F.lit(".w2.w")), 0.02 / math.sqrt(2 * layers)).otherwise(0.02)
    )
    h = F.md5(F.concat_ws("|", name, F.col("i").cast("string"), F.lit(str(seed))).cast("binary"))
    u = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    rows = shapes.select("name", deviation.alias("std"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    drawn = F.col("std") * F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(9))
    return rows.select("name", "i", F.when(F.col("std") < 0, 1.0).otherwise(drawn).alias("value"))


def dropout(x: Column, rate: float, key: Column, training: bool) -> Column:
    """Lanes set to 0 with chance ``rate`` by the MD5 of key and lane, the others scaled up; the identity at rate 0 and
    outside training."""
    if not training or not rate:
        return x
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.transform(x, lambda v, i: F.when(draw(i) < rate * float(1 << 32), 0.0).otherwise(v / (1 - rate)))


def autocast(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of each lane in single precision, back in double."""
    return F.transform(x.cast("array<float>"), lambda v: body(v).cast("float")).cast("array<double>")
