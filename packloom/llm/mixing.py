"""Mixing sources to target weights by temperature.

A source's token share is raised to an exponent and normalised. The exponent is found by bisection, so that the
weights meet a target entropy or keep repetition within a limit. The weights are then realised under a token budget:
each source is read in epochs, each epoch a fresh permutation of the source by hash, and placed into blocks of the mixed
stream that take the same share of tokens from each source. The last epoch is cut where the source's budget ends.

All steps are native expressions. Permutations rank rows inside hash buckets and add up bucket totals, so a source with
a third of all rows is spread like any other. Rows equal in id, source and text are counted before they are ranked, and
epochs and copies are unfolded in bounded steps.

Defined results: a null source is a source of its own; a null or blank text has no tokens and is placed once, with the
first epoch; rows equal in id and text get places of their own, side by side; of rows that tie in the permutation the
order is that of id and text; very long texts count by their words alone; null ids are kept; an empty table gives an
empty result; extra columns of any name pass. With no tokens at all each row is placed once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.batches import fresh
from packloom.llm.quality import let
from packloom.plans.stash import BROADCAST_ROWS, exclusive_sums, join_lookup, stash

STEPS = 50
#: Sources up to which they are listed in one row to find the exponent; for more it is found by a query a step.
MAX_SOURCES = 100_000
#: Copies that are unfolded at once.
UNFOLD = 4096
BLOCK_TOKENS = 1 << 16
_NULL = "\0null"


@dataclass(frozen=True)
class Target:
    """Exactly one of: ``repetition``, at most so many epochs of a source while every source is seen whole;
    ``entropy``, of the weights, as a share of its greatest value, under a budget of ``budget`` tokens (None: as many
    as there are)."""

    repetition: float | None = None
    entropy: float | None = None
    budget: int | None = None

    def __post_init__(self) -> None:
        if (self.repetition is None) == (self.entropy is None):
            raise ValueError("give a repetition limit or a target entropy")


def tokens_of(text: Column) -> Column:
    """Words: runs of characters other than U+0020 and U+0009-U+000D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _weights(shares: Column, exponent: Column) -> Column:
    raised = F.transform(shares, lambda p: F.pow(p, exponent))
    return let(raised, lambda r: let(_sum(r), lambda z: F.transform(r, lambda x: x / z)))


def exponent_of(shares: Column, target: Target) -> Column:
    """The exponent for ``shares`` (positive, summing to 1, in a fixed order), bisected between 0 and 1."""
    if target.entropy is not None:
        even = F.log(F.size(shares).cast("double"))
        ok = lambda a: let(_weights(shares, a), lambda w: -_sum(F.transform(w, lambda x: x * F.log(x))) >= target.entropy * even)
    else:
        spread = F.array_max(shares) / F.array_min(shares)
        ok = lambda a: F.pow(spread, 1 - a) <= target.repetition
    # Entropy falls and evenness of repetition rises with the exponent: keep the end that meets the target.
    if target.entropy is not None:
        step = lambda s, _: F.when(ok((s["lo"] + s["hi"]) / 2), F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi")))
        pick, done = "lo", F.lit(1.0)
    else:
        step = lambda s, _: F.when(ok((s["lo"] + s["hi"]) / 2), F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))).otherwise(F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi")))
        pick, done = "hi", F.lit(0.0)
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s[pick])
    return F.when(ok(done), done).otherwise(found)


def plan(sources: DataFrame, target: Target, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """From (src, n_docs, total) per source: its share, exponent, weight, quota of tokens, and tokens per block."""
    listed = sources.filter("total > 0").agg(F.array_sort(F.collect_list(F.struct("src", "total"))).alias("all"))
    shares = F.transform("all", lambda x: x["total"] / F.aggregate("all", F.lit(0).cast("long"), lambda a, y: a + y["total"]))
    rows = listed.filter(F.size("all") > 0).withColumn("shares", shares).withColumn("exponent", exponent_of(F.col("shares"), target))
    rows = rows.withColumn("weights", _weights(F.col("shares"), F.col("exponent")))
    if target.repetition is not None:  # the least budget under which every source is seen whole
        budget = F.array_max(F.transform(F.arrays_zip("all", "weights"), lambda x: x["all"]["total"] / x["weights"]))
    else:
        budget = F.lit(float(target.budget)) if target.budget is not None else F.aggregate("all", F.lit(0).cast("long"), lambda a, y: a + y["total"]).cast("double")
    one = rows.withColumn("budget", budget).select("exponent", "budget", F.explode(F.arrays_zip("all", "shares", "weights")).alias("x"))
    quota = F.round(F.col("x.weights") * F.col("budget")).cast("long")
    if target.repetition is not None:
        quota = F.greatest(quota, F.col("x.all.total"))
    return one.select(F.col("x.all.src").alias("src"), F.col("x.shares").alias("share"), "exponent", F.col("x.weights").alias("weight"), quota.alias("quota"), (F.col("x.weights") * block_tokens).alias("per_block"))


def plan_wide(sources: DataFrame, target: Target, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``plan`` for any number of sources: the same bisection, with the sums of each step as aggregates."""
    live = sources.filter("total > 0")
    everything, most, least, k = live.agg(F.sum("total"), F.max("total"), F.min("total"), F.count(F.lit(1))).first()
    if not k:
        return plan(sources, target, block_tokens)
    share = F.col("total") / F.lit(everything)

    def sums(a: float) -> tuple[float, float]:
        raised = F.pow(share, F.lit(a))
        return tuple(live.agg(F.sum(raised), F.sum(raised * F.log(share))).first())

    def ok(a: float) -> bool:
        if target.repetition is not None:
            return (most / least) ** (1 - a) <= target.repetition
        z, e = sums(a)
        return math.log(z) - a * e / z >= target.entropy * math.log(k)

    done, lo, hi = (0.0 if target.repetition is not None else 1.0), 0.0, 1.0
    if ok(done):
        lo = hi = done
    else:
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            if ok(mid) == (target.repetition is not None):
                hi = mid
            else:
                lo = mid
    exponent = hi if target.repetition is not None else lo
    z, _ = sums(exponent)
    weighed = live.withColumn("weight", F.pow(share, F.lit(exponent)) / z)
    if target.repetition is not None:
        budget = weighed.agg(F.max(F.col("total") / F.col("weight"))).first()[0]
    else:
        budget = float(target.budget if target.budget is not None else everything)
    quota = F.round(F.col("weight") * budget).cast("long")
    quota = F.greatest(quota, F.col("total")) if target.repetition is not None else quota
    return weighed.select("src", share.alias("share"), F.lit(exponent).alias("exponent"), "weight", quota.alias("quota"), (F.col("weight") * block_tokens).alias("per_block"))


def unfold(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times, ``name`` counting from 0; no array is longer than ``UNFOLD`` or its number of parts."""
    parts = F.when(times > 0, F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / UNFOLD))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn(name, F.explode(parts))
    inside = F.sequence(F.col(f"`{name}`") * UNFOLD, F.least(times, (F.col(f"`{name}`") + 1) * UNFOLD) - 1)
    return rows.withColumn(name, F.explode(inside))


def _content(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def _ranked(id_col: str, text_col: str, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), _content(text_col), epoch.cast("string")))


def _prepare(docs: DataFrame, target: Target, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Distinct rows with their number ``c``, the plan of each source, and the numbers of sources and of all rows."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL)).alias("src"),
        tokens_of(F.col(text_col)).alias("n"), _content(text_col).alias("content"),
    )
    rows = stash(rows.groupBy("id", "source", "src", "n", "content").agg(F.count(F.lit(1)).alias("c")))
    sources = stash(rows.groupBy("src").agg(F.sum("c").alias("n_docs"), F.sum(F.col("n") * F.col("c")).alias("total")))
    seen = sources.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()
    found = plan(sources, target) if seen["k"] <= MAX_SOURCES else plan_wide(sources, target)
    planned = sources.join(found, "src", "left").withColumn("quota", F.coalesce("quota", F.lit(0))).withColumn("per_block", F.coalesce("per_block", F.lit(1.0)))
    # epochs that are read, and how many of them whole
    read = F.when(F.col("total") > 0, F.ceil(F.col("quota") / F.greatest("total", F.lit(1)))).otherwise(1)
    planned = planned.withColumn("epochs", F.greatest(read, F.lit(1)).cast("long")).withColumn("left", F.col("quota") - (F.col("epochs") - 1) * F.col("total"))
    return rows, stash(planned), seen["k"], seen["n"]


def _of_source(rows: DataFrame, planned: DataFrame, k: int, n: int, key: str = "src", size: str = "n_docs") -> DataFrame:
    """Join each row with its source's line of the plan; rows of a hot source stay where they are."""
    return rows.join(F.broadcast(planned), key) if k <= BROADCAST_ROWS else join_lookup(rows, planned, key, size, n)


def _offsets(copies: DataFrame, n_rows: int) -> DataFrame:
    """Add ``offset``: tokens of the same source and epoch before a row, in the order of the permutation.

    The hash is scaled to about one row a key, so a bucket of ``exclusive_sums`` holds some 4096 rows of any source.
    """
    h = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("content"), F.col("epoch").cast("string")))
    scale = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12) * max(n_rows, 1)).cast("long")
    keyed = copies.withColumn("h", h).withColumn("key", scale).withColumn("tokens", F.col("n") * F.col("c"))
    # rows that share a key are few, being about one a key
    w = Window.partitionBy("src", "epoch", "key").orderBy("h", "id", "content").rowsBetween(Window.unboundedPreceding, -1)
    per_key = keyed.groupBy("src", "epoch", "key").agg(F.sum("tokens").alias("tokens"))
    before = exclusive_sums(per_key, "key", "tokens", "before", partition=["src", "epoch"]).drop("tokens")
    inside = keyed.withColumn("inside", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return inside.join(before, ["src", "epoch", "key"]).withColumn("offset", F.col("before") + F.col("inside")).drop("before", "inside", "key", "tokens")


def mix(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per placed copy: (id, source, n_tokens, epoch, mix_block, token_offset, exponent, weight).

    ``mix_block`` is the block of the mixed stream: reading blocks in order, and a block's rows in any order, follows the
    weights within a document's length per source and block.
    """
    rows, planned, k, n = _prepare(docs, target, id_col, text_col, source_col)
    planned = planned.select("src", "n_docs", "total", "quota", "per_block", "epochs", "exponent", "weight")
    copies = unfold(_of_source(rows, planned, k, n), F.col("epochs"), "epoch")
    placed = unfold(_offsets(copies, n), F.col("c"), "nth").withColumn("offset", F.col("offset") + F.col("nth") * F.col("n"))
    at = F.col("epoch") * F.col("total") + F.col("offset")
    whole = (F.col("epoch") == 0) & (F.col("quota") >= F.col("total"))
    keep = whole | ((at < F.col("quota")) & ((F.col("n") > 0) | (F.col("epoch") == 0)))
    return placed.filter(keep).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("n").alias("n_tokens"), F.col("epoch").cast("int").alias("epoch"),
        F.floor(at / F.col("per_block")).cast("long").alias("mix_block"), at.cast("long").alias("token_offset"), F.round("exponent", 9).alias("exponent"), F.round("weight", 9).alias("weight"),
    )


def repeat(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix places it.

    The last epoch's cut is found on ids alone, as the first hash that is out, so texts are never shuffled. Copies of
    one row (equal id and text) share that hash and are in or out together.
    """
    rows, planned, k, n = _prepare(docs, target, id_col, text_col, source_col)
    last = _of_source(rows, planned, k, n).filter("total > 0").withColumn("epoch", F.col("epochs") - 1)
    cut = _offsets(last, n).filter("offset >= left").groupBy("src").agg(F.min("h").alias("cut"))
    names = docs.columns
    key, size, mark, copy = (fresh(docs, x) for x in ("mix_key", "mix_size", "mix_rule", "mix_copy"))
    rule = planned.join(cut, "src", "left").select(F.col("src").alias(key), F.col("n_docs").alias(size), F.struct("epochs", "cut", (F.col("total") == 0).alias("blank")).alias(mark))
    out = _of_source(docs.withColumn(key, F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL))), stash(rule) if k > BROADCAST_ROWS else rule, k, n, key, size)
    of = lambda x: F.col(f"{mark}.{x}")
    h = _ranked(id_col, text_col, of("epochs") - 1)
    tail = of("cut").isNull() | (h < of("cut"))
    times = F.when(of("blank"), 1).when(tokens_of(F.col(text_col)) == 0, 1).otherwise(of("epochs") - F.when(tail, 0).otherwise(1))
    return unfold(out, times, copy).select(*[F.col(f"`{c}`") for c in names])
