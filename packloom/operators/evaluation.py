"""Losses, perplexity, throughput, early stopping, and sampling from logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.plans.stash import join_lookup


def target_counts(chunks: DataFrame, eos: str, by: Column | None = None) -> DataFrame:
    """(by, target, n): how often each target other than ``eos`` stands in the chunks, in all or by a column."""
    targets = F.filter(F.slice("tokens", F.lit(2), F.size("tokens") - 1), lambda t: t != eos)
    keys = [by.alias("by")] if by is not None else []
    rows = chunks.select(*keys, F.explode(targets).alias("target"))
    return rows.groupBy(*(["by"] if keys else []), "target").agg(F.count(F.lit(1)).alias("n"))


def unigram_nll(counts: DataFrame) -> DataFrame:
    """(target, n, nll) from (target, n): -log of a target's add-one share. One row a target, no row a token."""
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    return counts.crossJoin(F.broadcast(total)).select("target", "n", (-F.log((F.col("n") + 1) / (F.col("all") + F.col("kinds")))).alias("nll"))


def mean_nll(rated: DataFrame) -> DataFrame:
    """(loss, n): the mean over all counted tokens."""
    return rated.agg((F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def perplexity(loss: Column, cap: float = 10.0) -> Column:
    return F.exp(F.least(loss, F.lit(cap)))


def mean_of_batches(losses: DataFrame, batch: str = "batch_id", most: int = 5000) -> DataFrame:
    """The mean over the first ``most`` batches of each batch's mean loss: batches, not tokens, weigh the same.
    Rows are (batch, nll, n), n of a kind."""
    means = losses.groupBy(batch).agg((F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("m")).orderBy(batch).limit(most)
    return means.agg((F.coalesce(F.sum("m"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("loss"), F.count(F.lit(1)).alias("batches"))


def mean_over_ranks(losses: DataFrame, rank: str = "rank", steps: int | None = None) -> DataFrame:
    """Sum over all ranks by (steps of a rank times ranks)."""
    per = losses.groupBy(rank).agg(F.sum("loss").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.max("n") if steps is None else F.lit(steps)
    return per.agg((F.sum("s") / (n * F.count(F.lit(1)))).alias("loss"))


def clip(vectors: DataFrame, most: float = 1.0) -> DataFrame:
    """The L2 norm over all components of (name, g) and the factor that brings it within ``most``."""
    norm = F.sqrt(F.sum(F.aggregate("g", F.lit(0.0), lambda a, x: a + x * x)))
    return vectors.agg(norm.alias("norm"), F.least(F.lit(1.0), most / (norm + 1e-6)).alias("factor"))


def accumulate(losses: DataFrame, every: int = 16) -> DataFrame:
    """(update, loss): micro-steps' losses over ``every``, summed for each update."""
    return losses.groupBy(F.floor(F.col("step") / every).alias("update")).agg((F.sum("loss") / every).alias("loss"))


def at_cadence(step: Column, every: int) -> Column:
    return (step + 1) % every == 0


def patience(evals: DataFrame, most: int = 8, run: str = "run") -> DataFrame:
    """(run, eval, loss, best, waited, stop): evaluations since the last strict improvement, for each run."""
    order = Window.partitionBy(run).orderBy("eval")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = evals.withColumn("_b", F.min("loss").over(before)).withColumn("_new", F.col("_b").isNull() | (F.col("loss") < F.col("_b")))
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("int")).over(order))
    inside = Window.partitionBy(run, "_run").orderBy("eval")
    waited = F.row_number().over(inside) - 1
    return rows.select(run, "eval", "loss", F.least("loss", "_b").alias("best"), waited.alias("waited"), (waited >= most).alias("stop"))


def throughput(steps: Column, tokens_per_step: Column, seconds: Column) -> Column:
    return F.try_divide(steps * tokens_per_step, seconds)


def sample_top_k(logits: DataFrame, k: int = 50, key: str = "step") -> DataFrame:
    """(key, token, p, chosen) for rows (key, token, logit, u): the k best logits, softmax, and the first token whose
    cumulative share exceeds the supplied uniform ``u``. Ties go to the lower token."""
    best = Window.partitionBy(key).orderBy(F.desc("logit"), "token")
    rows = logits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    whole = Window.partitionBy(key)
    rows = rows.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(whole))).withColumn("p", F.col("e") / F.sum("e").over(whole))
    upto = Window.partitionBy(key).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c", F.sum("p").over(upto))
    hit = F.when((F.col("c") > F.col("u")) | (F.col("r") == F.max("r").over(whole)), F.col("r"))
    return rows.withColumn("first", F.min(hit).over(whole)).select(key, "token", "p", (F.col("r") == F.col("first")).alias("chosen"))


def until_eos(tokens: DataFrame, eos: str, key: str = "seq", pos: str = "pos", token: str = "token") -> DataFrame:
    """Rows of each sequence up to its first end token, which stays."""
    stop = F.min(F.when(F.col(token) == eos, F.col(pos))).over(Window.partitionBy(key))
    return tokens.withColumn("_s", stop).filter(F.col("_s").isNull() | (F.col(pos) <= F.col("_s"))).drop("_s")


def decode(ids: DataFrame, vocab: DataFrame, total: int, key: str = "seq") -> DataFrame:
    """(key, text): tokens of (key, pos, id) joined in order. ``vocab`` (id, token, n) holds in n how many of the
    ``total`` rows have an id, so that rows of frequent tokens stay where they are."""
    rows = join_lookup(ids, vocab.select("id", "token", "n"), "id", "n", total).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return rows.select(key, F.array_join(F.col("x.token"), " ").alias("text"))


def last_position(rows: DataFrame, key: str = "seq", pos: str = "pos") -> DataFrame:
    """The row of the greatest position of each sequence."""
    rest = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(rest, F.col(pos)).alias("_x")).select(key, "_x.*")


def adamw(rows: DataFrame, step: int, rate: float, beta1: float = 0.9, beta2: float = 0.95, eps: float = 1e-8, decay: float = 0.01) -> DataFrame:
    """(name, p, m, v) after one decoupled-decay Adam step on arrays (name, p, g, m, v)."""
    m = F.zip_with("m", "g", lambda a, g: beta1 * a + (1 - beta1) * g)
    v = F.zip_with("v", "g", lambda a, g: beta2 * a + (1 - beta2) * g * g)
    moved = rows.select("name", "p", m.alias("m"), v.alias("v"))
    ratio = F.zip_with("m", "v", lambda a, b: (a / (1 - beta1**step)) / (F.sqrt(b / (1 - beta2**step)) + eps))
    p = F.zip_with("p", ratio, lambda x, r: x * (1 - rate * decay) - rate * r)
    return moved.select("name", p.alias("p"), "m", "v")


def stop_flags(votes: DataFrame, step: str = "step") -> DataFrame:
    """(step, stop): all ranks stop where any of them asks for it."""
    return votes.groupBy(step).agg(F.max("stop").alias("stop"))


def gigabytes(size: Column) -> Column:
    return size / 1e9
