"""Tokenise, close each document with an end-of-sequence token, join all in order, cut into chunks of fixed width."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.config import EOS, PackConfig
from packloom.plans.stash import ranked_sums, stash

Tokenizer = Callable[[Column], Column]


def by_space(text: Column) -> Column:
    """Tokens between single spaces; a null text has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, " ", -1))


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer = by_space) -> DataFrame:
    """(key, tokens): no truncation and no padding."""
    return docs.select(key, tokenizer(F.col(text)).alias("tokens"))


def tokenize_arrow(docs: DataFrame, build: Callable[[], Callable[[list[str]], list[list[int]]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens) with ids of any tokenizer: ``build`` makes it once in each Python task, batches go through Arrow.
    A null text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = build()
        for b in batches:
            ids = encode([t or "" for t in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(ids, pa.list_(pa.int32()))], names=[key, "tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)['key']}, tokens array<int>")


def append_eos(tokens: DataFrame, eos: str | int = EOS) -> DataFrame:
    """One end token after every document, an empty one too."""
    return tokens.withColumn("tokens", F.concat("tokens", F.array(F.lit(eos))))


def pack(tokens: DataFrame, width: int, key: str = "doc_id", keep_tail: bool = False, partition: list[str] | None = None) -> DataFrame:
    """(chunk_id, tokens): documents joined in the order of ``key``, cut with a stride equal to the width.

    ``key`` may have any type and spacing, repeat or be null: nulls come first, and rows of one key keep their order in
    the input. Tokens are made once and written to the shared folder; only lengths take part in the running sum. Arrays
    then meet their offsets by row (a shuffle of the arrays unless the offsets are small enough to be broadcast) and are
    shuffled once more, cut where chunks end and never token by token, into chunks. The unfinished last chunk is dropped
    unless ``keep_tail``. With ``partition`` columns each of their values is packed by itself, with its own tail.
    """
    part = partition or []
    rows = stash(tokens.select(*part, key, "tokens", F.size("tokens").cast("long").alias("n"), F.monotonically_increasing_id().alias("row")))
    starts = ranked_sums(rows.select(*part, key, "row", "n"), [*part, key, "row"], "n", "start")
    if part:
        first = starts.groupBy(*part).agg(F.min("start").alias("_s"))
        same = reduce(lambda x, y: x & y, [starts[c].eqNullSafe(first[c]) for c in part])
        starts = starts.join(first, same).withColumn("start", F.col("start") - F.col("_s"))
    placed = rows.join(starts.select("row", "start"), "row").filter("n > 0")
    last = F.floor((F.col("start") + F.col("n") - 1) / width)
    cut = placed.withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("start") / width), last)))
    begin = F.greatest(F.col("chunk_id") * width - F.col("start"), F.lit(0))
    end = F.least((F.col("chunk_id") + 1) * width - F.col("start"), F.col("n"))
    piece = F.struct((F.col("start") + begin).alias("at"), F.slice("tokens", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    chunks = cut.select(*part, "chunk_id", piece.alias("piece")).groupBy(*part, "chunk_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    chunks = chunks.select(*part, "chunk_id", F.flatten(F.col("pieces.part")).alias("tokens"))
    return chunks if keep_tail else chunks.filter(F.size("tokens") == width)


def pack_documents(docs: DataFrame, config: PackConfig = PackConfig(), tokenizer: Tokenizer = by_space, key: str = "doc_id", text: str = "text", keep_tail: bool = False) -> DataFrame:
    return pack(append_eos(tokenize(docs, key, text, tokenizer), config.eos), config.width, key, keep_tail)


def batch(chunks: DataFrame, size: int = 8) -> DataFrame:
    """(batch_id, n_chunks, chunks): groups in order; a short last group stays."""
    grouped = chunks.withColumn("batch_id", F.floor(F.col("chunk_id") / size)).groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "tokens"))).alias("rows"))
    return grouped.select("batch_id", F.size("rows").alias("n_chunks"), F.col("rows.tokens").alias("chunks"))


def shift(chunks: DataFrame) -> DataFrame:
    """(chunk_id, inputs, targets): all but the last token, and all but the first."""
    n = F.size("tokens") - 1
    return chunks.select("chunk_id", F.slice("tokens", F.lit(1), n).alias("inputs"), F.slice("tokens", F.lit(2), n).alias("targets"))


def pairs(chunks: DataFrame) -> DataFrame:
    """(chunk_id, pos, input, target), one row per position."""
    rows = shift(chunks).select("chunk_id", F.posexplode(F.arrays_zip("inputs", "targets")).alias("pos", "x"))
    return rows.select("chunk_id", "pos", F.col("x.inputs").alias("input"), F.col("x.targets").alias("target"))


def mask_targets(rows: DataFrame, eos: str = EOS) -> DataFrame:
    """Positions that count in a loss: an end token is an input but never a target."""
    return rows.filter(F.col("target") != eos)


def round_robin(files: DataFrame, world: int, path: str = "path") -> DataFrame:
    """Add ``rank``: sorted files dealt out in turn. Paths must differ; they are counted range by range."""
    ranked = ranked_sums(files.withColumn("_one", F.lit(1).cast("long")), [path], "_one", "_before")
    return ranked.withColumn("rank", F.pmod(F.col("_before"), F.lit(world))).drop("_one", "_before")


def rank_packed(tokens: DataFrame, world: int, workers: int, width: int, file: str = "path", key: str = "doc_id") -> DataFrame:
    """(rank, worker, chunk_id, tokens): the files of each rank, whose rows its workers take in turn; each worker packs
    its own stream and drops its own tail."""
    ranks = round_robin(tokens.select(file).distinct(), world, file).select(file, "rank")
    rows = tokens.join(ranks, file)
    turn = ranked_sums(rows.select("rank", file, key).withColumn("_one", F.lit(1).cast("long")), ["rank", file, key], "_one", "_n")
    first = turn.groupBy("rank").agg(F.min("_n").alias("_s"))
    turn = turn.join(first, "rank").select(file, key, F.pmod(F.col("_n") - F.col("_s"), F.lit(workers)).alias("worker"), (F.col("_n") - F.col("_s")).alias("_order"))
    dealt = rows.join(turn, [file, key]).select("rank", "worker", F.col("_order"), "tokens")
    return pack(dealt, width, "_order", partition=["rank", "worker"])


def rank_files(files: DataFrame, rank: int, world: int, path: str = "path") -> DataFrame:
    mine = round_robin(files, world, path).filter(F.col("rank") == rank)
    if mine.isEmpty():
        raise ValueError(f"rank {rank} of {world} has no files")
    return mine


def shuffled(docs: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """Add ``position``: a reproducible random order by the MD5 of key and seed. Keys must differ."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    ranked = ranked_sums(docs.select(key, h.alias("_h"), F.lit(1).cast("long").alias("_one")), ["_h", key], "_one", "position")
    return docs.join(ranked.select(key, "position"), key)
