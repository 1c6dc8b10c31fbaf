"""Registered queries over the shared tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.config import EOS, ModelConfig, PackConfig
from packloom.functions import tensor
from packloom.operators import evaluation, packing, routing
from packloom.plans.registry import query
from packloom.plans.stash import join_lookup, stash
from packloom.sources import checkpoints, listing

C = PackConfig()
EXPERTS, TOP = 8, 2
SEQ, HEADS, KV, HEAD_DIM = 16, 4, 2, 8  # blocks of 16 rows are the sequences of the attention queries
LIVE = ModelConfig()


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def chunks_of(spark: SparkSession, d: str, keep_tail: bool = False) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"), C, keep_tail=keep_tail)


# --- packing -------------------------------------------------------------------------------------------------------

TOKENS = f"""
t AS (SELECT doc_id, list_append(string_split(text, ' '), '{EOS}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM t),
p AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM u),
c AS (SELECT pos // {C.width} AS chunk_id, pos % {C.width} AS at_, tok FROM p),
whole AS (SELECT chunk_id FROM c GROUP BY 1 HAVING count(*) = {C.width}),
pairs AS (SELECT a.chunk_id, a.at_ AS pos, a.tok AS input, b.tok AS target FROM c a JOIN c b ON a.chunk_id = b.chunk_id AND b.at_ = a.at_ + 1 WHERE a.chunk_id IN (SELECT chunk_id FROM whole))
"""


SQL_PACKED_BY = "WITH " + TOKENS.replace("ORDER BY doc_id, i", "ORDER BY {key}, i") + f" SELECT chunk_id, count(*) AS n_tokens, md5(string_agg(tok, ' ' ORDER BY at_)) AS tokens_md5 FROM c GROUP BY 1 HAVING count(*) = {C.width}"


@query("pack_sequences", f"WITH {TOKENS} SELECT chunk_id, count(*) AS n_tokens, md5(string_agg(tok, ' ' ORDER BY at_)) AS tokens_md5 FROM c GROUP BY 1 HAVING count(*) = {C.width}")
def pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("dropped_tail", f"WITH {TOKENS} SELECT count(*) AS n_tokens, count(*) // {C.width} AS n_chunks, count(*) % {C.width} AS dropped FROM p")
def dropped_tail(spark: SparkSession, d: str) -> DataFrame:
    n = packing.append_eos(packing.tokenize(read(spark, d, "documents"))).agg(F.sum(F.size("tokens")).alias("n_tokens"))
    return n.select("n_tokens", F.floor(F.col("n_tokens") / C.width).alias("n_chunks"), (F.col("n_tokens") % C.width).alias("dropped"))


@query("tokenize_counts", "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n_tokens FROM documents")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return packing.tokenize(read(spark, d, "documents")).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@query("append_eos", f"SELECT doc_id, len(w)::BIGINT AS n_tokens, w[-1] AS last_token FROM (SELECT doc_id, list_append(string_split(text, ' '), '{EOS}') AS w FROM documents)")
def append_eos(spark: SparkSession, d: str) -> DataFrame:
    t = packing.append_eos(packing.tokenize(read(spark, d, "documents")))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.element_at("tokens", -1).alias("last_token"))


@query("batch_chunks", f"WITH {TOKENS} SELECT chunk_id // {C.batch} AS batch_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM whole GROUP BY 1")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    b = packing.batch(chunks_of(spark, d), C.batch)
    return b.select("batch_id", F.col("n_chunks").cast("long").alias("n_chunks"), (F.col("batch_id") * C.batch).alias("first_chunk"))


@query("next_token_pairs", f"WITH {TOKENS} SELECT chunk_id, count(*) AS n_pairs, md5(string_agg(input || '>' || target, ' ' ORDER BY pos)) AS pairs_md5 FROM pairs GROUP BY 1")
def next_token_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = packing.shift(chunks_of(spark, d))
    joined = F.array_join(F.zip_with("inputs", "targets", lambda a, b: F.concat(a, F.lit(">"), b)), " ")
    return s.select("chunk_id", F.size("inputs").cast("long").alias("n_pairs"), F.md5(joined).alias("pairs_md5"))


@query("eos_target_mask", f"WITH {TOKENS} SELECT chunk_id, count(*) FILTER (WHERE target <> '{EOS}') AS scored, count(*) FILTER (WHERE target = '{EOS}') AS masked FROM pairs GROUP BY 1")
def eos_target_mask(spark: SparkSession, d: str) -> DataFrame:
    s = packing.shift(chunks_of(spark, d))
    kept = F.size(F.filter("targets", lambda t: t != EOS)).cast("long")
    return s.select("chunk_id", kept.alias("scored"), (F.size("targets") - kept).alias("masked"))


@query("vocab_table", f"WITH {TOKENS}, n AS (SELECT tok AS token, count(*) AS n FROM p GROUP BY 1) SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM n")
def vocab_table(spark: SparkSession, d: str) -> DataFrame:
    t = packing.append_eos(packing.tokenize(read(spark, d, "documents")))
    counts = t.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary(counts)


def vocabulary(counts: DataFrame) -> DataFrame:
    """(token, n, id): ids by falling count. Ids come from a global sort, whose ranges give each task its offset."""
    ranged = stash(counts.repartitionByRange(F.desc("n"), "token").select("token", "n", F.spark_partition_id().alias("_p")))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p").orderBy(F.desc("n"), "token")
    return ranged.join(offsets, "_p").select("token", "n", (F.row_number().over(inside) - 1 + F.col("_o")).alias("id"))


@query("decode_tokens", "SELECT doc_id AS seq, array_to_string(string_split(text, ' '), ' ') AS text FROM documents")
def decode_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = packing.tokenize(read(spark, d, "documents")).select(F.col("doc_id").alias("seq"), F.posexplode("tokens").alias("pos", "token"))
    vocab = stash(t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.xxhash64("token")))
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return evaluation.decode(join_lookup(t, vocab, "token", "n", total).select("seq", "pos", "id"), vocab, total)


# --- sources -------------------------------------------------------------------------------------------------------


@query("shard_round_robin", "SELECT url, (row_number() OVER (ORDER BY url) - 1) % 4 AS rank FROM (SELECT DISTINCT url FROM pages)")
def shard_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return packing.round_robin(read(spark, d, "pages").select("url").distinct(), 4, "url").select("url", F.col("rank").cast("long").alias("rank"))


@query("dedupe_order", "SELECT text_md5, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_md5, doc_id FROM documents) GROUP BY 1")
def dedupe_order(spark: SparkSession, d: str) -> DataFrame:
    keyed = read(spark, d, "documents").select(F.md5(F.col("text")).alias("text_md5"), "doc_id")
    return listing.first_occurrences(keyed, "text_md5", "doc_id")


PATHS = "lang || (['', '.noclean', '.noblocklist', '.other'])[doc_id % 4 + 1] || '/' || CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END || '.json'"


@query("language_filter", f"SELECT 'variants' AS mode, path, count(*) AS n FROM (SELECT {PATHS} AS path FROM documents) WHERE split_part(path, '/', 1) IN ('en', 'en.noclean', 'en.noblocklist') GROUP BY 2 UNION ALL SELECT 'strict', path, count(*) FROM (SELECT {PATHS} AS path FROM documents) WHERE path = 'de/train.json' GROUP BY 2")
def language_filter(spark: SparkSession, d: str) -> DataFrame:
    """Paths in four variants of each language's folder, with their validation shards."""
    variant = F.get(F.array(*[F.lit(v) for v in ("", ".noclean", ".noblocklist", ".other")]), (F.col("doc_id") % 4).cast("int"))
    name = F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train")
    files = read(spark, d, "documents").select(F.concat("lang", variant, F.lit("/"), name, F.lit(".json")).alias("path"))
    found = {"variants": listing.language_files(files, "en", variants=True), "strict": listing.language_files(files, "de", split="train")}
    rows = [x.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "path", "n") for mode, x in found.items()]
    return rows[0].unionByName(rows[1])


@query("top_segment", "SELECT split_part(replace(url, '://', '_'), '/', 1) AS segment, count(*) AS n FROM pages GROUP BY 1")
def top_segment(spark: SparkSession, d: str) -> DataFrame:
    path = F.replace("url", F.lit("://"), F.lit("_"))
    return read(spark, d, "pages").groupBy(listing.top_segment(path).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("shard_urls", "SELECT page_id, 'https://host/resolve/main/' || url AS url FROM pages")
def shard_urls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", listing.to_url(F.col("url"), "https://host/resolve/main/").alias("url"))


@query("gpu_rows", "SELECT trim(s_name) AS name, s_suppkey::VARCHAR AS driver, s_nationkey || ' MiB' AS memory FROM supplier WHERE s_suppkey % 3 <> 0")
def gpu_rows(spark: SparkSession, d: str) -> DataFrame:
    """A listing with blanks around its fields, every third line short of one."""
    s = read(spark, d, "supplier")
    whole = F.concat_ws(", ", F.concat(F.lit(" "), "s_name"), F.concat(F.col("s_suppkey").cast("string"), F.lit(" ")), F.concat(F.col("s_nationkey").cast("string"), F.lit(" MiB")))
    return listing.gpu_rows(s.select(F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(", x"))).otherwise(whole).alias("line")))


@query("toolkit_release", "SELECT (p_size % 13) || '.' || (p_partkey % 7) AS version FROM part WHERE p_size % 5 = 0 ORDER BY p_partkey LIMIT 1")
def toolkit_release(spark: SparkSession, d: str) -> DataFrame:
    """Of lines that mention a release or not, the first that does."""
    p = read(spark, d, "part")
    version = F.concat_ws(".", (F.col("p_size") % 13).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    line = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("tools release notes, release "), version, F.lit(", V"), version, F.lit(".131"))).otherwise(F.concat(F.lit("compiler "), version))
    return listing.toolkit_release(p.select(F.col("p_partkey").alias("n"), line.alias("line")))


@query("wheel_name", "SELECT p_partkey AS n, 'flash_attn-*+cu' || CASE WHEN p_size % 4 = 0 THEN 'xxx' ELSE (p_size % 13) || (p_partkey % 7)::VARCHAR END || 'torch2' || (p_size % 7) || '*-cp3' || (p_partkey % 14) || '-*-linux_x86_64.whl' AS wheel FROM part")
def wheel_name(spark: SparkSession, d: str) -> DataFrame:
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    size, key = F.col("p_size"), F.col("p_partkey")
    cuda = F.when(size % 4 != 0, text(size % 13, ".", key % 7))
    return read(spark, d, "part").select(F.col("p_partkey").alias("n"), listing.wheel_name(text("2.", size % 7, ".1+cu", key % 7), cuda, text("3.", key % 14, ".4")).alias("wheel"))


# --- checkpoints ---------------------------------------------------------------------------------------------------

FILES = ["ckpt/model_00042.pt", "ckpt/model_24999.pt", "ckpt/model_123456.pt", "ckpt/optim_99999999.pt", "ckpt/model_best.pt"]


@query("checkpoint_latest", "SELECT max(TRY_CAST(split_part(regexp_extract(p, 'model_[^/]*$'), '_', 2).replace('.pt', '') AS INTEGER)) AS step FROM (VALUES " + ", ".join(f"('{f}')" for f in FILES) + ") v(p) WHERE p LIKE '%model\\_%' ESCAPE '\\'")
def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.latest_step(spark.createDataFrame([(f,) for f in FILES], "path string"))


@query("checkpoint_names", "SELECT k || '_' || lpad(s::VARCHAR, greatest(5, length(s::VARCHAR))::INTEGER, '0') || '.pt' AS name, s AS step FROM (VALUES ('model'), ('optim'), ('scheduler')) a(k), (VALUES (7), (24999), (123456)) b(s)")
def checkpoint_names(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k, s) for k in checkpoints.KINDS for s in (7, 24999, 123456)], "kind string, step int")
    return rows.select(checkpoints.file_name(F.col("kind"), F.col("step")).alias("name"), "step")


def live_tensors(c: ModelConfig = LIVE) -> list[tuple[str, list[int], bool]]:
    """Names and shapes of the weights of a model of this configuration."""
    q, kv = c.heads * c.head_dim, c.kv_heads * c.head_dim
    out = [("embed", [c.vocab, c.hidden], True), ("norm", [c.hidden], True), ("unembed.w", [c.vocab, c.hidden], True), ("unembed.b", [c.vocab], True)]
    for i in range(c.layers):
        for name, shape in (("q", [c.hidden, q]), ("k", [c.hidden, kv]), ("v", [c.hidden, kv]), ("o", [q, c.hidden])):
            out += [(f"{i}.{name}.w", shape, True), (f"{i}.{name}.b", [shape[1]], True)]
        out += [(f"{i}.q_norm", [c.head_dim], True), (f"{i}.k_norm", [c.head_dim], True)]
        out += [(f"{i}.norm1", [c.hidden], True), (f"{i}.norm2", [c.hidden], True), (f"{i}.gate.w", [c.experts, c.hidden], True), (f"{i}.gate.b", [c.experts], True)]
        for block in (*(f"expert{e}" for e in range(c.experts)), "shared"):
            for name, shape in (("w1", [c.hidden, 2 * c.intermediate]), ("w2", [c.intermediate, c.hidden]), ("w3", [c.hidden, 2 * c.intermediate])):
                out += [(f"{i}.{block}.{name}.w", shape, True), (f"{i}.{block}.{name}.b", [shape[1]], True)]
    return out


@query("param_count", "SELECT sum(n)::BIGINT AS total, sum(n)::BIGINT AS trainable FROM (VALUES " + ", ".join(f"({'*'.join(map(str, s))})" for _, s, _ in live_tensors()) + ") v(n)")
def param_count(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.parameter_counts(spark.createDataFrame(live_tensors(), "name string, shape array<long>, trainable boolean"))


# --- routing -------------------------------------------------------------------------------------------------------

GATE = f"""
x AS (SELECT vec_id AS token_id, embedding::DOUBLE[] AS e FROM embeddings),
ex AS (SELECT vec_id AS expert, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < {EXPERTS}),
z AS (SELECT token_id, expert::INTEGER AS expert, list_dot_product(e, w) AS z FROM x, ex),
m AS (SELECT *, exp(z - max(z) OVER (PARTITION BY token_id)) AS u FROM z),
g AS (SELECT token_id, expert, u / sum(u) OVER (PARTITION BY token_id) AS p FROM m),
k AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY token_id ORDER BY p DESC, expert) - 1)::INTEGER AS slot FROM g) WHERE slot < {TOP}),
n AS (SELECT e.expert, count(k.expert) AS n FROM (SELECT range::INTEGER AS expert FROM range({EXPERTS})) e LEFT JOIN k USING (expert) GROUP BY 1),
used AS (SELECT expert, n, 100.0 * n / sum(n) OVER () AS percent FROM n)
"""


def _gated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vec = read(spark, d, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").cast("array<double>").alias("x"))
    experts = vec.filter(F.col("token_id") < EXPERTS).select(F.col("token_id").cast("int").alias("expert"), F.col("x").alias("w"))
    return vec, experts, routing.gate(vec, experts)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return routing.bincount(spark, routing.top_k(_gated(spark, d)[2], TOP), EXPERTS)


@query("gate_softmax", f"WITH {GATE} SELECT token_id, expert, round(p, 6) AS p FROM g")
def gate_softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = _gated(spark, d)[2].select("token_id", F.posexplode("scores").alias("expert", "p"))
    return rows.select("token_id", "expert", F.round("p", 6).alias("p"))


@query("gate_topk", f"WITH {GATE} SELECT token_id, expert, slot, round(p, 6) AS weight FROM k")
def gate_topk(spark: SparkSession, d: str) -> DataFrame:
    return routing.top_k(_gated(spark, d)[2], TOP).withColumn("weight", F.round("weight", 6))


@query("expert_bincount", f"WITH {GATE} SELECT expert, n FROM n")
def expert_bincount(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


@query("expert_utilization", f"WITH {GATE} SELECT expert, n, round(percent, 6) AS percent FROM used")
def expert_utilization(spark: SparkSession, d: str) -> DataFrame:
    return routing.utilization(_counts(spark, d)).withColumn("percent", F.round("percent", 6))


@query("load_balance", f"WITH {GATE} SELECT round(avg(percent), 6) AS mean, round(max(percent), 6) AS most, round(min(percent), 6) AS least, round(stddev_pop(percent), 6) AS deviation, round(CASE WHEN max(percent) > 0 THEN 100 * min(percent) / max(percent) ELSE 0 END, 6) AS balance FROM used")
def load_balance(spark: SparkSession, d: str) -> DataFrame:
    b = routing.balance(routing.utilization(_counts(spark, d)))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query("expert_cv", f"WITH {GATE} SELECT round(avg(n), 6) AS mean, round(CASE WHEN avg(n) > 0 THEN 100 * stddev_pop(n) / avg(n) ELSE 0 END, 6) AS cv FROM n")
def expert_cv(spark: SparkSession, d: str) -> DataFrame:
    return routing.variation(_counts(spark, d)).select(F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"))


@query("usage_chart", f"WITH {GATE} SELECT expert, n, round(percent, 6) AS percent, repeat('█', floor(percent * 50 / 100)::INTEGER) AS bar FROM used")
def usage_chart(spark: SparkSession, d: str) -> DataFrame:
    return routing.usage_chart(routing.utilization(_counts(spark, d))).withColumn("percent", F.round("percent", 6))


@query("moe_combine", f"WITH {GATE}, o AS (SELECT k.token_id, unnest(range(1, len(e) + 1)) AS i, e, w, p FROM k JOIN x USING (token_id) JOIN ex USING (expert)) SELECT token_id, (i - 1)::INTEGER AS dim, round(sum(e[i] * w[i] * p), 6) + 0.0 AS value FROM o GROUP BY 1, 2")
def moe_combine(spark: SparkSession, d: str) -> DataFrame:
    vec, experts, gated = _gated(spark, d)
    return routing.combine(vec, routing.top_k(gated, TOP), experts).withColumn("value", F.round("value", 6) + 0.0)


@query("embedding_lookup", "SELECT doc_id, e.vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm2 FROM documents d JOIN embeddings e ON e.vec_id = d.n_chars % (SELECT max(vec_id) + 1 FROM embeddings)")
def embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    width = table.agg(F.max("vec_id") + 1).first()[0]
    ids = read(spark, d, "documents").select("doc_id", (F.col("n_chars") % width).alias("vec_id"))
    return ids.join(table, "vec_id").select("doc_id", "vec_id", F.round(tensor.dot(F.col("v"), F.col("v")), 5).alias("norm2"))


# --- tensor formulas -----------------------------------------------------------------------------------------------

LANES = "x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), i AS (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM x)"


def _lanes(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select("vec_id", F.posexplode("y").alias("dim", "v")).select("vec_id", "dim", (F.round("v", digits) + 0.0).alias("value"))


def _vec(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query("rms_norm", f"WITH {LANES} SELECT vec_id, (i - 1)::INTEGER AS dim, round(e[i] / sqrt(list_dot_product(e, e) / len(e) + 1e-5), 6) + 0.0 AS value FROM i")
def rms_norm(spark: SparkSession, d: str) -> DataFrame:
    return _lanes(_vec(spark, d).withColumn("y", tensor.rms_norm(F.col("x"))))


@query("swiglu", f"WITH {LANES}, g AS (SELECT vec_id, (i - 1) // 2 AS dim, least(e[i], 7) AS g, least(greatest(e[i + 1], -7), 7) AS l FROM i WHERE i % 2 = 1) SELECT vec_id, dim::INTEGER AS dim, round(g / (1 + exp(-1.702 * g)) * (l + 1), 6) + 0.0 AS value FROM g")
def swiglu(spark: SparkSession, d: str) -> DataFrame:
    return _lanes(_vec(spark, d).withColumn("y", tensor.swiglu(F.col("x"))))


@query("yarn_freqs", """WITH s AS (SELECT unnest([1.0, 2.0, 4.0]) AS scale), i AS (SELECT scale, unnest(range(16)) AS i FROM s),
p AS (SELECT *, pow(10000, i / 16.0) AS period, 16 * ln(2048 / (32 * 2 * pi())) / ln(10000) AS low, 16 * ln(2048 / (2 * pi())) / ln(10000) AS high FROM i),
m AS (SELECT *, 1 - least(greatest((i - low) / (high - low), 0), 1) AS share FROM p)
SELECT scale::DOUBLE AS scale, i::INTEGER AS lane, round(CASE WHEN scale <= 1 THEN 1 / period ELSE (1 - share) / (scale * period) + share / period END, 9) AS frequency,
  round(CASE WHEN scale <= 1 THEN 1.0 ELSE 0.1 * ln(scale) + 1 END, 9)::DOUBLE AS concentration FROM m""")
def yarn_freqs(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for s in (1.0, 2.0, 4.0):
        c, f = tensor.yarn_frequencies(32, scale=s)
        rows += [(s, i, v, c) for i, v in enumerate(f)]
    df = spark.createDataFrame(rows, "scale double, lane int, frequency double, concentration double")
    return df.select("scale", "lane", F.round("frequency", 9).alias("frequency"), F.round("concentration", 9).alias("concentration"))


@query("rope_table", "SELECT pos::INTEGER AS pos, lane::INTEGER AS lane, round(cos(pos / pow(10000, lane / 16.0)), 6) + 0.0 AS cosine, round(sin(pos / pow(10000, lane / 16.0)), 6) + 0.0 AS sine FROM (SELECT range AS pos FROM range(2048)), (SELECT range AS lane FROM range(16))")
def rope_table(spark: SparkSession, d: str) -> DataFrame:
    _, f = tensor.yarn_frequencies(LIVE.head_dim)
    lanes = F.array(*[F.lit(v) for v in f])
    rows = spark.range(LIVE.initial_context).select(F.col("id").cast("int").alias("pos"), F.posexplode(lanes).alias("lane", "f"))
    angle = F.col("pos") * F.col("f")
    return rows.select("pos", "lane", (F.round(F.cos(angle), 6) + 0.0).alias("cosine"), (F.round(F.sin(angle), 6) + 0.0).alias("sine"))


@query("rope_apply", f"""WITH {LANES}, a AS (SELECT vec_id, e, i, CASE WHEN i <= 32 THEN i ELSE i - 32 END AS l FROM i WHERE i <= 64), b AS (SELECT *, (vec_id % {SEQ}) / pow(10000, (l - 1) / 32.0) AS t FROM a)
SELECT vec_id, (i - 1)::INTEGER AS dim, round(CASE WHEN i <= 32 THEN e[l] * cos(t) - e[l + 32] * sin(t) ELSE e[l + 32] * cos(t) + e[l] * sin(t) END, 6) + 0.0 AS value FROM b""")
def rope_apply(spark: SparkSession, d: str) -> DataFrame:
    _, f = tensor.yarn_frequencies(64)
    return _lanes(_vec(spark, d).withColumn("y", tensor.rope(F.col("x"), F.col("vec_id") % SEQ, f)))


@query("gqa_expand", f"SELECT vec_id, h::INTEGER AS head, (h // {HEADS // KV})::INTEGER AS kv_head FROM embeddings, (SELECT range AS h FROM range({HEADS}))")
def gqa_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = _vec(spark, d).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(HEADS - 1))).alias("head"))
    return rows.withColumn("kv_head", F.floor(F.col("head") / (HEADS // KV)).cast("int"))


def _attend(spark: SparkSession, d: str, sink: float | None) -> DataFrame:
    """Lanes 0-31 are the queries of four heads, 32-47 the keys and 48-63 the values of two."""
    vec = _vec(spark, d).select(F.floor(F.col("vec_id") / SEQ).alias("b"), (F.col("vec_id") % SEQ).cast("int").alias("pos"), "x")
    part = lambda at, h: F.slice("x", at + 1 + h * HEAD_DIM, F.lit(HEAD_DIM))
    q = vec.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(HEADS - 1)))).select("b", "head", "pos", part(0, F.col("head")).alias("q"))
    kv = vec.withColumn("kv_head", F.explode(F.sequence(F.lit(0), F.lit(KV - 1)))).select("b", "kv_head", "pos", part(32, F.col("kv_head")).alias("k"), part(48, F.col("kv_head")).alias("v"))
    return routing.attention(q, kv, HEADS // KV, sink).withColumn("value", F.round("value", 6) + 0.0)


def _attention_sql(sink: str) -> str:
    return f"""WITH x AS (SELECT vec_id // {SEQ} AS b, (vec_id % {SEQ})::INTEGER AS pos, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT b, pos, h::INTEGER AS head, e[h * 8 + 1 : h * 8 + 8] AS q FROM x, (SELECT range AS h FROM range({HEADS}))),
kv AS (SELECT b, pos AS kp, g, e[33 + g * 8 : 40 + g * 8] AS k, e[49 + g * 8 : 56 + g * 8] AS v FROM x, (SELECT range AS g FROM range({KV}))),
z AS (SELECT q.b, head, pos, v, exp(list_dot_product(q, k) / sqrt(8.0)) AS u FROM q JOIN kv ON q.b = kv.b AND head // {HEADS // KV} = g AND kp <= pos),
p AS (SELECT *, u / (sum(u) OVER (PARTITION BY b, head, pos) + {sink}) AS p FROM z),
l AS (SELECT b, head, pos, p, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS dim FROM p)
SELECT b, head, pos, dim::INTEGER AS dim, round(sum(p * v), 6) + 0.0 AS value FROM l GROUP BY 1, 2, 3, 4"""


@query("causal_attention", _attention_sql("0"))
def causal_attention(spark: SparkSession, d: str) -> DataFrame:
    return _attend(spark, d, None)


@query("attention_sink", _attention_sql("exp(0.5)"))
def attention_sink(spark: SparkSession, d: str) -> DataFrame:
    return _attend(spark, d, 0.5)


# --- evaluation ----------------------------------------------------------------------------------------------------

NLL = f"{TOKENS}, s AS (SELECT chunk_id, target FROM pairs WHERE target <> '{EOS}'), n AS (SELECT target, count(*) AS n FROM s GROUP BY 1), a AS (SELECT sum(n) AS al, count(*) AS kinds FROM n), l AS (SELECT s.chunk_id, -ln((n + 1) / (al + kinds)) AS nll FROM s JOIN n USING (target), a)"


@query("unigram_eval_loss", f"WITH {NLL} SELECT round(avg(nll), 6) AS loss, count(*) AS n FROM l")
def unigram_eval_loss(spark: SparkSession, d: str) -> DataFrame:
    rated = evaluation.unigram_nll(stash(evaluation.target_counts(chunks_of(spark, d), EOS)))
    return evaluation.mean_nll(rated).select(F.round("loss", 6).alias("loss"), "n")


@query("perplexity", f"WITH {NLL} SELECT round(exp(least(avg(nll), 10)), 3) AS perplexity FROM l")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    rated = evaluation.unigram_nll(stash(evaluation.target_counts(chunks_of(spark, d), EOS)))
    return evaluation.mean_nll(rated).select(F.round(evaluation.perplexity(F.col("loss")), 3).alias("perplexity"))


@query("batch_mean_loss", f"WITH {NLL}, b AS (SELECT chunk_id // {C.batch} AS batch_id, avg(nll) AS m FROM l GROUP BY 1 ORDER BY 1 LIMIT 5000) SELECT round(avg(m), 6) AS loss, count(*) AS batches FROM b")
def batch_mean_loss(spark: SparkSession, d: str) -> DataFrame:
    counts = stash(evaluation.target_counts(chunks_of(spark, d), EOS, F.floor(F.col("chunk_id") / C.batch)))
    rated = evaluation.unigram_nll(counts.groupBy("target").agg(F.sum("n").alias("n"))).select("target", "nll")
    return evaluation.mean_of_batches(counts.join(rated, "target").withColumnRenamed("by", "batch_id")).withColumn("loss", F.round("loss", 6))


@query("rank_mean_loss", "SELECT round(sum(o_totalprice) / (max(n) * 4), 4) AS loss FROM (SELECT o_orderkey % 4 AS r, sum(o_totalprice) AS o_totalprice, count(*) AS n FROM orders GROUP BY 1)")
def rank_mean_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("rank"), F.col("o_totalprice").alias("loss"))
    return evaluation.mean_over_ranks(rows).withColumn("loss", F.round("loss", 4))


@query("grad_clip", "SELECT round(sqrt(sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS norm, round(least(1, 1 / (sqrt(sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) + 1e-6)), 6) AS factor FROM embeddings")
def grad_clip(spark: SparkSession, d: str) -> DataFrame:
    c = evaluation.clip(_vec(spark, d).withColumnRenamed("x", "g"))
    return c.select(F.round("norm", 5).alias("norm"), F.round("factor", 6).alias("factor"))


@query("grad_accumulation", "SELECT event_id // 16 AS update, round(sum(value) / 16, 7) AS loss FROM events GROUP BY 1")
def grad_accumulation(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return evaluation.accumulate(rows).withColumn("loss", F.round("loss", 7))


@query("step_cadence", "SELECT event_id AS step FROM events WHERE (event_id + 1) % 16 = 0")
def step_cadence(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").filter(evaluation.at_cadence(F.col("event_id"), 16)).select(F.col("event_id").alias("step"))


@query("lr_schedule", "SELECT event_id AS step, round(3e-4 * CASE WHEN s < 2000 THEN s / 2000.0 ELSE greatest(0.0, 0.5 * (1 + cos(pi() * least((s - 2000) / 98000.0, 1)))) END, 12) AS rate FROM (SELECT event_id, event_id * 10 AS s FROM events)")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("step"), F.round(tensor.cosine_schedule(F.col("event_id") * 10), 12).alias("rate"))


@query("early_stopping", """WITH b AS (SELECT user_id AS run, event_id AS eval, value AS loss, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR loss < before THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY eval) AS island FROM b)
SELECT run, eval, loss, least(loss, before) AS best, (row_number() OVER (PARTITION BY run, island ORDER BY eval) - 1)::INTEGER AS waited, row_number() OVER (PARTITION BY run, island ORDER BY eval) - 1 >= 8 AS stop FROM r""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as the validation losses of a run."""
    return evaluation.patience(read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("eval"), F.col("value").alias("loss")))


@query("throughput", f"WITH {TOKENS} SELECT count(*) AS chunks, round(count(*) * {C.context} / (SELECT sum(value) FROM events), 6) AS tokens_per_s FROM whole")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    n = chunks_of(spark, d).agg(F.count(F.lit(1)).alias("chunks"))
    seconds = read(spark, d, "events").agg(F.sum("value").alias("seconds"))
    return n.crossJoin(F.broadcast(seconds)).select("chunks", F.round(evaluation.throughput(F.col("chunks"), F.lit(C.context), F.col("seconds")), 6).alias("tokens_per_s"))


@query("topk_sampling", """WITH r AS (SELECT user_id AS step, event_id AS token, value AS logit, (user_id % 97) / 97.0 AS u, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events QUALIFY r <= 50),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY step)) AS e FROM r), p AS (SELECT *, e / sum(e) OVER (PARTITION BY step) AS p FROM e),
c AS (SELECT *, sum(p) OVER (PARTITION BY step ORDER BY r) AS c, max(r) OVER (PARTITION BY step) AS lastr FROM p),
f AS (SELECT *, min(CASE WHEN c > u OR r = lastr THEN r END) OVER (PARTITION BY step) AS first FROM c)
SELECT step, token, round(p, 6) AS p, r = first AS chosen FROM f""")
def topk_sampling(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("user_id").alias("step"), F.col("event_id").alias("token"), F.col("value").alias("logit"), (F.col("user_id") % 97 / 97.0).alias("u"))
    return evaluation.sample_top_k(rows, 50).withColumn("p", F.round("p", 6))


@query("generate_until_eos", "SELECT seq, pos, token FROM (SELECT *, min(CASE WHEN token = 'assistant' THEN pos END) OVER (PARTITION BY seq) AS s FROM (SELECT conv_id AS seq, turn AS pos, role AS token FROM conversations)) WHERE s IS NULL OR pos <= s")
def generate_until_eos(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.col("role").alias("token"))
    return evaluation.until_eos(rows, "assistant")
