import json
import math

import pytest
from pyspark.sql import functions as F

from packloom import catalog
from packloom.config import ModelConfig, PackConfig
from packloom.functions import tensor
from packloom.operators import evaluation, packing, routing
from packloom.sources import checkpoints, listing
from packloom.plans import stash
from packloom.streaming import packer


def sequential(texts, width, eos="<eos>"):
    """The carry-buffer loop."""
    buffer, out = [], []
    for t in texts:
        buffer += ([] if t is None else t.split(" ")) + [eos]
        while len(buffer) >= width:
            out.append(buffer[:width])
            buffer = buffer[width:]
    return out, len(buffer)


@pytest.mark.parametrize("context", [6, 63, 2048])
def test_packing_equals_the_sequential_loop(spark, sf_dir, context):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    want, tail = sequential(texts, context + 1)
    got = [list(r.tokens) for r in packing.pack_documents(docs, PackConfig(context)).orderBy("chunk_id").collect()]
    assert got == want
    assert len(want) * (context + 1) + tail == sum(len(t.split(" ")) + 1 for t in texts)


@pytest.mark.parametrize("texts", [["a b c d e"], ["a b c d e f"], ["", None, "x"], [], ["a " * 50]])
def test_packing_edges(spark, texts):
    docs = spark.createDataFrame([(i * 10_000, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [list(r.tokens) for r in packing.pack_documents(docs, PackConfig(5)).orderBy("chunk_id").collect()]
    assert got == sequential(texts, 6)[0]


def test_streamed_packing_equals_batch(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    (tmp_path / "in").mkdir()
    for k in range(4):
        part = rows[k * 50 : (k + 1) * 50]
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(r.asDict()) for r in part))
        import os

        os.utime(tmp_path / f"in/{k}.json", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = packer.pack_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), PackConfig(63))
    q.awaitTermination()
    got = [list(r.tokens) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("chunk_id").collect()]
    assert got == sequential([r.text for r in rows], 64)[0]


def test_streamed_counts(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("expert")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("expert long").parquet(str(tmp_path / "in"))
    packer.count_stream(stream, "expert_counts", str(tmp_path / "cp")).awaitTermination()
    assert {r.expert: r.n for r in spark.table("expert_counts").collect()} == {0: 34, 1: 33, 2: 33}


def test_round_robin_is_a_partition(spark):
    files = spark.createDataFrame([(f"en/{i:03}.json",) for i in range(10)], "path string")
    ranks = [[r.path for r in packing.rank_files(files, k, 3).orderBy("path").collect()] for k in range(3)]
    assert sum(ranks, []) and sorted(sum(ranks, [])) == [f"en/{i:03}.json" for i in range(10)]
    assert ranks[1] == ["en/001.json", "en/004.json", "en/007.json"]
    with pytest.raises(ValueError):
        packing.rank_files(files, 11, 12)


def test_listing(spark, tmp_path):
    for f in ("en/b.json", "en/a.json", "en.noclean/c.json", "multilingual/en/x.json", "readme"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text('{"text": "t"}\n')
    found = listing.train_files(spark, str(tmp_path), prefix="https://h/")
    assert [r.url for r in found.collect()] == ["https://h/en/a.json", "https://h/en/b.json"]
    assert listing.train_files(spark, str(tmp_path), variants=True).count() == 3
    with pytest.raises(ValueError, match="en.noclean.*multilingual.*readme"):
        listing.train_files(spark, str(tmp_path), lang="xx")
    assert listing.read_corpus(spark, str(tmp_path / "en")).count() == 2


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_golden_values(spark):
    pair = lambda a, b: column(spark, tensor.swiglu(F.array(F.lit(a), F.lit(b))))[0]
    assert pair(0.0, 0.0) == 0 and pair(1.0, 1.0) == pytest.approx(1.6915915) and pair(10.0, -10.0) == pytest.approx(-41.9997188) and pair(-1.0, 0.5) == pytest.approx(-0.2313064)
    rate = lambda s: column(spark, tensor.cosine_schedule(F.lit(s)))
    assert [rate(s) for s in (1000, 2000, 51_000, 100_000)] == pytest.approx([1.5e-4, 3e-4, 1.5e-4, 0])
    assert tensor.yarn_frequencies(32, scale=2.0)[0] == pytest.approx(1.0693147)
    assert column(spark, evaluation.perplexity(F.lit(99.0))) == pytest.approx(math.exp(10))
    with pytest.raises(ValueError):
        ModelConfig(heads=3, kv_heads=2)


def test_attention_with_a_sink(spark):
    q = spark.createDataFrame([(0, h, p, [0.1 * h + p, 1.0]) for h in range(2) for p in range(3)], "b long, head int, pos int, q array<double>")
    kv = spark.createDataFrame([(0, 0, p, [1.0, 0.5 * p], [float(p), 1.0]) for p in range(3)], "b long, kv_head int, pos int, k array<double>, v array<double>")
    got = {(r.head, r.pos, r.dim): r.value for r in routing.attention(q, kv, 2, sink=0.3).collect()}
    for h in range(2):
        for p in range(3):
            z = [((0.1 * h + p) + 0.5 * k) / math.sqrt(2) for k in range(p + 1)]
            total = sum(map(math.exp, z)) + math.exp(0.3)
            assert got[h, p, 0] == pytest.approx(sum(math.exp(x) * k for k, x in enumerate(z)) / total)


def test_routing_edges(spark):
    none = routing.bincount(spark, spark.createDataFrame([], "expert int"), 3)
    assert [r.n for r in none.collect()] == [0, 0, 0] and routing.utilization(none).count() == 0
    assert routing.variation(none).first().cv == 0
    gated = spark.createDataFrame([(1, [0.4, 0.4, 0.2])], "token_id int, scores array<double>")
    assert [r.expert for r in routing.top_k(gated, 2).orderBy("slot").collect()] == [0, 1]
    assert [r.expert for r in routing.top_k(gated, 1, bias=[0, 0, 1]).collect()] == [2]


def test_join_lookup_with_a_hot_key(spark, monkeypatch):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1)], "k int, x long"))
    lookup = stash.stash(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least")))
    want = sorted(map(tuple, rows.join(lookup, "k").collect()))
    for floor in (10_000, 100, 0):
        monkeypatch.setattr(stash, "HOT_ROWS", floor)
        assert sorted(map(tuple, stash.join_lookup(rows, lookup, "k", "n", 1001).collect())) == want
    plan = stash.join_lookup(rows, lookup, "k", "n", 1001)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def test_checkpoints(spark, tmp_path):
    state = spark.createDataFrame([("w", [1.0])], "name string, v array<double>")
    checkpoints.save_state(state, str(tmp_path), 7)
    assert checkpoints.load_state(spark, str(tmp_path), 7).count() == 1
    assert checkpoints.latest_step(spark.createDataFrame([], "path string")).first().step is None
    metrics = spark.createDataFrame([("r", 1, "loss", 2.0)], "run string, step long, key string, value double")
    for _ in range(2):
        checkpoints.append_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_artifact_manifest_equals_its_sql_beyond_six_digits(spark, tmp_path):
    import duckdb

    steps = [-1, 249, 250, 100_249, 999_999, 1_000_249, 1_002_499, 999_999_999_999]
    spark.createDataFrame([(s,) for s in steps], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, catalog.queries()["artifact_manifest"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(db.execute(catalog.oracle_sql()["artifact_manifest"]).fetchall()) and len(got) == 7
    # the manifest itself cuts no name
    checkpoints.publish(spark.createDataFrame([(s, "p") for s in steps], "step long, path string"), str(tmp_path / "manifest"))
    names = {r.step: r.name for r in spark.read.parquet(str(tmp_path / "manifest")).collect()}
    assert names == {s: f"checkpoint_{s:06d}" for s in steps} and len(set(names.values())) == len(steps)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 37
    assert set(e.oracle_sql()) <= set(e.queries())


def test_feed_forward_and_head_rotation(spark):
    x, w1, w3, w2 = [0.5, -1.0], [[1.0, 0.0], [0.0, 1.0]], [[2.0, 0.0], [0.0, -3.0]], [[4.0], [-1.0]]
    made = column(spark, tensor.feed_forward(F.array(*map(F.lit, x)), w1, w3, w2))
    gate, line = 0.5 * 1.0, -1.0 * 3.0
    one = gate / (1 + math.exp(-1.702 * gate)) * (line + 1)
    assert made == pytest.approx([4 * one, -one])
    turned = column(spark, tensor.norm_and_rotate(F.array(*map(F.lit, [3.0, 4.0, 1.0, 0.0])), 2, F.lit(1), [math.pi / 2]))
    rms = [math.sqrt(12.5 + 1e-5), math.sqrt(0.5 + 1e-5)]
    assert turned == pytest.approx([-4 / rms[0], 3 / rms[0], 0, 1 / rms[1]], abs=1e-12)


def test_streams_read_files_and_folders(spark, sf_dir, tmp_path):
    from packloom.plans import model_queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(map(tuple, model_queries.stream_pack(spark, sf_dir).collect()))
    assert len(want) == 37 and sorted(map(tuple, model_queries.stream_pack(spark, str(tmp_path)).collect())) == want


def test_param_count_is_the_reference_total(spark, sf_dir):
    assert [tuple(r) for r in catalog.queries()["param_count"](spark, sf_dir).collect()] == [(44_160_652, 44_160_652)]  # SURVEY 2.9, A19


def test_packing_takes_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (None, "e f"), (2, "g h")], "doc_id long, text string").coalesce(1)
    got = [list(r.tokens) for r in packing.pack_documents(docs, PackConfig(2), keep_tail=True).orderBy("chunk_id").collect()]
    assert got == sequential(["e f", "a b", "c d", "g h"], 3)[0]


@pytest.mark.parametrize("few", [0, 100_000])
def test_ranked_sums_take_any_keys(spark, monkeypatch, few):
    monkeypatch.setattr(stash, "WINDOW_ROWS", few)
    rows = spark.range(3000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("n")).unionByName(spark.createDataFrame([(None, 4)], "k long, n long"))
    got = sorted(((r.k is not None, r.k or 0), r.n, r.s) for r in stash.ranked_sums(rows, ["k"], "n", "s").collect())
    before = 0
    for _, n, s in got:
        assert s == before
        before += n


def test_rank_and_worker_streams_keep_their_own_tails(spark):
    docs = [(f"f{i % 5}", i, f"a{i} b{i} c{i}") for i in range(40)]
    rows = spark.createDataFrame(docs, "path string, doc_id long, text string").withColumn("tokens", F.split("text", " ")).drop("text")
    got = {}
    for r in packing.rank_packed(rows, 2, 3, 4).collect():
        got.setdefault((r["rank"], r.worker), []).append((r.chunk_id, list(r.tokens)))
    for rank in range(2):
        mine = sorted(d for d in docs if int(d[0][1:]) % 2 == rank)
        for worker in range(3):
            flat = [t for d in mine[worker::3] for t in d[2].split(" ")]
            assert sorted(got[rank, worker]) == [(k, flat[4 * k : 4 * k + 4]) for k in range(len(flat) // 4)]


def test_shuffle_is_a_reproducible_permutation(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    one, again, other = ([(r.doc_id, r.position) for r in packing.shuffled(rows, s).orderBy("doc_id").collect()] for s in (1, 1, 2))
    assert one == again != other and sorted(p for _, p in one) == list(range(500))


def test_arrow_tokenizer(spark):
    rows = spark.createDataFrame([(1, "ab c"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: list(r.tokens) for r in packing.tokenize_arrow(rows, lambda: lambda texts: [[ord(c) for c in t] for t in texts]).collect()}
    assert got == {1: [97, 98, 32, 99], 2: [], 3: []}
    ids = packing.append_eos(packing.tokenize_arrow(rows, lambda: lambda texts: [[ord(c) for c in t] for t in texts]), 0)
    assert [list(r.tokens) for r in packing.pack(ids, 3).orderBy("chunk_id").collect()] == [[97, 98, 32], [99, 0, 0]]


def test_stream_resumes_after_a_restart_and_a_replay(spark, sf_dir, tmp_path):
    import os
    import shutil

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    (tmp_path / "in").mkdir()

    def add(k):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(r.asDict()) for r in rows[k * 50 : (k + 1) * 50]))
        os.utime(tmp_path / f"in/{k}.json", (1_000_000 + k, 1_000_000 + k))

    def run():
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        packer.pack_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), PackConfig(63)).awaitTermination()
        return [list(r.tokens) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("chunk_id").collect()]

    add(0), add(1)
    run()
    add(2)
    want = sequential([r.text for r in rows[:150]], 64)[0]
    assert run() == want
    os.remove(tmp_path / "cp/commits/2")  # as if the driver was lost before the last commit: the batch is replayed
    shutil.rmtree(tmp_path / "out/batch=2")
    for crc in (tmp_path / "cp/commits").glob(".2.crc"):
        crc.unlink()
    assert run() == want
    assert len(list((tmp_path / "state").iterdir())) <= 2
    add(3)
    assert run() == sequential([r.text for r in rows], 64)[0]


def test_a_gate_refuses_a_table_of_experts_without_bound(spark, monkeypatch):
    monkeypatch.setattr(routing, "MAX_EXPERTS", 2)
    tokens = spark.createDataFrame([(1, [1.0])], "token_id int, x array<double>")
    experts = spark.createDataFrame([(k, [1.0]) for k in range(3)], "expert int, w array<double>")
    with pytest.raises(ValueError):
        routing.gate(tokens, experts)
    assert routing.gate(tokens, experts.limit(2)).count() == 1


def test_stash_folders_are_deleted(spark):
    import os

    with stash.scratch(spark) as block:
        stash.stash(spark.range(3))
        kept = stash.stash(spark.range(4), outer=True)
        taken = stash.stash(spark.range(5))
        inside = list(block.paths)
        path = block.take()
    assert not os.path.exists(inside[0]) and kept.count() == 4 and taken.count() == 5
    stash.discard(spark, path)
    assert not os.path.exists(path)


def test_cached_generation_equals_whole_passes(spark, sf_dir):
    """Generation over the cache gives what a full forward pass over the grown sequence gives at each step."""
    from packloom.operators import transformer
    from packloom.plans import forward_queries as fq

    tokens = fq._tokens(spark, sf_dir).filter("b < 6").cache()
    made = sorted(map(tuple, transformer.generate(tokens, fq.MODEL, 2, -1).collect()))
    seqs = {}
    for b, pos, t in sorted(map(tuple, tokens.select("b", "pos", "token").collect())):
        seqs.setdefault(b, []).append(t)
    want = []
    for _ in range(2):
        rows = spark.createDataFrame([(b, p, t) for b, s in seqs.items() for p, t in enumerate(s)], "b long, pos int, token int")
        logits, _ = transformer.forward(rows, fq.MODEL)
        last = {r.b: r for r in evaluation.last_position(logits, "b", "pos").collect()}
        for b, r in last.items():
            token = max(range(fq.VOCAB), key=lambda k: (r.logits[k], -k))
            want.append((b, len(seqs[b]), token))
            seqs[b].append(token)
    tokens.unpersist()
    assert made == sorted(want)


def test_settings():
    from packloom import config

    assert config.environment({}) == (-1, 0) and config.environment({"RANK": "2", "LOCAL_RANK": "1"}) == (1, 2)
    assert config.parse_args(["--batch_size", "4", "--other"]).batch_size == 4
    assert tensor.init_deviation("0.gate.w", 2) == 0.01 and tensor.init_deviation("1.o.w", 2) == 0.01 and tensor.init_deviation("q.b", 2) == 0


def test_dropout_keeps_the_mean_and_is_off_outside_training(spark):
    rows = spark.range(400).select("id", F.array_repeat(F.lit(1.0), 50).alias("x"))
    total = lambda t, r: rows.select(F.aggregate(tensor.dropout(F.col("x"), r, F.col("id"), t), F.lit(0.0), lambda a, v: a + v).alias("s")).agg({"s": "avg"}).first()[0]
    assert total(False, 0.5) == total(True, 0.0) == 50 and abs(total(True, 0.5) - 50) < 2
