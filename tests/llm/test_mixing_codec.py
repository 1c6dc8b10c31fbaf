import math
import struct

import pytest

from packloom.llm import mixing, piece_codec
from packloom.llm.catalog import PIECE_MODEL, op1_source_mixing, op3_piece_codec


def brute_exponent(totals, repetition):
    ratio = max(totals) / min(totals)
    return max(0.0, 1 - math.log(repetition) / math.log(ratio)) if ratio > 1 else 0.0


def test_mix_keeps_every_row_and_meets_the_limit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    docs["n"] = docs.text.map(lambda t: len(t.encode().split()))
    totals = docs.groupby("source").n.sum()
    got = op1_source_mixing(spark, sf_dir).toPandas()
    assert set(got[got.epoch == 0].doc_id) == set(docs.doc_id)
    a = brute_exponent(totals, 2.0)
    assert got.exponent.iloc[0] == pytest.approx(a, abs=1e-6)
    w = (totals / totals.sum()) ** a
    w /= w.sum()
    budget = (totals / w).max()
    for source, g in got.groupby("source"):
        quota = max(round(w[source] * budget), totals[source])
        assert g.weight.iloc[0] == pytest.approx(w[source], abs=1e-8)
        assert quota <= g.n_tokens.sum() < quota + docs.n.max() or g.n_tokens.sum() == totals[source]
        g = g.sort_values(["epoch", "token_offset"])
        for e, x in g.groupby("epoch"):  # offsets are a gapless running sum in each epoch
            x = x.sort_values(["token_offset", "n_tokens"])
            assert list(x.token_offset) == [e * totals[source] + s for s in [0, *x.n_tokens.cumsum()[:-1]]]
        assert (g.mix_block == (g.token_offset / (w[source] * mixing.BLOCK_TOKENS)).astype(int)).mean() > 0.999


def test_mix_to_an_entropy(spark, sf_dir):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 90 else "b" if i < 98 else "c") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.mix(docs, mixing.Target(entropy=0.9)).toPandas()
    w = got.groupby("source").weight.first()
    assert -(w * w.map(math.log)).sum() == pytest.approx(0.9 * math.log(3), abs=1e-6)
    taken = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    assert (taken - w).abs().max() < 0.02


@pytest.mark.parametrize("target", [mixing.Target(repetition=2.0), mixing.Target(repetition=1e9), mixing.Target(entropy=0.8), mixing.Target(entropy=0.8, budget=500), mixing.Target(entropy=0.01)])
def test_many_sources_are_planned_alike(spark, target):
    sources = spark.createDataFrame([(f"s{i}", 1, 3 + i * i * 7) for i in range(40)] + [("blank", 1, 0)], "src string, n_docs long, total long")
    one, two = (sorted(map(tuple, f(sources, target).collect())) for f in (mixing.plan, mixing.plan_wide))
    assert len(one) == len(two) == 40
    for a, b in zip(one, two):
        assert a[0] == b[0] and a[1:4] == pytest.approx(b[1:4], rel=1e-9) and abs(a[4] - b[4]) <= 1 and a[5] == pytest.approx(b[5])
    assert mixing.plan_wide(sources.limit(0), target).count() == 0


def test_shuffled_plans_and_repeated_rows(spark, monkeypatch):
    rows = [(i % 30, "one two three " * (1 + i % 30 % 4), "hot" if i % 30 < 20 else f"s{i % 30}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    target = mixing.Target(entropy=0.95)
    want = sorted(map(tuple, mixing.mix(docs, target).collect()))
    again = sorted(map(tuple, mixing.repeat(docs, target).collect()))
    for source in ("hot", "s25"):
        taken = sorted((r[5], r[2]) for r in want if r[1] == source and r[3] == 0)
        assert [x for x, _ in taken] == [sum(n for _, n in taken[:k]) for k in range(len(taken))]
    for name, value in (("MAX_SOURCES", 3), ("BROADCAST_ROWS", 3), ("UNFOLD", 4)):
        monkeypatch.setattr(mixing, name, value)
        assert sorted(map(tuple, mixing.mix(docs, target).collect())) == want
        assert sorted(map(tuple, mixing.repeat(docs, target).collect())) == again


def test_repeat_takes_any_column_name(spark):
    names = ["mix_key", "_mix_key", "MIX_SIZE", "mix_rule", "mix_copy", "_mix", "_copy"]
    docs = spark.createDataFrame([(1, "a b", "x", *range(7)), (2, "c d e f", "y", *range(7))], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.repeat(docs, mixing.Target(repetition=2.0))
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()}


def test_repeat_and_edges(spark):
    rows = [(i, "one two three " * (1 + i % 5), "hot", None) for i in range(200)] + [(i, "x y z", None, 5) for i in range(200, 230)]
    rows += [(None, None, "hot", 1), (7, "", "blank", 1), (300, "t " * 200_000, "long", 2), (300, "t " * 200_000, "long", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int")
    out = mixing.repeat(docs, mixing.Target(repetition=3.0))
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got.setdefault((r.doc_id, r.source), []).append(r)
    assert set(got) == {(r[0], r[2]) for r in rows}
    assert len(got[None, "hot"]) == 1 and len(got[7, "blank"]) == 1 and len(got[300, "long"]) == 2
    assert all(2 <= len(v) <= 3 for k, v in got.items() if k[1] is None)
    assert mixing.repeat(docs.limit(0), mixing.Target(repetition=3.0)).count() == 0
    assert mixing.mix(docs.limit(0), mixing.Target(repetition=3.0)).count() == 0


def test_codec_parity_with_sentencepiece(spark, sf_dir):
    raw = open(PIECE_MODEL, "rb").read()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    odd = ["", " ", "  a  b ", "<s></s><unk><0x41>", "日本語 🎉\u0000\t\n\n x", "▁a", "a" * 5000, " lead", "é́"]
    assert all(piece_codec.parity(raw, texts + odd))


def test_codec_query_equals_the_other_library(spark):
    import hashlib

    import sentencepiece

    d = "/root/testdata/sf0.01"
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = op3_piece_codec(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        want = theirs.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.round_trip) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), theirs.decode(want) == texts[r.doc_id])
    checked = [r.parity for r in got if r.parity is not None]
    assert all(checked) and 20 < len(checked) < 150


def test_segments_change_no_id(monkeypatch):
    import base64
    import random

    raw = open(PIECE_MODEL, "rb").read()
    made = piece_codec.Codec(piece_codec.parse(raw))
    rng = random.Random(3)
    long = ["word and Zahl été  " * 400, base64.b64encode(rng.randbytes(6000)).decode(), "日本語 🎉\u0000\t\n\n x" * 80, "▁a  b" * 90, "a" * 3000, " lead " * 60, "x" + "\n" * 500]
    long += ["".join(rng.choice("ab \né▁Zq日") for _ in range(3000)) for _ in range(5)]
    for most in (1, 7, 64):
        monkeypatch.setattr(piece_codec, "CUT", most)
        assert all("".join(made.segments(t)) == t for t in long) and sum(len(made.segments(t)) for t in long) > 200
        assert all(piece_codec.parity(raw, long))


def test_long_texts_take_bounded_memory():
    import subprocess
    import sys

    body = (
        "import resource, sys; from packloom.llm import piece_codec as c; m = c.Codec(c.parse(open(sys.argv[1], 'rb').read()));"
        "used = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024;"
        "text = ' '.join(f'word{i} of a long text' for i in range(180_000)); before = used(); ids, back = m.both([text]);"
        "assert back[0] == text and len(text) > 4_000_000; print(used() - before)"
    )
    grown = float(subprocess.run([sys.executable, "-c", body, PIECE_MODEL], capture_output=True, text=True, check=True).stdout)
    assert grown < 200


def test_codec_rows(spark, sf_dir):
    got = op3_piece_codec(spark, sf_dir)
    assert got.count() == 200 and got.filter("not round_trip").count() == 0
    rows = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "a b", 1), (2, "a b", 1), (3, "w " * 100_000, 1), (4, "▁x", 1)], "doc_id long, text string, ids int")
    got = piece_codec.codec(rows, open(PIECE_MODEL, "rb").read()).toPandas()
    assert list(got.n_tokens[:2]) == [0, 0] and list(got.decoded[:3]) == ["", "", "a b"] and list(got.round_trip) == [True] * 5 + [False]
    assert piece_codec.codec(rows.limit(0), open(PIECE_MODEL, "rb").read()).count() == 0
    short = piece_codec.codec(rows, open(PIECE_MODEL, "rb").read(), decoded=False)
    assert short.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and [list(r.ids) for r in short.collect()] == [list(x) for x in got.ids]


def test_unigram_model_is_rebuilt():
    def piece(text, score, kind=1):
        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    raw = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    raw += b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    raw += b"".join(piece(p, s) for p, s in [("▁", -2), ("a", -3), ("b", -3.5), ("▁a", -2.5), ("ab", -4), ("▁ab", -5.5), ("c", -6)])
    trainer = b"\x18\x01" + b"\x98\x02\x01"
    raw += b"\x12" + bytes([len(trainer)]) + trainer
    normal = b"\x0a\x08identity\x18\x01\x20\x00\x28\x01"
    raw += b"\x1a" + bytes([len(normal)]) + normal
    assert all(piece_codec.parity(raw, ["ab a b", "abab cab", "zé ab", "", "a  b"]))
