import zlib

import numpy as np
import pytest

from packloom.llm import language as lg
from packloom.llm import neighbours as nn
from packloom.llm.catalog import op6_nearest_neighbours, op7_language_id


def brute_nearest(rows, k=20, every=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def check(got, want, least=0.9):
    assert set(got.query_id) == {q for q, v in want.items() if v}
    found = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        scores = dict(want[q])
        assert list(g["rank"]) == list(range(1, len(want[q]) + 1))
        assert all(a > b or a == pytest.approx(b, abs=1e-12) for a, b in zip(g.score, g.score[1:]))
        for v, s in zip(g.vec_id, g.score):
            if v in scores:
                assert s == pytest.approx(scores[v], rel=1e-12)
                found += 1
    assert found >= least * sum(map(len, want.values()))
    return found / sum(map(len, want.values()))


def test_chi_square():
    assert nn.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3) and nn.chi_square_quantile(0.95, 24) == pytest.approx(36.415, abs=1e-3)


def test_dense_cells_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn, "CELL", 64)
    monkeypatch.setattr(nn, "QUERIES", 8)
    monkeypatch.setattr(nn, "SAMPLE", 40)  # far fewer cells than blocks
    x = np.random.default_rng(4).normal(size=(1500, 10))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sizes = []
    monkeypatch.setattr(nn.Index, "visit", lambda self, asks, f=nn.Index.visit: sizes.append(self.blocks.agg({"nb": "max"}).first()[0]) or f(self, asks))
    check(nn.nearest(df).toPandas(), brute_nearest(list(zip(range(1500), x))))
    assert max(sizes) > 1


def test_nearest_recall(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(op6_nearest_neighbours(spark, d).toPandas(), brute_nearest(rows))


def test_near_neighbours_spare_most_vectors(spark):
    """Where neighbours are much nearer than the rest, the test excludes most cells and vectors."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(60, 32)) * 4
    x = (centres[np.arange(6000) % 60] + r.normal(size=(6000, 32)) * 0.4)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked, found, n = nn.search_all(df, 20, 20, "vec_id", "embedding")
    share = found.agg({"verified": "sum"}).first()[0] / (asked.count() * n)
    assert n == 6000 and share < 0.1
    check(nn.nearest(df).toPandas(), brute_nearest(list(zip(range(6000), x))))


@pytest.mark.parametrize("queries", [1024, 10])
def test_nearest_over_many_cells_with_copies(spark, monkeypatch, queries):
    monkeypatch.setattr(nn, "CELL", 128)
    monkeypatch.setattr(nn, "QUERIES", queries)
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 12)) * r.uniform(0.2, 3, (900, 1))  # norms differ
    x[300:600] = x[7]  # a third are one vector
    rows = [(int(i), [float(v) for v in x[i]], "s") for i in range(900)]
    bad = [(2000, None, "s"), (2020, [0.0] * 12, "s"), (2040, [float("nan")] * 12, "s"), (2060, [1.0, None], "s"), (None, [1.0] * 12, "s"), (2080, [], "s"), (2100, [float("inf")] + [1.0] * 11, "s")]
    df = spark.createDataFrame(rows + rows[:5] + bad, "vec_id long, embedding array<double>, score string")
    got = nn.nearest(df).toPandas()
    check(got, brute_nearest([r[:2] for r in rows]))
    hot = got[got.query_id == 320].sort_values("rank")
    assert list(hot.vec_id) == brute_order(x, 320)
    assert nn.nearest(df.limit(0)).count() == 0
    few = nn.nearest(df.filter("vec_id < 4")).toPandas()
    assert list(few.query_id) == [0, 0, 0]


def brute_order(x, q):
    s = np.round(x @ x[q], 9)
    return [int(j) for j in np.lexsort((np.arange(len(x)), -s)) if j != q][:20]


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lg.init(3, 4).items()}
    x, y = r.integers(0, 256, (6, 5)), np.array([0, 1, 2, 1, 0])
    p = {k: v.astype(np.float32) for k, v in p.items()}
    _, g = lg.gradients(p, x, y)
    for k in ("uf", "vb", "wf", "ub", "wb", "c"):
        flat = np.argsort(-np.abs(g[k]).ravel())[:4]
        for i in flat:
            e = 1e-2
            up, down = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
            up[k].ravel()[i] += e
            down[k].ravel()[i] -= e
            slope = (lg.gradients(up, x, y)[0] - lg.gradients(down, x, y)[0]) / (2 * e)
            assert slope == pytest.approx(float(g[k].ravel()[i]), rel=0.08, abs=2e-3)


def test_languages_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op7_language_id(spark, d).collect()
    assert len(got) == len(langs)
    fold = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in fold]) > 0.97


def test_language_edges(spark):
    rows = [(i, ("the and of " if i % 2 else "der die und ") * 20, "en" if i % 2 else "de", i) for i in range(40)]
    odd = [(None, "the and of", "en", 1), (100, None, "en", 1), (101, "", None, 1), (102, "12 34 !", "en", 1), (103, "the and of " * 30_000, None, 1)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score long")
    langs, params = lg.train(df)
    assert langs == ["de", "en"]
    got = {r.doc_id: r for r in lg.identify(df, langs, params).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "en" and got[None].lang_pred == "en" and got[0].lang_pred == "de" and not got[None].held_out
    assert lg.identify(df.limit(0), langs, params).count() == 0
    none = lg.train(df.limit(0))
    assert none == ([], None) and {r.lang_pred for r in lg.identify(df, *none).collect()} == {"und"}


def test_many_languages_share_the_training_rows(spark, monkeypatch):
    from packloom.llm import language

    monkeypatch.setattr(language, "MAX_ROWS", 24)
    monkeypatch.setattr(language, "fit", lambda windows, y, classes: y)
    rows = spark.createDataFrame([(i, f"l{i % 12:02}", f"text {i}") for i in range(240)], "doc_id long, lang string, text string")
    langs, y = language.train(rows.repartition(5))
    assert langs == [f"l{i:02}" for i in range(12)]
    assert [int((y == k).sum()) for k in range(12)] == [2 * language.PIECES] * 12


def test_the_draw_is_that_of_all_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lg, "PER_LANG", 5)
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, "big").when(F.col("id") < 3990, "mid").otherwise("few").alias("lang"), F.xxhash64("id").alias("h"), F.array(F.col("id").cast("string")).alias("x"))
    same = spark.range(500).select(F.lit("same").alias("lang"), F.xxhash64(F.lit(3)).alias("h"), F.array(F.lit("s")).alias("x"))
    rows = rows.unionByName(same)
    got = lg._drawn(rows).collect()
    want = {}
    for r in rows.collect():
        want.setdefault(r.lang, []).append((r.h, r.x))
    for k, v in want.items():
        assert sorted((r.h, r.x) for r in got if r.lang == k) == sorted(v)[:5]


def test_predictions_match_brute_force(spark):
    """Each text alone, byte by byte, through a plain copy of the network."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, p = lg.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def run(raw, w, u):
        hidden, h, out = u.shape[0], np.zeros(u.shape[0]), []
        for c in raw:
            g, a = w[c].astype(float), h @ u
            z, r = (np.clip(0.25 * (g + a)[k * hidden : (k + 1) * hidden] + 0.5, 0, 1) for k in (0, 1))
            n = np.clip(g[2 * hidden :] + r * a[2 * hidden :], -1, 1)
            h = (1 - z) * n + z * h
            out.append(h)
        return np.array(out)

    checked = 0
    for r in lg.identify(docs, langs, p).collect():
        raw = texts[r.doc_id].encode()
        if len(raw) > 3000 or not any(ch.isalpha() for ch in texts[r.doc_id]):
            continue
        total = np.zeros(len(langs))
        for k in range(0, len(raw), lg.WINDOW):
            part = raw[k : k + lg.WINDOW]
            padded = part.ljust(lg.WINDOW)  # the last window runs on over blanks, which do not count
            o = run(padded, p["wf"], p["uf"]) @ p["vf"] + run(padded[::-1], p["wb"], p["ub"])[::-1] @ p["vb"] + p["c"]
            e = np.exp(o - o.max(axis=1, keepdims=True))
            total += (e / e.sum(axis=1, keepdims=True))[: len(part)].sum(axis=0)
        total /= len(raw)
        assert r.score == pytest.approx(total.max(), abs=1e-4)
        if np.sort(total)[-1] - np.sort(total)[-2] > 1e-3:
            assert r.lang_pred == langs[int(total.argmax())]
        checked += 1
    assert checked > 60
