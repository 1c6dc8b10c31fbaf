import random

import numpy as np
import pytest

from packloom.llm import jaccard_join as jj
from packloom.llm.catalog import op4_jaccard_join
from packloom.llm.components import components, forest
from packloom.plans import stash


def brute(rows):
    """{id: (class, links)} by comparing all pairs of texts."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()))
    links = {i: set() for i, _ in rows}
    by: dict = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    near = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in near:
        (i, s), (j, t) = sets[a], sets[b]
        if 10 * len(s & t) >= 8 * len(s | t):
            links[i].add(j)
            links[j].add(i)
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


def test_words_hash_alike_wherever_they_stand():
    h = jj.word_hashes
    assert h(b"ab cd\tab")[0] == h(b"ab cd\tab")[2] == h(b"  ab")[0]
    long = b"x" * 200_000
    text = b"q " * 90_000 + long + b" tail q"
    got = h(text)
    assert len(got) == 90_003 and got[0] == got[-1] == h(b"q")[0] and got[-2] == h(b"tail")[0]
    assert h(long)[0] == got[90_000]
    assert len(set(h(b" ".join(b"w%d" % i for i in range(50_000))).tolist())) == 50_000


def test_forest_and_depth():
    assert forest(5, np.array([0, 3, 4]), np.array([1, 4, 1])).tolist() == [0, 0, 2, 0, 0]
    d = jj.prefix_depth()
    assert jj.recall(0.8, d) >= jj.TARGET_RECALL > jj.recall(0.8, d + 1)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 5), (9, 5), (50, 50)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {1: 1, 2: 1, 5: 1, 9: 1}


def test_join_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in op4_jaccard_join(spark, d).collect()}
    assert got == brute(rows)
    assert sum(v[1] > 0 for v in got.values()) > 50


def test_blocks_edges_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(90):  # a large group of near copies, cut into several blocks
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(300)] = "changed%d" % rng.randrange(10**6)
        rows.append((1000 + i, " ".join(w)))
    rows += [(i, "the same copy of a text") for i in range(20, 60)] + [(70, "one two"), (71, "one  two\n"), (72, "one two three"), (73, ""), (74, None), (75, " \n")]
    df = spark.createDataFrame([(i, t, "n", 5) for i, t in rows] + [(None, "lonely text without an id here", "n", 1)] * 2, "doc_id long, text string, rep string, comp int")
    out = jj.classes(df).collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in out if r.doc_id is not None}
    assert got == brute(rows)
    assert [(r.class_id, r.n_links) for r in out if r.doc_id is None] == [(None, 1)] * 2
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c, _ in got.values()})
    assert kept.filter("doc_id is null").count() == 1
    assert jj.classes(df.limit(0)).count() == 0 and jj.keep_one(df.limit(0)).count() == 0


def near_copies(rng, n, words, most, vocabulary=3000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(words)] = f"changed{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most", [2, 9, 20])
def test_large_groups_meet_leads_and_pivots(spark, monkeypatch, most):
    """Tight groups are decided by the lead and the pivot alone; loose ones leave rows that meet in blocks."""
    monkeypatch.setattr(jj, "BLOCK", 8)
    met = []
    monkeypatch.setattr(jj, "_open_pairs", lambda rows, group, block, f=jj._open_pairs: met.append(group) or f(rows, group, block))
    rng = random.Random(most)
    texts = near_copies(rng, 100, 300, most) + near_copies(rng, 40, 60, 3 if most > 2 else 0) + ["one lonely text with words of its own"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[3]) for i in range(20)] + [(900, texts[4])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.classes(df).collect()}
    want = brute(rows)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    full = brute([(k, t) for k, (_, t) in enumerate(rows)])
    assert all(got[rows[k][0]][1] == full[k][1] for k in range(len(rows)))
    assert ("comp" in met) == (most > 2)


def test_descent_shortens_prefixes_until_the_target(spark):
    import pyarrow as pa

    family = jj._hash_family(jj.TREES * jj.DEPTH)
    rng = random.Random(9)
    close, mid = near_copies(rng, 3, 400, 1), near_copies(rng, 2, 400, 4)
    sig = [jj.signature(jj.shingles(t), family) for t in close + mid]
    depths = []

    def seen(similarity, depth, trees=jj.TREES, f=jj.recall):
        depths.append(depth)
        return f(similarity, depth, trees)

    def table(which, shared):
        order = sorted(((sig[i][:shared].tobytes() + bytes([k]) * 4 * (jj.DEPTH - shared), i) for k, i in enumerate(which)))
        return pa.table({"rep": [i for _, i in order], "sig": [sig[i].tobytes() for _, i in order], "label": [x for x, _ in order]})

    old, jj.recall = jj.recall, seen
    try:
        same = jj._descend(table([0, 1, 2], jj.DEPTH), 0.6, 4, jj.TARGET_RECALL)
        assert same.num_rows == 2 and set(depths) == {jj.DEPTH}  # whole labels agree and the candidates are close
        depths.clear()
        assert jj._descend(table([0, 1, 2], 4), 0.6, 4, jj.TARGET_RECALL).num_rows == 2 and set(depths) == {4}
        assert jj._descend(table([0, 3, 4], 4), 0.6, 4, jj.TARGET_RECALL).num_rows == 1
    finally:
        jj.recall = old


def test_recall_of_planted_pairs(spark):
    rng = random.Random(11)
    rows, want = [], []
    for k in range(300):
        words = [f"p{rng.randrange(10**5)}" for _ in range(100)]
        cut = 100 - 5 * (k % 3) - 3
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:cut] + [f"q{rng.randrange(10**5)}" for _ in range(3 * (k % 3))]))]
        a, b = (set(zip(*[t.split()[i:] for i in range(5)])) for _, t in rows[-2:])
        want.append(10 * len(a & b) >= 8 * len(a | b))
    got = {r.doc_id: r.class_id for r in jj.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = [got[2 * k + 1] == 2 * k for k in range(300)]
    assert sum(want) > 150 and sum(h and w for h, w in zip(hit, want)) >= 0.99 * sum(want) and not any(h and not w for h, w in zip(hit, want))


def test_long_texts_join(spark):
    long = " ".join(f"word{i % 9973}x{i // 7}" for i in range(300_000))
    rows = [(1, long), (2, long + " and a few words more"), (3, "x" * 1_000_000), (4, "x" * 1_000_000 + " y"), (5, long[: len(long) // 2])]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}


def test_keep_one_takes_any_column_name(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (3, None, 5, 6)], "doc_id long, text string, goes int, _Goes int")
    kept = jj.keep_one(rows)
    assert kept.columns == rows.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", 1, 2), (3, None, 5, 6)]


@pytest.mark.parametrize("floor", [0, 3])
def test_hot_keys_change_nothing(spark, sf_dir, monkeypatch, floor):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((r.doc_id, r.class_id, r.n_links) for r in jj.classes(docs).collect())
    kept = sorted(r.doc_id for r in jj.keep_one(docs).collect())
    monkeypatch.setattr(stash, "HOT_ROWS", floor)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jj.classes(docs).collect()) == want
    assert sorted(r.doc_id for r in jj.keep_one(docs).collect()) == kept


def test_tight_groups_keep_the_links_between_them():
    """Rows that stop at whole labels, having found a near copy, lose no partner at the threshold."""
    import pyarrow as pa

    family, floor = jj._hash_family(jj.TREES * jj.DEPTH), jj.prefix_depth()
    rng = np.random.default_rng(5)
    new = lambda n: rng.integers(1, 1 << 62, n)
    missed = 0
    for _ in range(800):
        one = new(200)
        two = np.concatenate([one[:178], new(22)])  # 178 of 222: just above the threshold
        sets = [one, np.concatenate([one[1:], new(1)]), two, np.concatenate([two[:-1], new(1)])]
        sig = [jj.signature(np.unique(x).astype(np.uint64), family) for x in sets]
        a, b = [], []
        for t in range(jj.TREES):
            labels = sorted((x[t * jj.DEPTH : (t + 1) * jj.DEPTH].tobytes(), i) for i, x in enumerate(sig))
            for prefix in {x[: 4 * floor] for x, _ in labels}:
                group = [(x, i) for x, i in labels if x.startswith(prefix)]
                found = jj._descend(pa.table({"rep": [i for _, i in group], "sig": [sig[i].tobytes() for _, i in group], "label": [x for x, _ in group]}), jj.THRESHOLD - jj.SLACK, floor, jj.TARGET_RECALL)
                if found is not None:
                    a, b = a + found["a"].to_pylist(), b + found["b"].to_pylist()
        root = forest(4, np.array(a, int), np.array(b, int))
        missed += int(root[0] != root[2])
    assert missed <= 1
