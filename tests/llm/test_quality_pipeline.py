import re
from collections import Counter

import duckdb
import sentencepiece

import corpus_pipeline
from packloom.llm import quality
from packloom.llm.catalog import OP2_SQL, op2_quality_rules, queries
from tests.llm.test_jaccard import brute
from tests.llm.test_scans import brute_base


def brute_base_figures(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    covered = {p for i, x in enumerate(wins) if n[x] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_figures_match_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op2_quality_rules(spark, sf_dir).collect():
        want = brute_base_figures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_edges(spark):
    texts = [None, "", " \n\x0b", "a b c d e f g h " * 3, "x y " + " ".join(f"word{chr(97 + i)}" for i in range(26)), "a " * 30_000, "one two three four five six seven eight nine " * 2, "Über\n\nÜber\n \n" + "z " * 3]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "A B", 1), (1, "", 1)], "doc_id long, text string, n_words int")
    rows = quality.judge(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base_figures(texts[r.doc_id])
    kept = {r.doc_id for r in rows if r.kept}
    good = quality.keep_good(df)
    assert good.columns == df.columns and {r.doc_id for r in good.collect()} == kept == {4}
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost():
    rules = [quality.Rule(n, None) for n in "abc"]
    found = quality.order_rules(rules, [quality.Estimate("a", 1.0, 0.1), quality.Estimate("b", 0.1, 0.1), quality.Estimate("c", 0.01, 0.0)])
    assert [r.name for r in found] == ["b", "a", "c"]


def test_pipeline_matches_brute_force(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    good = {r[0] for r in db.sql(f"SELECT doc_id FROM ({OP2_SQL}) WHERE kept").fetchall()}
    docs = {r[0]: r for r in db.sql("SELECT doc_id, text, source FROM documents").fetchall() if r[0] in good}
    classes = brute([(i, r[1]) for i, r in docs.items()])
    stay = {i for i, (c, _) in classes.items() if c == i}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    times = Counter(r.doc_id for r in rows)
    assert set(times) == stay and max(times.values()) <= 2
    words = Counter()
    for i in stay:
        words[docs[i][2]] += len(docs[i][1].encode().split())
    once = {s for s in words if all(times[i] == 1 for i in stay if docs[i][2] == s)}
    assert max(words, key=words.get) in once
    theirs = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    for r in rows:
        assert r.round_trip and r.n_tokens == len(r.ids)
        text = docs[r.doc_id][1]
        if not brute_base(text) and "[SECRET]" not in theirs.decode(r.ids):
            assert theirs.encode(text) == r.ids
        else:
            assert not brute_base(theirs.decode(r.ids))


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    odd = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, "good words " * 3 + " ".join(f"word{chr(97 + i)}" for i in range(26)), None, None, None, None)]
    docs = spark.createDataFrame(odd * 2, "doc_id long, text string, lang string, source string, n_chars long, rep string")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            assert out.count() >= 0
    assert "pipeline" in queries() and len(queries()) == 11


def test_stages_take_very_long_texts_and_copies(spark, sf_dir):
    """One text of 2 MB, a near copy and exact copies of it, a run of one letter, and columns named as the stages' own."""
    import hashlib

    word = lambda i: "w" + "".join(chr(97 + int(c, 16)) for c in hashlib.md5(str(i).encode()).hexdigest()[:7])
    long = " ".join(word(i) for i in range(220_000))
    secret = "q8Zt3kVx9LmB2nRw7YpD5sHc"
    rows = [(1, long), (2, long + " and some more words"), (3, long), (3, long), (4, "z" * 200_000), (5, " ".join(word(-i) for i in range(1, 80)) + f" {secret} end")]
    names = ["goes", "mix_key", "mix_rule", "rep", "comp", "ids"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *names) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in good.select("doc_id").collect()) == [1, 2, 3, 3, 5]
    one = stages["near duplicates"](spark, good, sf_dir)
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == [1, 5]
    clean = stages["secret scans"](spark, one, sf_dir)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] == long and secret not in texts[5] and "[SECRET]" in texts[5]
    mixed = stages["source mixing"](spark, clean, sf_dir)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.select("doc_id").collect()} == {1, 5}
    ids = {r.doc_id: r for r in stages["piece encoding"](spark, mixed, sf_dir).collect()}
    assert ids[1].round_trip and ids[5].round_trip and ids[1].n_tokens > 220_000
