import hashlib
import math
import zlib

from packloom.llm import sharding, url_rules
from packloom.llm.catalog import URL_RULES, op9_sharding, op10_url_filters


def brute_shard(key, tree):
    path, node = "", tree
    weight = lambda n: sum(map(weight, n.values())) if isinstance(n, dict) else n
    for _ in range(3):
        def draw(k):
            u = (int(hashlib.md5(f"{key}{path}/{k}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
            return -math.log(u) / weight(node[k])

        best = min(node, key=draw)
        path, node = f"{path}/{best}", node[best]
    return best


def test_shards_match_brute_force(spark, sf_dir):
    got = op9_sharding(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    for r in got.itertuples():
        raw = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.shard == brute_shard(str(r.doc_id), sharding.default_tree(16))
        assert r.grown_shard == brute_shard(str(r.doc_id), sharding.default_tree(17))
        assert r.grown_shard in (r.shard, 16)
    assert got.shard.nunique() == 16
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_weight_change_stays_in_its_subtree(spark):
    tree = {"a": {"k": {0: 1.0, 1: 1.0}}, "b": {"k": {2: 1.0, 3: 1.0}}}
    heavy = {"a": {"k": {0: 3.0, 1: 1.0}}, "b": {"k": {2: 1.0, 3: 1.0}}}
    rows = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    got = sharding.shard_rows(rows, tree=tree, grown=heavy).toPandas()
    moved = got[got.shard != got.grown_shard]
    assert len(moved) and not set(moved.grown_shard) & {2, 3}
    assert not len(got[(got.shard == 2) & (got.grown_shard == 3)])
    assert abs((got.grown_shard == 0).mean() - 0.5) < 0.04


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(3000).selectExpr("cast(id as string) as k").cache()
    counts = range(1, 22)
    from pyspark.sql import functions as F

    got = rows.select(*[sharding.assign(F.col("k"), sharding.default_tree(n), n).alias(f"n{n}") for n in counts]).toPandas()
    rows.unpersist()
    for n in counts:
        size = got[f"n{n}"].value_counts()
        assert set(size.index) == set(range(n)) and size.max() < 1.6 * 3000 / n
        if n > 1:
            moved = got[got[f"n{n}"] != got[f"n{n - 1}"]]
            assert set(moved[f"n{n}"]) == {n - 1}


def test_shard_edge_cases(spark):
    rows = spark.createDataFrame([(None, None, 1), (5, "é", 2), (5, "é", 2), (7, "", 3)], "doc_id long, text string, slot int")
    got = {(r.doc_id, r.slot): r for r in sharding.shard_rows(rows).collect()}
    assert len(got) == 4
    assert sorted((r.size, r.text_crc32) for r in got.values()) == sorted([(1, 0), (1, 0), (3, zlib.crc32("é".encode())), (3, zlib.crc32("é".encode()))])
    assert sharding.shard_rows(rows.limit(0)).count() == 0


def brute_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text)) if fit else None


def test_sweep_of_nested_rules():
    rules = [url_rules.Rule("allow", h, p) for h in ("org", "example.org", "a.example.org", "com", "b.com", "zz") for p in ("/", "/x", "/x/y", "")]
    urls = [(h, p) for h in ("org", "norg", "example.org", "q.a.example.org", "exampleorg", "b.com", "x.b.com", "c", "", "zz") for p in ("", "/", "/x/z", "/x/y/1", "/q")]
    keyed = sorted((url_rules.reversed_key(h), h, p) for h, p in urls)
    got = list(url_rules.sweep(keyed, url_rules.intervals(rules)))
    for (_, h, p), r in zip(keyed, got, strict=True):
        want = brute_rule(h, p, rules)
        assert (r and r.text) == (want and want.text), (h, p)


def test_url_edges(spark):
    urls = ["http://A.Example.ORG/es/1?x#y", "https://org", "https://org/", "x.org/", None, "http://e.com/fr/", "://com/de/", "http://com?/de/", "http://ÄB.com/de/ü", "a://b://org/"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://org/", "h")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(rows, URL_RULES).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("org", "", None, "allow") and got[2] == ("org", "/", "org/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("e.com", "/fr/", "com/fr/", "allow") and got[6] == ("com", "/de/", "com/de/", "block")
    assert got[7] == ("com", "", None, "allow") and got[8] == ("Äb.com", "/de/ü", "com/de/", "block")
    assert got[9] == ("b:", "//org/", None, "allow") and got[None] == ("org", "/", "org/", "allow")
    assert url_rules.judge_urls(rows.limit(0), URL_RULES).count() == 0


def test_many_rules_take_several_sweeps(spark, monkeypatch):
    rules = [url_rules.Rule(v, h, p) for v, h, p in [("allow", "org", "/"), ("block", "example.org", "/a"), ("block", "org", "/"), ("allow", "g", "/abcdef"), ("block", "e.g", "/abcd"), ("block", "org", "/a/b/c/d/e"), ("allow", "c", "")]]
    urls = [f"http://{h}{p}" for h in ("org", "x.example.org", "e.g", "f.e.g", "c", "none") for p in ("", "/", "/a", "/abcdefg", "/a/b/c/d/e/f")]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    want = sorted(map(tuple, url_rules.judge_urls(rows, rules).collect()), key=str)
    for most in (1, 2, 5):
        monkeypatch.setattr(url_rules, "MAX_RULES", most)
        assert sorted(map(tuple, url_rules.judge_urls(rows, rules).collect()), key=str) == want
    assert {r[4] for r in want} == {"allow", "block"} and {r.verdict for r in url_rules.judge_urls(rows, [], default="block").collect()} == {"block"}


def test_url_query_counts(spark, sf_dir):
    assert op10_url_filters(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
