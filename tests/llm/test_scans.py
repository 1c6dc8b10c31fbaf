import hashlib
import re

from pyspark.sql import functions as F

from packloom.llm import licenses, secrets
from packloom.llm.catalog import op5_license_scans, op8_secret_scans

NAMES = "abc"


def brute_licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    hits = 0
    for r in op5_license_scans(spark, sf_dir).collect():
        want = brute_licenses(rows.text[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        hits += r.n_base > 0
    assert hits


def test_license_rules():
    rules = licenses.signatures()
    assert len(rules) >= 200
    words = licenses.automaton(rules)
    labels = lambda t: [h[2].label for h in licenses.detect(t, rules, words)]
    assert labels("this is licensed under the apache license, version 2.0.") == ["apache-2.0"]
    assert labels("spdx-license-identifier: gpl-3.0-or-later") == ["gpl-3.0"]
    assert labels("the mit license") == ["mit"] and labels("he sent a limit to mit") == []
    assert labels("gnu lesser general public license, version 3") == ["lgpl-3.0"]
    assert labels("nothing here") == []


def test_license_keywords_lose_no_detection():
    rules = licenses.signatures()
    words = licenses.automaton(rules)
    labels = lambda t: [h[2].label for h in licenses.detect(t, rules, words)]
    assert labels("under the gnu general\npublic license, version 2") == ["gpl-2.0"]
    assert labels("a mozilla  public license 2.0 text") == ["mpl-2.0"] and labels("the creative,\n commons attribution 4.0") == ["cc-by"]
    ids = ["mpl-2.0", "lgpl-2.1", "agpl-3.0", "epl-2.0", "cc-by-4.0", "bsl-1.0", "ofl-1.1", "psf-2.0", "python-2.0", "gpl-3.0-or-later"]
    assert [labels(f"license: {x}") for x in ids[:7]] == [["mpl-2.0"], ["lgpl-2.1"], ["agpl-3.0"], ["epl-2.0"], ["cc-by"], ["bsl-1.0"], ["ofl-1.1"]]
    names = ["gnu library general public license", "eclipse public license 1.0", "common development and distribution license", "sil open font license", "microsoft reciprocal license"]
    texts = [f"{a}{x.replace(' ', gap)}" for x in ids + names for gap in (" ", "  ", "\n", ",\t") for a in ("licence = ", "released under ", "copy of ", "spdx-license-identifier: ", "")]
    every = "".join(r.keywords[0] + " " for r in rules)  # lets every rule run
    for t in texts:
        ungated = [h for h in licenses.detect(f"{t}\n\n" + every, rules, words) if h[0] < len(t)]
        assert licenses.detect(t, rules, words) == ungated, t


def brute_detect(low, rules):
    """All rules without the prefilter; a detection inside one of better or equal priority goes."""
    hits = sorted(((m.start(), m.end(), r) for r in rules for m in r.pattern.finditer(low)), key=lambda h: (h[0], -h[1], h[2].priority))
    inside = lambda k, h: any(g[0] <= h[0] and h[1] <= g[1] and (g[2].priority < h[2].priority or g[2].priority == h[2].priority and (g[:2] != h[:2] or j < k)) for j, g in enumerate(hits))
    return [h for k, h in enumerate(hits) if not inside(k, h)]


NOTICES = [
    "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance\n# with the License.",
    "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version. */",
    "Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided ... Neither the name of the Org nor the names of its contributors\n may be used to endorse or promote products derived from this software",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")",
    "gnu general\npublic license, version 3", "gnu\tgeneral public\nlicense", "licensed under the creative\n  commons attribution 4.0", "python\nsoftware foundation license", "license: cc-by-sa-4.0", "license: bsl-1.0", "license: gpl-3.0",
    "see https://www.gnu.org/licenses/gpl-3.0.html or http://www.apache.org/licenses/LICENSE-2.0 and https://creativecommons.org/licenses/by-sa/4.0/",
]


def test_license_labels_and_scores_match_all_rules(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + NOTICES
    rules = licenses.signatures()
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    labelled = 0
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        hits, base = brute_detect(low, rules), brute_licenses(t)
        assert got[i].labels == ",".join(sorted({h[2].label for h in hits} | set(filter(None, base[4].split(","))))), t[:300]
        assert got[i].score == max([h[2].score for h in hits] + [0.5] * bool(base[1]), default=0.0)
        assert got[i].detections == [f"{h[2].label}:{h[0]}:{h[1]}" for h in hits]
        labelled += bool(hits)
    want = ["apache,apache-2.0", "gpl,gpl-2.0", "bsd,bsd-3-clause", "mit", "gpl,gpl-3.0", "gpl", "cc-by", "psf-2.0", "cc-by-sa", "bsl-1.0", "gpl-3.0", "apache-2.0,cc-by-sa,gpl-3.0"]
    assert [got[len(texts) - len(NOTICES) + k].labels for k in range(len(NOTICES))] == want and labelled > len(NOTICES)


def test_license_rules_hold_their_keywords():
    from packloom.llm.license_texts import TEXTS

    rules = licenses.signatures()
    assert len(TEXTS) > 150 and len(rules) > 400
    for label, priority, score, word, text in TEXTS:
        assert word in text.replace("\\.", ".").lower() and 1 <= priority <= 5 and 0 < score <= 1, (label, text)


def test_license_edges(spark):
    rows = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "MIT-License é MIT\nlicense", 3), (2, "x " * 200_000 + "mit license", 3)], "doc_id long, text string, labels int")
    got = [tuple(r)[:6] for r in licenses.scan(rows).orderBy("doc_id", "n_words").collect()]
    assert got[0] == (None, 0, 0, None, None, "") and got[1] == (1, 0, 0, None, None, "")
    assert got[2] == (2, 5, 2, 0, 3, "mit") and got[3] == (2, 200_002, 1, 200_000, 200_000, "mit")
    assert licenses.scan(rows.limit(0)).count() == 0


def brute_base(text):
    t, out = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_base_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    hits = 0
    for r in op8_secret_scans(spark, sf_dir).collect():
        want = brute_base(rows.text[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r, want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        hits += bool(want)
    assert hits


EDGES = [
    None,
    "",
    "secret=token:abcdefghij and é TOKEN = 'abcdefgh' token=short",
    "a" * 32 + " AKIAABCDEFGHIJKL " + "0123456789abcdef" * 4 + "g",
    "password:password=password:12345678",
    "plain " * 50_000 + "api_key: Zx9Qw8Er7Ty6Ui5",
]


def test_secret_edges_and_models(spark):
    model = secrets.train(secrets.default_samples(spark))
    random, ordinary = "q8Zt3kVx9LmB2nRw7YpD", "user_account_manager_2"
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGES)] + [(10, f"ü see {random} and {ordinary}", "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.scan(rows, model).collect()}
    for i, t in enumerate(EDGES):
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute_base(t))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t and t[:50], got[i])
    assert got[10].spans == f"markov:6:{6 + len(random)}"
    from pyspark.sql import functions as F

    cut = {r.doc_id: r.t for r in rows.select("doc_id", secrets.redact(F.col("text"), model).alias("t")).collect()}
    assert cut[0] is None and cut[1] == "" and cut[10] == f"ü see [SECRET] and {ordinary}"
    assert cut[3].startswith("[SECRET] [SECRET] [SECRET]g")
    assert secrets.scan(rows.limit(0), model).count() == 0


def test_masking_asks_the_ratio_about_letters_and_shorter_tokens(spark):
    from pyspark.sql import functions as F

    model = secrets.train(secrets.default_samples(spark))
    keys = ["qZtVxLmBnRwYpDkJhGfXcQsUvNyT", "QXZJVKWYHGBPDFMTQZXW", "q8Zt3kVx9LmB2nRw", "K7pX2vQ9zL4mW8tR1"]
    plain = ["user_account_manager", "internationalization", "verantwortlichkeit", "OrderReportHandler"]
    rows = spark.createDataFrame([(t, f"see {t} here") for t in keys + plain], "t string, text string")
    got = {r.t: r.masked for r in rows.select("t", secrets.redact(F.col("text"), model).alias("masked")).collect()}
    assert [got[t] for t in keys] == ["see [SECRET] here"] * len(keys)
    assert [got[t] for t in plain] == [f"see {t} here" for t in plain]


def test_long_runs_take_time_in_proportion(spark):
    import base64
    import random
    import time

    rng = random.Random(7)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    blob = base64.b64encode(rng.randbytes(750_000)).decode()
    many = " ".join(f"token: Ab{rng.randrange(10**9):09}x" for _ in range(6000))
    rows = spark.createDataFrame([(1, letters), (2, f"see {blob} end"), (3, many)], "doc_id long, text string")
    model = secrets.train(secrets.default_samples(spark))
    secrets.scan(rows.limit(0), model).collect()
    began = time.perf_counter()
    got = {r.doc_id: r for r in secrets.scan(rows, model).collect()}
    assert time.perf_counter() - began < 30
    assert got[1].spans == "" and f"markov:4:{4 + len(blob)}" in got[2].spans and got[3].n_assign == 6000
    for i, t in ((1, letters), (3, many)):
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute_base(t))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    cut = [r.t for r in rows.select(secrets.redact(F.col("text"), model).alias("t")).collect()]
    assert cut[1] == "see [SECRET] end" and cut[2] == " ".join(["[SECRET]"] * 6000)


def test_running_sums(spark):
    xs = [[3], [1, 2, 3], list(range(1000)), [0] * 257]
    rows = spark.createDataFrame([(x,) for x in xs], "x array<int>").select(secrets.running(F.col("x"), 16).alias("y")).collect()
    assert [r.y for r in rows] == [[sum(x[: i + 1]) for i in range(len(x))] for x in xs]
