"""Secret scans: fixed patterns, and a likelihood ratio of two character Markov models, all as native expressions.

The models are first-order over the characters that secrets use. They are trained from labelled tokens (random strings
against ordinary identifiers); the log-ratio of their transitions is one bounded table, ALPHABET squared, which every
task reads as a literal. A long token is a secret if its summed log-ratio reaches ``MIN_RATIO``. ``scan`` asks about
tokens of 20 characters with a digit, as its SQL does; ``redact`` about all of 16 and more, letters only or not.

Positions are code points, ends exclusive. Defined results: a null text is an empty text (no spans, the digest of the
empty string); repeated rows each get their own result; an empty table gives an empty result; extra columns pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm.quality import let

#: Fixed values of the contract. Runs shorter than the least length are never matches of ``access`` and ``hex``, and
#: a shorter run of theirs can't hide a longer one, so their length is part of the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGN = 8

#: Tokens that ``scan`` (those with a digit) and ``redact`` ask the ratio about; below 16 characters ordinary words of the
#: given texts reach it. A whole run is matched first and asked for its digit afterwards, which reads each run once.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LONG_TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Natural logarithm of the odds at which a token counts as random.
MIN_RATIO = 12.0
#: Random strings, and pairs of ordinary words, in the default samples.
SAMPLES = 2000
#: Ordinary words of which the default identifiers are made.
ORDINARY = (
    "account address array author batch block buffer button cache channel client column config context counter customer data default document "
    "element error event factory field file filter format function group handler header image index input item language length license list "
    "manager message method model module name number object option order output package page parameter password path pattern point process "
    "product profile project property query reader record report request response result sample schema section server service session setting "
    "source state status stream string system table target template test text thread title token total type update user value version view "
    "window worker writer the that with from and for tion ing ed er house water people world schule zeit arbeit maison temps monde ciudad tiempo"
).split()


def default_samples(spark: SparkSession) -> DataFrame:
    """(token, random) made by rule: slices of digests in three alphabets, and joined ordinary words."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    code = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    size = (F.pmod(F.col("id"), F.lit(20)) + 20).cast("int")
    token = F.when(F.col("id") % 3 == 0, F.substring(digest, F.lit(1), size)).when(F.col("id") % 3 == 1, F.substring(code, F.lit(1), size)).otherwise(F.upper(F.substring(code, F.lit(1), size)))
    random = spark.range(SAMPLES).select(token.alias("token"), F.lit(True).alias("random"))
    words = F.array(*[F.lit(w) for w in ORDINARY])
    pick = lambda m, a: F.get(words, F.pmod(F.col("id") * m + a, F.lit(len(ORDINARY))).cast("int"))
    three = (pick(7, 3), pick(31, 11), pick(57, 29))
    number = F.when(F.col("id") % 4 == 0, F.concat(F.lit("_"), (F.col("id") % 100).cast("string"))).otherwise("")
    style = F.pmod(F.col("id"), F.lit(5))
    joined = (
        F.when(style == 0, F.concat_ws("_", *three)).when(style == 1, F.concat(three[0], F.initcap(three[1]), F.initcap(three[2])))
        .when(style == 2, F.concat_ws("-", *three)).when(style == 3, F.concat_ws("/", *three)).otherwise(F.upper(F.concat_ws("_", *three)))
    )
    return random.unionByName(spark.range(SAMPLES).select(F.concat(joined, number).alias("token"), F.lit(False).alias("random")))


def train(samples: DataFrame, alphabet: str = ALPHABET, smoothing: float = 0.5) -> list[float]:
    """The log-ratio of each transition, row by row; index 0 of either side is any other character.

    Counting is a distributed aggregation; what reaches the driver has at most 2 * (len(alphabet) + 1) ** 2 rows.
    """
    n = len(alphabet) + 1
    at = lambda c: F.instr(F.lit(alphabet), c)
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: at(F.substring(F.col("token"), i, F.lit(1))) * n + at(F.substring(F.col("token"), i + 1, F.lit(1))))
    counts = samples.filter(F.length("token") > 1).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    models = {}
    for kind in (True, False):
        of = {r["pair"]: r["count"] for r in counts if r["random"] is kind}
        rows = [sum(of.get(a * n + b, 0) for b in range(n)) for a in range(n)]
        models[kind] = [(of.get(a * n + b, 0) + smoothing) / (rows[a] + smoothing * n) for a in range(n) for b in range(n)]
    return [math.log(p / q) for p, q in zip(models[True], models[False], strict=True)]


def log_ratio(token: Column, model: list[float], alphabet: str = ALPHABET) -> Column:
    """The summed log-ratio of the token's transitions, in one walk over its characters."""
    n = len(alphabet) + 1
    table = F.split(F.lit(",".join(repr(x) for x in model)), ",").cast("array<double>")  # folds to a literal
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c))

    def walk(at: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.get(at, F.lit(0)).alias("last"))
        step = lambda a, x: F.struct((a["sum"] + F.get(table, a["last"] * n + x)).alias("sum"), x.alias("last"))
        return F.aggregate(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), start, step, lambda a: a["sum"])

    return let(places, walk)


def running(sizes: Column, block: int = 256) -> Column:
    """The inclusive running sums of an array: summed in blocks, then shifted by the blocks before, as appending to one
    array a step at a time would copy it at every step."""

    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out"))
        return F.aggregate(part, start, step, lambda a: a["out"])

    def shifted(blocks: Column) -> Column:
        before = sums(F.transform(blocks, lambda x: F.element_at(x, -1)))
        move = lambda b: F.transform(blocks, lambda x, i: F.transform(x, lambda v: v + F.when(i == 0, 0).otherwise(F.get(b, i - 1))))
        return F.flatten(let(before, move))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda k: F.slice(sizes, k * block + 1, F.lit(block)))
    return let(F.transform(cut, sums), shifted)


def places(text: Column, pattern: str) -> Column:
    """(start, end, match) of the leftmost non-overlapping matches, from the gaps that splitting leaves."""
    kind = "array<struct<start:int,end:int,match:string>>"

    def walk(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        one = lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match")))
        return let(let(sizes, running), one)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda g: walk(m, g)))
    return F.when(F.rlike(text, F.lit(pattern)), found.cast(kind)).otherwise(F.array().cast(kind))


def spans(text: Column, model: list[float], min_ratio: float = MIN_RATIO, token: str = TOKEN, digit: bool = True) -> tuple[Column, Column]:
    """Base spans and all spans, each an array of (start, order, end, kind) in order; ``digit`` asks random tokens for one."""
    whole = F.coalesce(text, F.lit(""))

    def of(kind: str, found: Column) -> Column:
        k = KINDS.index(kind)
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    long = F.filter(places(whole, ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= LEAST_ASSIGN)
    base = F.array_sort(F.concat(of("assign", long), of("access", places(whole, ACCESS)), of("hex", places(whole, HEX))))
    asked = places(whole, token)
    asked = F.filter(asked, lambda x: F.rlike(x["match"], F.lit("[0-9]"))) if digit else asked
    random = F.filter(asked, lambda x: log_ratio(x["match"], model) >= min_ratio)

    def more(b: Column) -> Column:
        new = F.filter(of("markov", random), lambda x: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
        return F.array_sort(F.concat(b, new))

    return base, let(base, more)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts by base kind, base_sha256, spans) of every row."""
    model = model or train(default_samples(docs.sparkSession))
    _, found = spans(F.col("text"), model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", found.alias("found"))
    base = F.filter("found", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )


def redact(text: Column, model: list[float], mask: str = "[SECRET]") -> Column:
    """``text`` with every span, overlaps merged, replaced by ``mask``; a null text stays null."""

    def cut(t: Column, found: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

        def step(a: Column, x: Column) -> Column:
            kept = F.concat(a["out"], F.substring(t, a["pos"] + 1, x["start"] - a["pos"]), F.lit(mask))
            return F.struct(F.greatest(a["pos"], x["end"]).alias("pos"), F.when(x["start"] >= a["pos"], kept).otherwise(a["out"]).alias("out"))

        done = F.aggregate(found, start, step)
        return let(done, lambda a: F.concat(a["out"], F.substring(t, a["pos"] + 1, F.length(t))))

    return let(spans(text, model, token=LONG_TOKEN, digit=False)[1], lambda s: F.when(F.size(s) == 0, text).otherwise(cut(text, s)))
