"""Quality rules as a short-circuit cascade of native expressions.

Every row's base figures come from one pass over its words. The further rules run as one CASE: each is reached only
by rows that no earlier rule rejected. A sample gives each rule's cost (measured seconds) and selectivity, and the
rules are ordered by rejection per cost, so the order changes how much is computed and never the verdict.

Words are runs of characters other than U+0020 and U+0009-U+000D. Defined results: a null, empty or blank text has no
words, all figures 0 and fails; repeated rows each get their own equal result; an empty table gives an empty result;
extra columns of any name are ignored. Windows of eight words are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.plans.stash import scratch, stash

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows, about, on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
_BLANKS = " \t\n\x0b\x0c\r"
_SPLIT = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that the same text holds twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda k: (F.get(s, k - 1)["h"] == F.get(s, k)["h"]) | (F.get(s, k + 1)["h"] == F.get(s, k)["h"])
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: twin(k)), lambda k: F.get(s, k)["i"]))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total"))
        step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(width), p - a["last"])).alias("total"))
        total = F.aggregate(let(ordered, positions), start, step, lambda a: a["total"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    def windows(h: Column) -> Column:
        ahead = lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)])
        return F.transform(F.slice(h, F.lit(1), F.size(h) - (width - 1)), ahead)

    found = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(windows(h), covered))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(found)


def _count(text: Column, pattern: str) -> Column:
    """How many matches there are; asked with a class of single characters this beats deleting all the others."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def base_figures(text: Column) -> Column:
    """A struct of the base figures of ``text``."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _count(whole, "[#*$%&|<>]").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            _count(whole, r"[\x21-\x40\x5B-\x60\x7B-\x7E]").alias("n_marks"),  # visible ASCII other than letters
            _count(whole, "!").alias("n_bangs"),
        )

    return let(words_of(text), of)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes (text, base figures) and gives a boolean, not null for a text that passes the base rules."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _line_share(text: Column, pattern: str, percent: int) -> Column:
    """Whether more than ``percent`` of the lines match."""
    return 100 * _count(text, pattern) > percent * (_count(text, "\n") + 1)


def _lines_start(text: Column, marks: str) -> Column:
    """Whether any line starts with one of ``marks`` and a blank; cheap where none does."""
    t = F.coalesce(text, F.lit(""))
    hits = [F.startswith(t, F.lit(m)) | F.contains(t, F.lit("\n" + m)) for m in marks]
    return reduce(lambda a, b: a | b, hits)


RULES = [
    Rule("symbols", lambda t, f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("word_length", lambda t, f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("dup_lines", lambda t, f: 10 * f["n_dup_lines"] > 5 * (_count(t, "\n") + 1)),
    Rule("shouting", lambda t, f: 2 * _count(t, r"\p{Lu}") > f["word_chars"]),
    Rule("letterless", lambda t, f: 2 * f["n_marks"] > f["word_chars"]),
    Rule("exclamation", lambda t, f: 5 * f["n_bangs"] > f["n_words"]),
    Rule("ellipsis", lambda t, f: (F.contains(t, F.lit("…")) | F.contains(t, F.lit("..."))) & _line_share(t, r"(?m)(\.\.\.|…)$", 30)),
    Rule("bullets", lambda t, f: _lines_start(t, "•*-") & _line_share(t, r"(?m)^[•*-][\x20\t]", 90)),
]


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    rejected: float

    @property
    def rate(self) -> float:
        return self.rejected / max(self.cost, 1e-6)


def estimate(docs: DataFrame, rules: list[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Estimate]:
    """Each rule's measured seconds and rejected share on a sample of about ``rows`` rows that pass the base rules."""
    with scratch(docs.sparkSession):
        total = docs.count()
        part = docs.select(F.col(text_col).alias("text"))
        sample = part.sample(fraction=min(1.0, rows / total), seed=seed) if total > rows else part
        sample = stash(sample.select("text", base_figures(F.col("text")).alias("f")).filter(~base_failed(F.col("f"))))

        def timed(reject: Column) -> tuple[float, float]:
            plan = sample.agg(F.count_if(reject).alias("no"), F.count(F.lit(1)).alias("n"))
            best = 1e9
            for _ in range(2):  # the first run compiles
                began = time.perf_counter()
                no, n = plan.first()
                best = min(best, time.perf_counter() - began)
            return best, no / max(n, 1)

        floor = timed(F.length("text") < 0)[0]
        return [Estimate(r.name, max(cost - floor, 1e-4), share) for r in rules for cost, share in [timed(r.rejects(F.col("text"), F.col("f")))]]


def order_rules(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """By rejection per cost, highest first; ties keep the cheaper one first, then the given order."""
    of = {e.name: e for e in estimates}
    return sorted(rules, key=lambda r: (-of[r.name].rate, of[r.name].cost))


def first_rejection(rules: list[Rule], text: Column, figures: Column) -> Column:
    """The name of the first rule that rejects, else null. A later rule is not evaluated once one has rejected."""
    out = F.when(base_failed(figures), F.lit("base"))
    for r in rules:
        out = out.when(r.rejects(text, figures), F.lit(r.name))
    return out


def judge(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", ordered: bool = False) -> DataFrame:
    """(id, base figures, base_failed, kept, rejected_by) of every row; ``ordered``: the rules are in order already."""
    rules = RULES if rules is None else rules
    if rules and not ordered:
        rules = order_rules(rules, estimate(docs, rules, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), base_figures(F.col(text_col)).alias("f"))
    verdict = first_rejection(rules, F.col("text"), F.col("f"))
    return rows.select(F.col("id").alias(id_col), "f.*", base_failed(F.col("f")).alias("base_failed"), verdict.isNull().alias("kept"), verdict.alias("rejected_by"))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    rules = RULES if rules is None else rules
    rules = order_rules(rules, estimate(docs, rules, text_col)) if rules else rules
    text = F.col(text_col)
    return docs.filter(let(base_figures(text), lambda f: first_rejection(rules, text, f).isNull()))
