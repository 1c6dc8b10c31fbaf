"""URL filters as a sort-merge range join between reversed-host keys and nested rule intervals.

A host's canonical key is its labels from last to first, each closed by U+0000. A rule for a host then covers
the half-open key interval [key, key + U+0001 in place of the last U+0000), which holds the host and all its
subdomains. Such intervals nest or are disjoint, so a sweep over sorted urls needs only a stack of active rules.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and gets the default
verdict. Null ids, repeated rows and extra columns pass; an empty table, and an empty batch, give an empty result. Rules
with the same host and path: the first listed wins. Of rules of one length the one with the longer host wins. Rules
travel to the tasks inside the function, at most ``MAX_RULES`` at a time; more take a sweep for each such part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.plans.stash import stash

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of one sweep.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def reversed_key(host: str) -> str:
    return "".join(label + "\0" for label in reversed(host.split(".")))


def intervals(rules: Iterable[Rule]) -> list[tuple[str, str, str, dict[str, Rule], list[int]]]:
    """One (start, end, host, rules by path, path lengths from long to short) per rule host, by start."""
    hosts: dict[str, dict[str, Rule]] = {}
    for r in rules:
        hosts.setdefault(r.host, {}).setdefault(r.path, r)
    out = []
    for host, paths in hosts.items():
        start = reversed_key(host)
        out.append((start, start[:-1] + "\1", host, paths, sorted({len(p) for p in paths}, reverse=True)))
    return sorted(out, key=lambda x: x[0])


def sweep(keys: Iterable[tuple[str, str, str]], spans: list) -> Iterator[Rule | None]:
    """The longest fitting rule of each (key, host, path), given in the order of their keys."""
    stack: list = []
    at = 0
    for key, host, path in keys:
        while at < len(spans) and spans[at][0] <= key:
            while stack and stack[-1][1] <= spans[at][0]:
                stack.pop()
            stack.append(spans[at])
            at += 1
        while stack and stack[-1][1] <= key:
            stack.pop()
        best = None
        for _, _, of, paths, lengths in stack:
            if host != of and not host.endswith("." + of):
                continue  # a U+0000 inside a label
            hit = next((paths[path[:n]] for n in lengths if path[:n] in paths), None)
            if hit and (best is None or len(hit.text) >= len(best.text)):
                best = hit
        yield best


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row. A range partitioning splits hot hosts by path and id."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    urls = pages.select(F.col(id_col).alias("id"), rest.alias("rest")).select(
        "id",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), _UPPER, _LOWER).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    for start in range(0, max(len(rules), 1), MAX_RULES):
        urls = _swept(urls if not start else stash(urls), rules[start : start + MAX_RULES])
    return urls.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _swept(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(id, host, path, rule, verdict, of_host): the best of ``rules`` and of what earlier sweeps found."""
    key = F.concat(F.array_join(F.reverse(F.split("host", "[.]", -1)), "\0"), F.lit("\0"))
    urls = urls.withColumn("key", key).repartitionByRange("key", "path", "id").sortWithinPartitions("key", "path")
    spans = intervals(rules)
    again = "rule" in urls.columns

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                if b.num_rows:
                    pending.append(b)
                    yield from zip(b["key"].to_pylist(), b["host"].to_pylist(), b["path"].to_pylist(), strict=True)

        pending: list[pa.RecordBatch] = []
        found: list[Rule | None] = []
        for rule in sweep(rows(), spans):
            found.append(rule)
            if len(found) == pending[0].num_rows:
                b = pending.pop(0)
                out = [(r.text, r.verdict, len(r.host)) if r else (None, None, 0) for r in found]
                if again:  # an earlier rule gives way to a longer one only
                    had = zip(b["rule"].to_pylist(), b["verdict"].to_pylist(), b["of_host"].to_pylist(), strict=True)
                    out = [h if h[0] is not None and (x[0] is None or (len(h[0]), h[2]) >= (len(x[0]), x[2])) else x for h, x in zip(had, out, strict=True)]
                kinds = [pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([b["id"], b["host"], b["path"], *[pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]], names=["id", "host", "path", "rule", "verdict", "of_host"])
                found = []

    return urls.mapInArrow(match, f"id {dict(urls.dtypes)['id']}, host string, path string, rule string, verdict string, of_host int")
