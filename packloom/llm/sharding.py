"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row takes the child with the least -ln(u) / weight, where u is a uniform hash of (key, child).
Raising or adding a weight can only win rows for that child, so a change at one level moves rows into the changed
subtree alone; draws inside every other subtree read only their own weights and stay as they are.

The default tree has one shape for all counts: 16 places in two regions of two racks, and each further shard as a region
of its own. While fewer shards live, a row whose place has none is dealt by one flat draw among the living. One more
shard fills a place or becomes a child of the root, and either way takes rows only into itself.

Defined results: a null key hashes as the empty string; a null text has size 1 and checksum 0; repeated rows get
slots of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm.quality import let
from packloom.plans.stash import exclusive_sums, stash

#: A tree is {region: {rack: {shard number: weight}}}; a node's weight is the sum of the weights below it.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

BASE_REGIONS, BASE_RACKS, BASE_SHARDS = 2, 2, 4


BASE = BASE_REGIONS * BASE_RACKS * BASE_SHARDS


def default_tree(shards: int) -> dict[str, dict[str, dict[int, float]]]:
    """Equal weights: the full base tree, then each further shard as a region of its own."""
    if shards < 1:
        raise ValueError("at least one shard")
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(BASE):
        tree.setdefault(f"r{s // (BASE_RACKS * BASE_SHARDS)}", {}).setdefault(f"k{s // BASE_SHARDS}", {})[s] = 1.0
    for s in range(BASE, shards):
        tree[f"x{s}"] = {f"x{s}": {s: 1.0}}
    return tree


def levels(tree: Tree) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, parent path -> [(child path, weight)]; weights of zero or less are left out."""
    weight = lambda n: sum(map(weight, n.values())) if isinstance(n, Mapping) else float(n)
    out: list[dict[str, list[tuple[str, float]]]] = [{}, {}, {}]

    def walk(path: str, node: Mapping, depth: int) -> None:
        kids = [(f"{path}/{k}", weight(v), v) for k, v in node.items() if weight(v) > 0]
        out[depth][path] = [(p, w) for p, w, _ in kids]
        for p, _, v in kids:
            if depth < 2:
                walk(p, v, depth + 1)

    walk("", tree, 0)
    if not out[0][""]:
        raise ValueError("the tree has no weight")
    return out


def assign(key: Column, tree: Tree, live: int | None = None) -> Column:
    """The shard number of ``key``, as native expressions over a literal table of children.

    With ``live``, only shards below that number exist; rows of other places are dealt by a flat draw among those.
    """

    def draw(kid: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, kid["c"])), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
        return F.struct((-F.log(u) / kid["w"]).alias("d"), kid["c"].alias("c"))

    def children(kids: list[tuple[str, float]]) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("c"), F.lit(w).alias("w")) for c, w in kids])

    at = F.lit("")
    for level in levels(tree):
        table = F.create_map(*[x for p, kids in level.items() for x in (F.lit(p), children(kids))])
        at = F.array_min(F.transform(F.element_at(table, at), draw))["c"]
    placed = F.element_at(F.split(at, "/"), -1).cast("int")
    if live is None or live >= BASE:
        return placed
    flat = F.array_min(F.transform(children([(f"flat/{s}", 1.0) for s in range(live)]), draw))["c"]
    return let(placed, lambda p: F.when(p < live, p).otherwise(F.element_at(F.split(flat, "/"), -1).cast("int")))


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Slots follow the input order, counted in chunks of 4096 rows, so no task ranks a whole shard.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    raw = F.col(text_col).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        (assign(key, tree) if tree else assign(key, default_tree(shards), shards)).alias("shard"),
        (assign(key, grown) if grown else assign(key, default_tree(shards + 1), shards + 1)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = exclusive_sums(stash(narrow), "row", "one", "slot", partition=["shard"])
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
