"""N-gram Jaccard join: a MinHash LSH forest proposes links, exact Jaccard similarity decides them.

1. Each text becomes its set of five-word shingles (64-bit hashes) and a signature of ``TREES * DEPTH`` minima. Texts
   with equal sets form one class with a representative, so copies are never compared with each other.
2. Each tree labels a signature by ``DEPTH`` minima of its own; sorted labels are the tree's prefix trie. Each row starts
   with the rows of its whole label, and its matched prefix is shortened until the recall estimated from the candidates
   found meets ``TARGET_RECALL``, at the shortest to where a pair at the threshold meets it (``_descend``).
3. Candidate components bring the shingle sets of their members together, where all pairs are verified exactly. In a
   component too large for one task the differences to one pivot set decide most pairs, and the others meet in blocks.
   Links are counted and a spanning forest of true links is emitted, whose components are the classes returned.

No pair list is ever emitted, and no task holds more than two blocks, bounded in rows and in bytes. The work of a
large group grows with its rows, and with the square of those rows only that neither a lead nor a pivot decides.
Words are runs of characters other than U+0020 and U+0009-U+000D, as they stand. Defined results: a text of
one to four words has one shingle, all its words; a null or blank text links to nothing and is its own class; repeated
rows are copies of each other; null ids are kept; of ties the least id names a class; a very long text is hashed in
windows and counts whole; an empty table gives an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm.batches import bound_batches, fresh, pieces, runs
from packloom.llm.components import components, forest
from packloom.plans.stash import exclusive_sums, join_lookup, scratch, small, stash

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 6
TARGET_RECALL = 0.9995
#: A candidate's estimated similarity may lie this far below the threshold: over four standard errors of 96 minima.
SLACK = 0.18
#: The share of its minima in which a row may differ from the lead that goes on for it.
CLOSE = 0.06
#: Rows, and bytes of shingles, of a block.
BLOCK, BLOCK_BYTES = 512, 4 << 20

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_TABLE: dict[int, np.ndarray] = {}


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first ``n`` powers, from a table that grows as needed."""
    have = _TABLE.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16) + 1, _U(base))
        have[0] = 1
        have = _TABLE[base] = np.multiply.accumulate(have)
    return have[:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial over the bytes."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, _U)
    word = ~_BLANK[b]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, _U)
    sums = np.zeros(len(b) + 1, _U)
    longest = 1 << 16
    if len(b) <= longest:
        p = _powers(len(b))
        np.cumsum((b.astype(_U) + _U(1)) * p[::-1], out=sums[1:])  # bring each word to one power below
        h = (sums[end] - sums[start]) * _powers(len(b) + 1, _INVERSE)[len(b) - end]
    else:  # powers would be as long as the text: take windows of it that end between words
        parts, at = [], 0
        while at < len(start):
            stop = max(int(np.searchsorted(start, start[at] + longest - 1, side="right")) - 1, at + 1)
            lo, hi = int(start[at]), int(end[stop - 1])
            if hi - lo > longest:
                parts.append(np.array([_long_word(b[s:e]) for s, e in zip(start[at:stop], end[at:stop], strict=True)], _U))
            else:
                parts.append(word_hashes(raw[lo:hi]))
            at = stop
        return np.concatenate(parts)
    return _mix(h ^ (end - start).astype(_U))


def _long_word(b: np.ndarray) -> int:
    p = _powers(len(b))
    h = np.sum((b.astype(_U) + _U(1)) * p[::-1], dtype=_U)
    return _mix(np.array([h ^ _U(len(b))], _U))[0]


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes((text or "").encode())
    if not len(w):
        return w
    n = max(len(w) - width + 1, 1)
    h = np.zeros(n, _U)
    for k in range(min(width, len(w))):
        h = _mix(h * _U(3) + w[k : k + n] + _U(k + 1))
    return np.unique(h)


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 1 << 63, n, dtype=_U) * _U(2) + _U(1), r.integers(0, 1 << 63, n, dtype=_U)


def signature(sh: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The high halves of the minima of each hash over a set."""
    a, b = family
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(sh), 2048):
        h = ((sh[i : i + 2048, None] * a[None, :] + b[None, :]) >> _U(32)).astype(np.uint32)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that two sets of this similarity share a prefix of ``depth`` minima in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Shorten the matched prefix until a pair at the threshold is found with the target recall."""
    depth = DEPTH
    while depth > 1 and recall(threshold, depth) < target:
        depth -= 1
    return depth


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _hash_family(TREES * DEPTH)
        for b in pieces(batches):
            n, s1, s2, sig = [], [], [], []
            for t in b["text"].to_pylist():
                sh = shingles(t)
                n.append(len(sh))
                # two independent sums name the set
                s1.append(int(np.sum(_mix(sh), dtype=_U).astype(np.int64)) if len(sh) else 0)
                s2.append(int(np.sum(_mix(sh ^ _U(0xA5A5A5A5DEADBEEF)), dtype=_U).astype(np.int64)) if len(sh) else 0)
                sig.append(signature(sh, family).tobytes() if len(sh) else None)
            yield pa.RecordBatch.from_arrays([b["id"], b["content"], pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary())], names=["id", "content", "n", "s1", "s2", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("content"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, content long, n int, s1 long, s2 long, sig binary")


def _grouped(rows: DataFrame, keys: list[str], body: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """Apply ``body`` to each run of equal keys, sorted by ``order``; small groups cost no Spark group of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        count = 0
        for table in runs(batches, keys):
            if (out := body(table)) is not None and out.num_rows:
                made.append(out)
                count += out.num_rows
            if count > 10_000:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made, count = [], 0
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def _descend(table: pa.Table, least: float, floor: int, target: float) -> pa.RecordBatch | None:
    """Candidate links of one subtrie: rows that share ``floor`` minima of a tree, sorted by the tree's whole label.

    Every row starts with the run of rows that share its whole label. Candidates are rows whose signatures agree in
    ``least`` or more. A row's recall is estimated from them: one of similarity s is found in some tree with the chance
    ``recall(s, depth)``, so found over the sum of the inverse chances is the share found. While that is under ``target``,
    or nothing is found, the matched prefix is shortened by one minimum.

    The estimate knows nothing of partners less alike than those found, so a row that meets the target stops only beside
    a lead: a candidate of its run within ``CLOSE`` of it that goes on to the shortest prefix. Whoever shares that prefix
    with the row shares it with the lead, and agrees with the lead in at most ``CLOSE`` fewer of the minima. Gives a
    spanning forest of the links.
    """
    n = table.num_rows
    if n < 2:
        return None
    rep = table["rep"].to_numpy()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(n, -1)
    if n == 2:
        if np.count_nonzero(sig[0] == sig[1]) < least * sig.shape[1]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(rep[1:]), pa.array(rep[:1])], names=["a", "b"])
    label = np.frombuffer(b"".join(table["label"].to_pylist()), np.uint32).reshape(n, -1)
    splits = label[1:] != label[:-1]
    going, lead, met = np.ones(n, bool), np.zeros(n, bool), np.zeros(n, int)
    ea, eb = [], []
    for depth in range(DEPTH, floor - 1, -1):
        ends = [0, *(np.flatnonzero(splits[:, :depth].any(axis=1)) + 1).tolist(), n]
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            mine = s + np.flatnonzero(going[s:e])
            mine = mine[~lead[mine] | (met[mine] < e - s)]  # runs nest, so one of equal size holds the same rows
            if e - s < 2 or not len(mine):
                continue
            agree = np.stack([np.count_nonzero(sig[s:e] == sig[i], axis=1) for i in mine]) / sig.shape[1]
            hit = agree >= least
            hit[np.arange(len(mine)), mine - s] = False
            i, j = np.nonzero(hit)
            ea.append(mine[i])
            eb.append(s + j)
            met[mine] = e - s
            asks = ~lead[mine]
            if not asks.any():
                continue
            mine, agree, hit = mine[asks], agree[asks], hit[asks]
            chance = recall(np.maximum(agree, THRESHOLD), depth)
            found, all_of = hit.sum(axis=1), np.where(hit, 1 / chance, 0).sum(axis=1)
            close = hit & (agree >= 1 - CLOSE)
            for x in np.flatnonzero((found > 0) & (found >= target * all_of) & close.any(axis=1)):
                beside = s + np.flatnonzero(close[x])
                beside = beside[going[beside]]
                if lead[mine[x]] or not len(beside):
                    continue
                if not lead[beside].any():
                    lead[beside[0]] = True
                going[mine[x]] = False
    return _forest_of(rep, ea, eb)


def _forest_of(rep: np.ndarray, ea: list, eb: list) -> pa.RecordBatch | None:
    if not ea:
        return None
    root = forest(len(rep), np.concatenate(ea).astype(int), np.concatenate(eb).astype(int))
    keep = np.flatnonzero(root != np.arange(len(rep)))
    if not len(keep):
        return None
    return pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(rep[root[keep]])], names=["a", "b"])


def _open_pairs(rows: DataFrame, group: str, block: Column) -> DataFrame:
    """Deal rows (``group``, ``rep``, ``open``) of each group into blocks and give each row the block pairs (bi <= bj) it
    takes part in, so that each open row meets every other row once; two rows that aren't open never meet.

    ``block`` is the number of blocks that a group's rows of one kind take, given as an aggregate expression.
    """
    sizes = rows.groupBy(group, "open").agg(block.cast("int").alias("nb"))
    sizes = stash(sizes.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("open"), F.col("nb"))), F.lit(0)).alias("n_open"), F.coalesce(F.max(F.when(~F.col("open"), F.col("nb"))), F.lit(0)).alias("n_shut"), F.count(F.lit(1)).alias("kinds")).filter("n_open > 0"))
    n = sizes.count()
    rows = rows.join(small(sizes.drop("kinds"), n), group)
    draw = lambda k: F.pmod(F.xxhash64("rep", group), F.greatest(F.col(k), F.lit(1)).cast("long")).cast("int")
    rows = rows.withColumn("own", F.when(F.col("open"), draw("n_open")).otherwise(F.col("n_open") + draw("n_shut")))
    others = F.when(F.col("open"), F.col("n_open") + F.col("n_shut")).otherwise(F.col("n_open"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return rows.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("n_open", "n_shut", "other")


def _met_edges(table: pa.Table, least: float) -> pa.RecordBatch | None:
    """A spanning forest of the pairs of one block pair, with an open row each, whose signatures agree enough."""
    n = table.num_rows
    if n < 2:
        return None
    rep, own, going = (table[c].to_numpy() for c in ("rep", "own", "open"))
    bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(n, -1)
    right = np.flatnonzero(own == bj)
    ea, eb = [], []
    for i in np.flatnonzero((own == bi) & going):
        hit = right[np.count_nonzero(sig[right] == sig[i], axis=1) >= least * sig.shape[1]]
        ea.append(np.full(len(hit), i))
        eb.append(hit)
    return _forest_of(rep, ea, eb)


def _starred(rows: DataFrame) -> DataFrame:
    """Add ``far``, the number of minima in which a row's signature and its lead's differ, in place of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, lead = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sig", "lead_sig"))
            yield pa.RecordBatch.from_arrays([b["prefix"], b["rep"], b["lead"], pa.array(np.count_nonzero(sig != lead, axis=1).astype(np.int32))], names=["prefix", "rep", "lead", "far"])

    return rows.select("prefix", "rep", "lead", "sig", "lead_sig").mapInArrow(run, "prefix long, rep long, lead long, far int")


def candidates(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between sets (rep, sig) that may be similar, as spanning forests, from a forest of prefix tries.

    Rows are dealt to subtries by the shortest prefix that the target recall can ask for. A subtrie of more than
    ``BLOCK`` rows is not brought together: its rows read the signature of one lead row. Those that agree with it hang on
    it and are done, as at the shortest prefix even a pair at the threshold meets the target. A row that differs from the
    lead in too many minima stays open; by the triangle inequality only rows whose own differences are at most as many
    fewer can agree with it, and it meets just these, in blocks.
    """
    floor, least = prefix_depth(threshold), threshold - SLACK
    most = int((1 - least) * TREES * DEPTH)
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("sig"), t * (4 * DEPTH) + 1, F.lit(4 * floor))))
    leaves = sets.select("rep", F.posexplode(keys).alias("tree", "prefix"))
    met = stash(leaves.groupBy("prefix").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("lead")).filter("members > 1"))
    rows = join_lookup(leaves, met, "prefix", "members", TREES * sets.count())
    few = rows.filter(F.col("members") <= BLOCK).join(sets.select("rep", "sig"), "rep")
    few = few.select("prefix", "rep", "sig", F.substring(F.col("sig"), F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("label"))
    edges = _grouped(few, ["prefix"], lambda t: _descend(t, least, floor, TARGET_RECALL), "a long, b long", ["label"])
    hot = met.filter(F.col("members") > BLOCK)
    if hot.isEmpty():
        return edges
    hot = stash(hot.join(sets.select(F.col("rep").alias("lead"), F.col("sig").alias("lead_sig")), "lead"))
    total = hot.agg(F.sum("members")).first()[0]
    hot_rows = join_lookup(rows.filter(F.col("members") > BLOCK).select("prefix", "rep"), hot, "prefix", "members", total).join(sets.select("rep", "sig"), "rep")
    star = stash(_starred(hot_rows))
    edges = edges.unionByName(star.filter((F.col("far") <= most) & (F.col("rep") != F.col("lead"))).select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    low = stash(star.filter(F.col("far") > most).groupBy("prefix").agg((F.min("far") - most).alias("low")))
    n = low.count()
    if not n:
        return edges
    left = star.join(small(low, n), "prefix").filter("far >= low").select("prefix", "rep", (F.col("far") > most).alias("open"))
    left = _open_pairs(left, "prefix", F.ceil(F.count(F.lit(1)) / BLOCK)).join(sets.select("rep", "sig"), "rep")
    return edges.unionByName(_grouped(left, ["prefix", "bi", "bj"], lambda t: _met_edges(t, least), "a long, b long"))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections."""
    n = len(sets)
    common = np.zeros((n, n), np.float32)
    if n <= 4:
        for i in range(n):
            for j in range(i):
                common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return common.astype(np.int64)
    # shingles held by two members or more, as columns of 0/1 matrices
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    who, col = who[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    width = 4096
    top = int(col[-1]) + 1 if len(col) else 0
    exact = np.zeros((n, n), np.int64)
    for c in range(0, top, width):
        lo, hi = np.searchsorted(col, [c, c + width])
        x = np.zeros((n, width), np.float32)
        x[who[lo:hi], col[lo:hi] - c] = 1
        exact += (x @ x.T).astype(np.int64)
    return exact


def _once(table: pa.Table) -> pa.Table:
    """One row of each rep: rows equal in id and text may come from several tasks."""
    rep = table["rep"].to_numpy()
    if len(np.unique(rep)) == len(rep):
        return table
    return table.take(pa.array(np.sort(np.unique(rep, return_index=True)[1])))


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    lengths = np.array([len(s) for s in sets])
    common = _common(sets)
    union = lengths[:, None] + lengths[None, :] - common
    # in whole numbers, so that the threshold itself counts: 1000 * common >= 800 * union
    linked = 1000 * common >= round(1000 * threshold) * union
    np.fill_diagonal(linked, False)
    return linked


def _rooted(rep: np.ndarray, linked: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    links = linked @ size.astype(np.float64)
    root = forest(len(rep), *np.nonzero(linked))
    keep = np.flatnonzero(links > 0)
    return pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(rep[root[keep]]), pa.array(links[keep].astype(np.int64))], names=["rep", "root", "links"])


def _verified(table: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Exact links of one candidate component: each member's linked copies, and a spanning forest."""
    table = _once(table)
    if table.num_rows < 2:
        return None
    linked = _linked([np.frombuffer(x, _U) for x in table["sh"].to_pylist()], threshold)
    return _rooted(table["rep"].to_numpy(), linked, table["copies"].to_numpy())


def _verified_open(table: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Exact links of one block pair of a large component, between rows whose keys leave them undecided."""
    table = _once(table)
    if table.num_rows < 2:
        return None
    own, key = table["own"].to_numpy(), table["key"].to_numpy()
    bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
    linked = _linked([np.frombuffer(x, _U) for x in table["sh"].to_pylist()], threshold)
    linked &= key[:, None] + key[None, :] > 0
    allowed = (own == bi)[:, None] & (own == bj)[None, :]
    linked &= allowed | allowed.T
    return _rooted(table["rep"].to_numpy(), linked, table["copies"].to_numpy())


def _to_pivot(table: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """(comp, rep, copies, key) of the rows that meet their component's pivot: key is 1000 + t times the symmetric
    difference to the pivot less 1000 - t times the row's size, for a threshold of t thousandths."""
    is_pivot = table["pivot"].to_numpy(zero_copy_only=False)
    if not is_pivot.any():
        return None
    pivot = np.frombuffer(table["sh"][int(np.flatnonzero(is_pivot)[0])].as_py(), _U)
    rows = _once(table.filter(pa.array(~is_pivot)))
    t = round(1000 * threshold)
    keys = []
    for x in rows["sh"].to_pylist():
        own = np.frombuffer(x, _U)
        both = len(np.intersect1d(own, pivot, assume_unique=True))
        keys.append((1000 + t) * (len(own) + len(pivot) - 2 * both) - (1000 - t) * len(own))
    return pa.RecordBatch.from_arrays([*[rows[c].combine_chunks() for c in ("comp", "rep", "copies")], pa.array(keys, pa.int64())], names=["comp", "rep", "copies", "key"])


def _large_components(shipped: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(rep, root, links) of components too large for one task, exactly, without comparing all their pairs.

    Two sets are similar if (1000 + t) D <= (1000 - t) S, with D the size of their symmetric difference and S the sum of
    their sizes. D is at most the sum of their differences to a third set, the pivot, so they are similar if their keys
    (``_to_pivot``) sum to at most 0. How many rows that certainly links a row with is a running sum over the keys of
    its component. What is left are pairs in which one key at least is above 0; these rows meet, in blocks, the rows whose
    keys are above the negated greatest one. The pivot is the set with the most copies.
    """
    pivots = stash(members.groupBy("comp").agg(F.max_by("rep", F.struct("copies", -F.col("rep"))).alias("pivot_rep"), F.first("nb").alias("nb"), F.max_by("n", F.struct("copies", -F.col("rep"))).alias("pivot_n")))
    k = pivots.count()
    shipped = stash(shipped.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("nb").cast("long")).cast("int")))
    leads = shipped.join(small(pivots.select(F.col("comp").alias("c"), "pivot_rep"), k), (F.col("comp") == F.col("c")) & (F.col("rep") == F.col("pivot_rep")))
    leads = leads.select("comp", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("salt"), "rep", "copies", "sh", F.lit(True).alias("pivot"))
    both = shipped.select("comp", "salt", "rep", "copies", "sh", F.lit(False).alias("pivot")).unionByName(leads)
    keyed = stash(_grouped(both, ["comp", "salt"], lambda t: _to_pivot(t, threshold), "comp long, rep long, copies long, key long"))
    keyed = stash(keyed.dropDuplicates(["rep"]))
    counts = keyed.groupBy("comp", "key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    points = counts.select("comp", "key", "copies", F.lit(0).cast("long").alias("rows")).unionByName(counts.select("comp", (-F.col("key")).alias("key"), F.lit(0).cast("long").alias("copies"), "rows"))
    points = points.groupBy("comp", "key").agg(F.sum("copies").alias("copies"), F.sum("rows").alias("rows"))
    sums = exclusive_sums(points, "key", "copies", "before", partition=["comp"])
    sums = stash(sums.select(F.struct("comp", "key").alias("at"), (F.col("before") + F.col("copies")).alias("upto"), "rows").filter("rows > 0"))
    ends = keyed.groupBy("comp").agg(F.max("key").alias("top"), F.min("key").alias("bottom"), F.min_by("rep", F.struct("key", "rep")).alias("bottom_rep"), F.count(F.lit(1)).alias("rows"))
    ends = stash(ends.join(pivots.select("comp", "pivot_rep", "pivot_n"), "comp"))
    total = keyed.count()
    rows = join_lookup(keyed.withColumn("at", F.struct("comp", (-F.col("key")).alias("key"))), sums, "at", "rows", total).drop("at", "rows")
    rows = join_lookup(rows, ends, "comp", "rows", total).drop("rows")
    t = round(1000 * threshold)
    own = F.when(F.col("key") <= 0, F.col("copies")).otherwise(0)
    root = F.when(F.col("key") <= (1000 - t) * F.col("pivot_n"), F.col("pivot_rep")).when(F.col("key") + F.col("bottom") <= 0, F.col("bottom_rep")).otherwise(F.col("rep"))
    certain = rows.select("rep", root.alias("root"), (F.col("upto") - own).alias("links"))
    # the rows of undecided pairs
    left = rows.filter(F.col("key") > -F.col("top")).filter("top > 0").select("comp", "rep", "key", (F.col("key") > 0).alias("open"))
    left = stash(left)
    m = left.count()
    if not m:
        return certain
    sizes = stash(left.join(shipped.select("rep", F.length("sh").alias("bytes")).dropDuplicates(["rep"]), "rep"))
    pairs = _open_pairs(sizes, "comp", F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES))).drop("bytes")
    pairs = pairs.join(shipped.select("rep", "copies", "sh"), "rep")
    return certain.unionByName(_grouped(pairs, ["comp", "bi", "bj"], lambda x: _verified_open(x, threshold), "rep long, root long, links long"))


def _links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(rep, root, links) of sets in candidate components, each component verified exactly."""
    n = members.count()
    if not n:
        return docs.sparkSession.createDataFrame([], "rep long, root long, links long")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("content"), F.col(text_col).alias("text"))
    wanted = members.select("rep", "comp", "nb", "copies", F.col("pick.id").alias("pid"), F.col("pick.content").alias("pc"))
    text = text.join(small(wanted, n), (F.col("content") == F.col("pc")) & F.col("id").eqNullSafe(F.col("pid")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches):
            new = [i for i, r in enumerate(b["rep"].to_pylist()) if r not in seen and not seen.add(r)]
            if new:
                b = b.take(pa.array(new))
                sh = pa.array([shingles(t).tobytes() for t in b["text"].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b[k] for k in ("rep", "comp", "nb", "copies")], sh], names=["rep", "comp", "nb", "copies", "sh"])

    shipped = text.select("rep", "comp", "nb", "copies", "text").mapInArrow(sets_of, "rep long, comp long, nb int, copies long, sh binary")
    large = members.filter("nb > 1")
    if large.isEmpty():
        return _grouped(shipped, ["comp"], lambda t: _verified(t, threshold), "rep long, root long, links long")
    shipped = stash(shipped)
    found = _grouped(shipped.filter("nb = 1"), ["comp"], lambda t: _verified(t, threshold), "rep long, root long, links long")
    return found.unionByName(_large_components(shipped.filter("nb > 1"), large, threshold))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, content, class_id, n_links, copies, comp) of every row; comp names the class, null for a blank text.

    ``class_id`` is the least id of the row's connected component; ``n_links`` counts the other rows of similarity
    ``threshold`` or more, copies included; ``content`` is xxhash64 of the text.
    """
    # equal sets: one representative, named by the hash pair so that null or repeated ids do no harm
    name = F.xxhash64("s1", "s2", "n")
    with scratch(docs.sparkSession):
        signed = stash(_signed(docs, id_col, text_col), outer=True)
        sets = signed.filter("n > 0").groupBy(name.alias("rep")).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.min_by(F.struct("id", "content"), F.struct("id", "content")).alias("pick"))
        sets = stash(sets)
        members = components(candidates(sets, threshold))
        sizes = members.withColumnRenamed("id", "rep").join(sets.select("rep", "n"), "rep").groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("n") * 8).alias("bytes"))
        sizes = stash(sizes.withColumn("nb", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")))
        members = stash(join_lookup(members.withColumnRenamed("id", "rep"), sizes, "comp", "members", members.count()).join(sets.select("rep", "n", "copies", "pick"), "rep"))
        found = stash(_links(docs, members, id_col, text_col, threshold))
        true = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        named = sets.select("rep", "copies", "least").join(links, "rep", "left").join(true.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        named = stash(named)
        lowest = stash(named.groupBy("comp").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("in_class")))
        named = join_lookup(named, lowest, "comp", "in_class", named.count()).select("rep", "comp", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        named = stash(named, outer=True)
    out = signed.select("id", "content", F.when(F.col("n") > 0, name).alias("rep")).join(named, "rep", "left")
    return out.select(F.col("id").alias(id_col), "content", F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"), "comp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each class: the least id, then the least hash of the text.

    Blank texts stay. Of rows equal in id and text one stays. Columns may have any name.
    """
    with scratch(docs.sparkSession):
        pairs = classes(docs, id_col, text_col).select(F.col(id_col).alias("id"), "content", "comp")
        pairs = stash(pairs.groupBy("id", "content", "comp").agg(F.count(F.lit(1)).alias("times")))
        stays = stash(pairs.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "content")).alias("first"), F.count(F.lit(1)).alias("in_class")))
        goes = join_lookup(pairs, stays, "comp", "in_class", pairs.count()).filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("content") == F.col("first.content"))))
        mark = fresh(docs, "goes")
        goes = stash(goes.select(F.struct("id", "content").alias(mark)), outer=True)
        n = goes.count()
        repeated = not pairs.filter("times > 1").isEmpty()
    same = (F.xxhash64(F.col(text_col)) == F.col(f"{mark}.content")) & F.col(id_col).cast("long").eqNullSafe(F.col(f"{mark}.id"))
    out = docs.join(small(goes, n), same, "left_anti")
    return out.dropDuplicates([id_col, text_col]) if repeated else out
