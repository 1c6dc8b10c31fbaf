"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Gates use the piecewise linear sigmoid and tanh, so that a step is a table row, one small matrix product and clips. Each
position of a text is labelled from both directions' states; a document's probabilities are the mean over its positions.
Whole texts are read, in windows of ``WINDOW`` bytes that start from a zero state.

The network is fitted on at most ``PER_LANG`` documents of each language, ``PIECES`` windows of each, drawn by hash from
rows outside the held-out fold. Defined results: a null text, or one without a letter, is ``und`` with score 0; without
any labelled row all are ``und``; a null id is never held out and never learned from; repeated rows each get their own
equal result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.batches import bound_batches, pieces
from packloom.plans.stash import small, stash

HIDDEN = 8
WINDOW = 96
PER_LANG, PIECES, MAX_ROWS = 300, 4, 60_000
#: How many times the wanted rows of a language its hash threshold lets through, about.
DRAW = 4
STEPS, BATCH, RATE = 240, 160, 0.02
#: Windows that are run at once.
AT_ONCE = 8192

Params = dict[str, np.ndarray]


def init(classes: int, hidden: int = HIDDEN, seed: int = 1) -> Params:
    r = np.random.default_rng(seed)
    p: Params = {}
    for d in "fb":
        p[f"w{d}"] = r.normal(0, 0.3, (256, 3 * hidden))
        p[f"u{d}"] = r.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))
        p[f"v{d}"] = r.normal(0, 0.3, (hidden, classes))
    p["c"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def states(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The states (time, batch, hidden) over bytes (time, batch); ``keep`` gets what the backward pass needs."""
    hidden = u.shape[0]
    h = np.zeros((x.shape[1], hidden), np.float32)
    out = np.empty((*x.shape, hidden), np.float32)
    for t in range(x.shape[0]):
        g, a = w[x[t]], h @ u
        zr = g[:, : 2 * hidden] + a[:, : 2 * hidden]
        zr *= 0.25
        zr += 0.5
        np.clip(zr, 0, 1, out=zr)
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = g[:, 2 * hidden :] + r * a[:, 2 * hidden :]
        np.clip(n, -1, 1, out=n)
        if keep is not None:
            keep.append((h, z, r, n, a[:, 2 * hidden :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def _back(x: np.ndarray, u: np.ndarray, keep: list, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and the recurrent matrix, through all steps."""
    hidden = u.shape[0]
    dw, du = np.zeros((256, 3 * hidden), np.float32), np.zeros_like(u)
    dh = np.zeros((x.shape[1], hidden), np.float32)
    for t in range(x.shape[0] - 1, -1, -1):
        h, z, r, n, an = keep[t]
        dh = dh + dh_out[t]
        dn = dh * (1 - z) * (np.abs(n) < 1)
        dz = dh * (h - n) * 0.25 * ((z > 0) & (z < 1))
        dr = dn * an * 0.25 * ((r > 0) & (r < 1))
        dg = np.concatenate([dz, dr, dn], axis=1)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        np.add.at(dw, x[t], dg)
        du += h.T @ da
        dh = dh * z + da @ u.T
    return dw, du


def _softmax(o: np.ndarray) -> np.ndarray:
    o = np.exp(o - o.max(axis=-1, keepdims=True))
    return o / o.sum(axis=-1, keepdims=True)


def position_probabilities(p: Params, x: np.ndarray) -> np.ndarray:
    """(time, batch, classes) for bytes (time, batch)."""
    f, b = states(x, p["wf"], p["uf"]), states(x[::-1], p["wb"], p["ub"])[::-1]
    return _softmax(f @ p["vf"] + b @ p["vb"] + p["c"])


def gradients(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """The mean cross entropy over all positions, and its gradients."""
    kf: list = []
    kb: list = []
    f, b = states(x, p["wf"], p["uf"], kf), states(x[::-1], p["wb"], p["ub"], kb)
    q = _softmax(f @ p["vf"] + b[::-1] @ p["vb"] + p["c"])
    m = x.size
    loss = float(-np.log(np.maximum(q[:, np.arange(len(y)), y], 1e-9)).mean())
    do = q
    do[:, np.arange(len(y)), y] -= 1
    do /= m
    flat = do.reshape(m, -1)
    g = {"c": flat.sum(0), "vf": f.reshape(m, -1).T @ flat, "vb": b[::-1].reshape(m, -1).T @ flat}
    g["wf"], g["uf"] = _back(x, p["uf"], kf, do @ p["vf"].T)
    g["wb"], g["ub"] = _back(x[::-1], p["ub"], kb, (do @ p["vb"].T)[::-1])
    return loss, g


def fit(windows: np.ndarray, y: np.ndarray, classes: int, steps: int = STEPS, seed: int = 1) -> Params:
    """Adam on random batches of windows (rows of bytes), each class equally likely."""
    r = np.random.default_rng(seed)
    p = init(classes, seed=seed)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    rows = [np.flatnonzero(y == c) for c in range(classes)]
    for s in range(1, steps + 1):
        at = np.concatenate([r.choice(rows[c], max(1, BATCH // classes)) for c in range(classes)])
        _, g = gradients(p, np.ascontiguousarray(windows[at].T), y[at])
        rate = RATE * min(1.0, 2.0 * (1 - s / (steps + 1)))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k in p:
            v = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**s)) / (np.sqrt(m2[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
    return p


def document_probabilities(p: Params, raws: list[bytes]) -> np.ndarray:
    """The mean position probabilities of each text, all its bytes read."""
    counts = [-(-len(b) // WINDOW) for b in raws]
    owner = np.repeat(np.arange(len(raws)), counts)
    whole = np.full(sum(counts) * WINDOW, 32, np.uint8)
    length = np.zeros(len(owner), int)
    at = 0
    for b, n in zip(raws, counts, strict=True):
        whole[at * WINDOW : at * WINDOW + len(b)] = np.frombuffer(b, np.uint8)
        length[at : at + n] = WINDOW
        if n:
            length[at + n - 1] = len(b) - (n - 1) * WINDOW
        at += n
    whole = whole.reshape(-1, WINDOW)
    total = np.zeros((len(raws), len(p["c"])))
    for s in range(0, len(owner), AT_ONCE):
        q = position_probabilities(p, np.ascontiguousarray(whole[s : s + AT_ONCE].T))
        q = np.where((np.arange(WINDOW)[:, None] < length[None, s : s + AT_ONCE])[..., None], q, 0).sum(axis=0)
        np.add.at(total, owner[s : s + AT_ONCE], q)
    return total / np.maximum(np.array([len(b) for b in raws]), 1)[:, None]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _drawn(rows: DataFrame) -> DataFrame:
    """The ``PER_LANG`` rows of least hash of each language, as (lang, h, x, r).

    Languages are counted first; of a large one only rows below a hash threshold that leaves about ``DRAW`` times as many
    as wanted are ranked, so what is shuffled is bounded by the number of languages, not by rows or tasks. Rows that
    repeat share a hash and are in or out together, so a language of few distinct rows is asked again without a threshold.
    """
    counts = stash(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    n = counts.count()
    least = -float(1 << 63)
    limit = F.when(F.col("n") <= DRAW * PER_LANG, F.lit(float(1 << 63))).otherwise(least + F.lit(float(1 << 64)) * (DRAW * PER_LANG) / F.col("n"))
    first = Window.partitionBy("lang").orderBy("h", "x")

    def ranked(some: DataFrame) -> DataFrame:
        return some.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= PER_LANG).select("lang", "h", "x", "r")

    kept = ranked(rows.join(small(counts.select("lang", limit.alias("limit")), n), "lang").filter(F.col("h") <= F.col("limit")))
    kept = stash(kept)
    short = counts.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("got")), "lang", "left").filter(F.coalesce("got", F.lit(0)) < F.least("n", F.lit(PER_LANG))).select("lang")
    short = stash(short)
    again = short.count()
    if not again:
        return kept
    return kept.join(small(short, again), "lang", "left_anti").unionByName(ranked(rows.join(small(short, again), "lang", "left_semi")))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Params | None]:
    """The languages seen and the fitted network. Only windows of the sampled rows reach the driver."""
    text = F.col(text_col)
    rows = docs.filter(text.isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & (F.length(text) > 0))
    starts = [F.floor(F.greatest(F.length(text) - WINDOW, F.lit(0)) * (i / max(PIECES - 1, 1))).cast("int") + 1 for i in range(PIECES)]
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), text).alias("h"), F.array(*[F.substring(text, s, F.lit(WINDOW)) for s in starts]).alias("x"))
    sample = _drawn(rows).orderBy("r", "lang").select("lang", "h", "x").limit(MAX_ROWS).collect()
    langs = sorted({r["lang"] for r in sample})
    if not langs:
        return [], None
    sample.sort(key=lambda r: (r["lang"], r["h"], r["x"]))
    raw = [(x.encode()[:WINDOW].ljust(WINDOW), langs.index(r["lang"])) for r in sample for x in r["x"]]
    return langs, fit(np.frombuffer(b"".join(b for b, _ in raw), np.uint8).reshape(-1, WINDOW), np.array([y for _, y in raw]), len(langs))


def identify(docs: DataFrame, langs: list[str], params: Params | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, from its text alone."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            raws = [(t or "").encode() if ok and params is not None else b"" for t, ok in zip(b["text"].to_pylist(), b["letters"].to_pylist(), strict=True)]
            q = document_probabilities(params, raws) if params is not None else np.zeros((len(raws), 1))
            best = q.argmax(axis=1)
            pred = [langs[k] if len(r) else "und" for k, r in zip(best, raws, strict=True)]
            score = [min(1.0, float(x[k])) if len(r) else 0.0 for x, k, r in zip(q, best, raws, strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), F.coalesce(F.rlike(F.col(text_col), F.lit(r"\p{L}")), F.lit(False)).alias("letters"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
