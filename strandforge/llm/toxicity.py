"""Toxicity: a bidirectional gated recurrent network with attention pooling, over characters and words, in numpy.

A word's input is an embedding of the word plus the mean of those of its character 4-grams and its prefix. Two gated
recurrent layers read windows of WINDOW words, one from either end; attention pools their states to one logit. Windows overlap by
half and cover the whole text. A text's score comes from its two highest logits and their number, by a logistic map fitted on texts
that the network was not trained on.

Training takes a bounded sample of the labelled rows (MOST of each label, by a hash of doc_id, of up to LONGEST characters) to one task,
which goes through it by slices; the driver gets the network only. Labels belong to texts, not to windows: after one pass over random windows, each pass trains on every text's highest window.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import word_bounds
from .shared import in_slices, ragged, read, slice_hashes

WINDOW, STRIDE = 32, 16
BUCKETS, WIDTH, HIDDEN = 1 << 15, 16, 8
#: Labelled texts of each label that training takes at most, and the longest text it takes, in characters.
MOST = {1: 1500, 0: 3000}
LONGEST = 30_000
PASSES, BATCH, RATE, DECAY, SEED = 7, 128, 0.01, 1e-5, 7
#: Share of the distinct words of a batch whose own embedding training leaves out.
UNKNOWN = 0.5
THRESHOLD = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATES = np.ones(256, bool)
_SEPARATES[48:58] = _SEPARATES[97:123] = _SEPARATES[128:] = False


@dataclass
class Words:
    """The words of texts: the distinct ones with their n-grams, which of them each word is, and each text's number of words."""

    word: np.ndarray
    gram: np.ndarray
    grams: np.ndarray
    of: np.ndarray
    count: np.ndarray


def words_of(data: np.ndarray, off: np.ndarray) -> Words:
    data = _LOWER[data]
    start, end, doc = word_bounds(_SEPARATES[data], off)
    count = np.bincount(doc, minlength=len(off) - 1)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, count)
    h, one, of = np.unique(slice_hashes(data, start, end), return_index=True, return_inverse=True)
    start, size = start[one], end[one] - start[one]
    framed = np.full(int((size + 2).sum()), 32, np.uint8)  # a blank on either side of each word
    at = np.cumsum(size + 2) - size - 2
    framed[ragged(at + 1, size)] = data[ragged(start, size)]
    fours = np.maximum(size - 1, 1)
    begin = np.concatenate([ragged(at, fours), at])
    whose = np.concatenate([np.repeat(np.arange(len(h)), fours), np.arange(len(h))])
    stop = np.minimum(begin + np.where(np.arange(len(begin)) < fours.sum(), 4, 7), (at + size + 2)[whose])
    gram = (slice_hashes(framed, begin, stop) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(whose, kind="stable")
    return Words((h % np.uint64(BUCKETS)).astype(np.int64), gram[order], fours + 1, of, count)


def windows_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of each window; a text without words has one empty window."""
    per = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(count)), per)
    shift = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    return (np.cumsum(count) - count)[text] + shift, np.minimum(WINDOW, count[text] - shift), text


def new_network() -> dict[str, np.ndarray]:
    g = np.random.default_rng(SEED)
    draw = lambda *shape, s: (g.standard_normal(shape) * s).astype(np.float32)
    return {
        "word": draw(BUCKETS, WIDTH, s=0.1), "gram": draw(BUCKETS, WIDTH, s=0.1), "in": draw(2, WIDTH, 3 * HIDDEN, s=0.25), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        "back": draw(2, HIDDEN, 3 * HIDDEN, s=0.3), "look": draw(2 * HIDDEN, s=0.3), "out": draw(2 * HIDDEN, s=0.3), "shift": np.zeros(1, np.float32),
    }


def inputs(net: dict, w: Words, which: np.ndarray | None = None) -> np.ndarray:
    """The input vectors of the distinct words (or of some of them)."""
    gram, grams, word = w.gram, w.grams, w.word
    if which is not None:
        begin = np.cumsum(grams) - grams
        gram, grams, word = gram[ragged(begin[which], grams[which])], grams[which], word[which]
    if not len(word):
        return np.zeros((0, WIDTH), np.float32)
    total = np.add.reduceat(net["gram"][gram], np.cumsum(grams) - grams)
    return net["word"][word] + total / grams[:, None].astype(np.float32)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(net: dict, x: np.ndarray, index: np.ndarray, real: np.ndarray, keep: bool = False):
    """The logits of windows. x: input vectors; index: [windows, WINDOW] into x; real: which places hold a word."""
    n = len(index)
    gates = np.matmul(x[None], net["in"]) + net["bias"]
    h, hs, trace = np.zeros((2, n, HIDDEN), np.float32), np.empty((2, WINDOW, n, HIDDEN), np.float32), []
    for t in range(WINDOW):
        u = WINDOW - 1 - t
        g = np.stack([gates[0][index[:, t]], gates[1][index[:, u]]])
        m = np.stack([real[:, t], real[:, u]])[..., None]
        r = np.matmul(h, net["back"])
        zr = _squash(g[..., : 2 * HIDDEN] + r[..., : 2 * HIDDEN])
        z, q = zr[..., :HIDDEN], zr[..., HIDDEN:]
        c = np.tanh(g[..., 2 * HIDDEN :] + q * r[..., 2 * HIDDEN :])
        after = h + m * (1 - z) * (c - h)
        if keep:
            trace.append((h, z, q, c, r[..., 2 * HIDDEN :], m))
        h = after
        hs[0, t], hs[1, u] = h[0], h[1]
    both = np.concatenate([hs[0], hs[1]], axis=-1)
    look = both @ net["look"] + (real.T - 1) * np.float32(1e9)
    look = np.exp(look - look.max(0))
    a = look / look.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, both)
    logit = pooled @ net["out"] + net["shift"][0]
    return (logit, (both, a, pooled, trace)) if keep else logit


def gradients(net: dict, x: np.ndarray, index: np.ndarray, real: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weighted log loss for all weights, and for x."""
    logit, (both, a, pooled, trace) = forward(net, x, index, real, keep=True)
    n, two = len(index), 2 * HIDDEN
    d = ((_squash(logit) - label) * weight / n).astype(np.float32)
    grad = {"shift": d.sum(keepdims=True), "out": pooled.T @ d}
    d_pool = d[:, None] * net["out"]
    d_a = np.einsum("nh,tnh->tn", d_pool, both)
    d_look = a * (d_a - (a * d_a).sum(0))
    grad["look"] = np.einsum("tn,tnh->h", d_look, both)
    d_both = a[..., None] * d_pool + d_look[..., None] * net["look"]
    d_h = np.zeros((2, n, HIDDEN), np.float32)
    d_gates = np.zeros((2, len(x), 3 * HIDDEN), np.float32)
    d_back = np.zeros_like(net["back"])
    for t in reversed(range(WINDOW)):
        u = WINDOW - 1 - t
        h, z, q, c, r, m = trace[t]
        d_h = d_h + np.stack([d_both[t][:, :HIDDEN], d_both[u][:, HIDDEN:]])
        d_c = d_h * m * (1 - z) * (1 - c * c)
        d_z = -d_h * m * (c - h) * z * (1 - z)
        d_q = d_c * r * q * (1 - q)
        d_g = np.concatenate([d_z, d_q, d_c], axis=-1)
        d_r = np.concatenate([d_z, d_q, d_c * q], axis=-1)
        np.add.at(d_gates[0], index[:, t], d_g[0])
        np.add.at(d_gates[1], index[:, u], d_g[1])
        d_back += np.matmul(h.transpose(0, 2, 1), d_r)
        d_h = d_h * (1 - m * (1 - z)) + np.matmul(d_r, net["back"].transpose(0, 2, 1))
    assert two == d_both.shape[-1]
    grad["back"] = d_back
    grad["in"] = np.matmul(x.T[None], d_gates)
    grad["bias"] = d_gates.sum(1, keepdims=True)
    return grad, np.einsum("kdg,kwg->dw", d_gates, net["in"])


def _index(w: Words, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    real = np.arange(WINDOW) < size[:, None]
    at = np.where(real, first[:, None] + np.arange(WINDOW), 0)
    return (w.of[at] if len(w.of) else np.zeros(at.shape, np.int64)), real.astype(np.float32)


def logits(net: dict, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The logit and the text of every window."""
    first, size, text = windows_of(w.count)
    x = inputs(net, w)
    x = x if len(x) else np.zeros((1, WIDTH), np.float32)
    out = [forward(net, x, *_index(w, first[at : at + 2048], size[at : at + 2048])) for at in range(0, len(first), 2048)]
    return np.concatenate([*out, np.zeros(0, np.float32)]), text


def summary(logit: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """A text's highest logit, its second highest (the highest again if there is but one) and the logarithm of its number of windows."""
    order = np.lexsort((-logit, text))
    per = np.bincount(text, minlength=texts)
    at = np.cumsum(per) - per
    z = logit[order].astype(np.float64)
    return np.stack([z[at], z[at + np.minimum(1, per - 1)], np.log(per)], axis=1)


def _adam(moment: list[np.ndarray], rows, grad: np.ndarray, step: int) -> np.ndarray:
    """What to take off these rows of the weights."""
    for m, x, keep in ((moment[0], grad, 0.9), (moment[1], grad * grad, 0.999)):
        m[rows] = keep * m[rows] + (1 - keep) * x
    return RATE * (moment[0][rows] / (1 - 0.9**step)) / (np.sqrt(moment[1][rows] / (1 - 0.999**step)) + 1e-8)


def _together(parts: list[Words]) -> Words:
    """The words of several slices as one; a word that two slices have is there twice."""
    shift = np.cumsum([0] + [len(w.word) for w in parts])
    gather = lambda x: np.concatenate([np.zeros(0, np.int32), *x])
    return Words(
        gather([w.word.astype(np.int32) for w in parts]), gather([w.gram.astype(np.int32) for w in parts]), gather([w.grams.astype(np.int32) for w in parts]),
        gather([(w.of + k).astype(np.int32) for w, k in zip(parts, shift)]), np.concatenate([np.zeros(0, np.int64), *[w.count for w in parts]]),
    )


def train(texts: list[bytes], label: np.ndarray, share: float | None = None) -> dict[str, np.ndarray]:
    """A network fitted to labelled texts. share: the share of label 1 where the scores will be used."""
    g = np.random.default_rng(SEED)
    net, parts = new_network(), []
    for at in range(0, len(texts), 200):
        some = texts[at : at + 200]
        parts.append(words_of(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0] + [len(t) for t in some], dtype=np.int64)))
    all_logits = lambda: np.concatenate([np.zeros(0, np.float32), *[logits(net, p)[0] for p in parts]])
    w = _together(parts)
    first, size, text = windows_of(w.count)
    texts = len(label)
    fit = g.random(texts) < 0.8
    per = np.bincount(text, minlength=texts)
    at = np.cumsum(per) - per
    begin = np.cumsum(w.grams) - w.grams
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}
    step = 0
    for lap in range(PASSES if len(w.of) else 0):
        if lap:
            order = np.lexsort((-all_logits(), text))
            chosen = order[at]
            second = order[at + np.minimum(g.integers(0, 3, texts), per - 1)]
        else:
            chosen = at + (g.random(texts) * per).astype(np.int64)
            second = at + (g.random(texts) * per).astype(np.int64)
        pool = np.concatenate([chosen[fit], second[fit & (label == 0)]])
        pool = pool[g.permutation(len(pool))]
        for b in range(0, len(pool), BATCH):
            part = pool[b : b + BATCH]
            index, real = _index(w, first[part], size[part])
            which, index = np.unique(index, return_inverse=True)
            index = index.reshape(len(part), WINDOW)
            known = (g.random(len(which)) >= UNKNOWN).astype(np.float32)[:, None]  # the rest is judged by its characters alone
            x = inputs(net, w, which) - (1 - known) * net["word"][w.word[which]]
            grad, d_x = gradients(net, x, index, real, label[text[part]], np.where(label[text[part]] == 1, 2.0, 1.0))
            grams = w.grams[which]
            spread = np.repeat(d_x / grams[:, None], grams, axis=0)
            step += 1
            for k, at_rows, d in (("word", w.word[which], d_x * known), ("gram", w.gram[ragged(begin[which], grams)], spread)):
                rows, to = np.unique(at_rows, return_inverse=True)
                total = np.zeros((len(rows), WIDTH), np.float32)
                np.add.at(total, to, d)
                moved = _adam(moment[k], rows, total + DECAY * net[k][rows], step)
                net[k][rows] -= moved
            for k in grad:
                net[k] -= _adam(moment[k], slice(None), grad[k].astype(np.float32), step)
    f = summary(all_logits(), text, texts)
    held = ~fit if 0 < label[~fit].sum() < (~fit).sum() else np.ones(texts, bool)
    mean = float(label[held].mean()) if held.any() else 0.5
    share = mean if share is None else share
    weight = np.where(label[held] == 1, share / max(mean, 1e-9), (1 - share) / max(1 - mean, 1e-9))
    x, y = np.column_stack([np.clip(f[held], -20, 20), np.ones(held.sum())]), label[held]
    c = np.zeros(4)
    for _ in range(50):  # Newton's method, with a small ridge
        p = _squash(x @ c)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.diag([1, 1, 1, 0.01])
        c -= np.linalg.solve(hess, x.T @ (weight * (p - y)) + 0.5 * c * [1, 1, 1, 0.01])
    return net | {"map": c}


def scores(net: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The score, 0 to 1, of every text."""
    f = summary(*logits(net, words_of(data, off)), len(off) - 1)
    return _squash(np.column_stack([np.clip(f, -20, 20), np.ones(len(f))]) @ net["map"])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """A network fitted to the labelled rows that aren't held out. Null labels, ids and texts don't take part; of several labels of a
    doc_id the largest counts. Without rows of both labels the network is fitted to what there is."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in MOST.items()]
    ids = picked[0].union(picked[1])
    rows = docs.select("doc_id", "text").filter(F.length("text") <= LONGEST).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    total = sum(size.values())
    share = size.get(1, 0) / total if total else None

    def fit(batches):
        sample = sorted(x for b in batches for x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("label").to_pylist()))
        net = train([t.encode() for _, t, _ in sample], np.array([y for _, _, y in sample], np.float64), share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    found = rows.repartition(1).mapInArrow(fit, "net binary").collect()
    return pickle.loads(found[0]["net"]) if found else train([], np.zeros(0), share)


def toxicity(docs: DataFrame, net: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row of docs. Null, empty and wordless texts have one empty window and so a score; other columns aren't
    read; rows that repeat are scored each, alike."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def of(batches):
        for rows, data, off in in_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores(sent.value, data, off))], ["doc_id", "score"])

    return raw.mapInArrow(of, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, net: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def of(batches):
        for rows, data, off in in_slices(batches, "text"):
            yield rows.filter(pa.array(scores(sent.value, data, off) < threshold))

    return docs.mapInArrow(of, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity(docs, fitted(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
