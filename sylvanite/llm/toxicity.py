"""op9: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own embedding (hashed) beside the mean embedding of its character trigrams and of its
first six bytes (hashed), so that unseen words are read by their characters. Words of more than PIECE bytes are read as
successive pieces of that size, each a word of its own, so that texts without blanks are read to their end. Inputs and their projections are
computed once for each distinct word of a chunk. Windows of WINDOW words overlap by half and cover the whole
text; a document's score is that of its highest window. Training is multiple-instance: in documents marked
toxic the highest windows are the positive ones.

The only thing fitted is the network, on at most `sample` toxic and 3 * `sample` clean labelled rows, first by a hash of
doc_id, in one task of an executor: a lost one is run again, from the same seed. Texts are learned from and scored whole,
and the number of updates is the same for any number of rows.

A null or empty text is one empty window. Labels that are null or whose document is missing are not used;
if no labelled row of either class is left, every score is 0. Repeated rows give repeated rows; a null
doc_id stays null and counts as the empty text in the held-out rule.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import small_batches, table
from ._text import BLANK, buffer, chunks, hashed, lowered, spans

WINDOW, STEP = 32, 16
PIECE = 64
WORDS, CHARS, DIM, HIDDEN, ATT = 1 << 14, 1 << 13, 8, 8, 8
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def pieces(s: np.ndarray, e: np.ndarray, first: np.ndarray):
    """Spans of PIECE bytes at most: longer ones are cut."""
    count = -(-(e - s) // PIECE)
    begin = np.concatenate([[0], np.cumsum(count)])
    a = np.repeat(s, count) + (np.arange(begin[-1]) - np.repeat(begin[:-1], count)) * PIECE
    return a, np.minimum(a + PIECE, np.repeat(e, count)), begin[first]


def _distinct(data: np.ndarray, off: np.ndarray):
    """Hash of each distinct word; buckets of its characters' n-grams, with where each word's begin; the distinct word of each word; first word of each text."""
    low = lowered(data)
    s, e, first = spans(low, off, BLANK)
    s, e, first = pieces(s, e, first)
    h, at, inverse = np.unique(hashed(low, s, e), return_index=True, return_inverse=True)
    s, e = s[at], e[at]
    size = e - s
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    grams = np.zeros(begin[-1], np.int64)
    if len(s):
        owner = np.repeat(np.arange(len(s)), size + 1)
        j = np.arange(begin[-1]) - begin[owner]
        a = s[owner] + j
        padded = np.concatenate([low, np.zeros(2, np.uint8)]).astype(np.uint64)
        n = size[owner]
        before = np.where(j > 0, padded[np.maximum(a - 1, 0)], 1)
        after = np.where(j + 1 < n, padded[np.minimum(a + 1, len(low))], 2)
        x = before * np.uint64(0x9E3779B97F4A7C15) + padded[np.minimum(a, len(low))] * np.uint64(0xC4CEB9FE1A85EC53) + after * np.uint64(0xFF51AFD7ED558CCD)
        grams = ((x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(51)).astype(np.int64) % CHARS
        grams[begin[1:] - 1] = (hashed(low, s, np.minimum(e, s + 6), 7) % np.uint64(CHARS)).astype(np.int64)
    return h, grams, begin, inverse, first


def distinct_words(data: np.ndarray, off: np.ndarray):
    """As _distinct, with the bucket of each distinct word for its hash."""
    h, *rest = _distinct(data, off)
    return (h % np.uint64(WORDS)).astype(np.int64), *rest


def joined_words(parts):
    """distinct_words() of texts read chunk by chunk: the parts' words are told apart by hash."""
    h = np.concatenate([p[0] for p in parts])
    size = np.concatenate([np.diff(p[2]) for p in parts])
    grams = np.concatenate([p[1].astype(np.int16) for p in parts])  # CHARS buckets fit
    h, at, to = np.unique(h, return_index=True, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size[at])])
    old = np.cumsum(size) - size
    grams = grams[np.repeat(old[at] - begin[:-1], size[at]) + np.arange(begin[-1])]
    words = np.cumsum([0] + [len(p[0]) for p in parts])
    inverse = np.concatenate([to[p[3] + w].astype(np.int32) for p, w in zip(parts, words)])
    ends = np.cumsum([0] + [len(p[3]) for p in parts])
    first = np.concatenate([[0], *(p[4][1:] + e for p, e in zip(parts, ends))])
    return (h % np.uint64(WORDS)).astype(np.int64), grams, begin, inverse, first


def windows(first: np.ndarray):
    """Text, first word and size of each window; an empty text has one of no words."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STEP))
    owner = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return owner, first[owner] + at, np.minimum(n[owner] - at, WINDOW)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"words": f(WORDS, DIM, k=0.1), "chars": f(CHARS, DIM, k=0.1)}
        for d in "fb":
            self.p |= {f"w{d}": f(2 * DIM, 3 * HIDDEN), f"u{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": f(2 * HIDDEN, ATT), "v": f(ATT), "o": f(2 * HIDDEN), "bias": np.zeros(1, np.float32)}

    def inputs(self, words, grams, begin, step: int = 1 << 14):
        x = np.empty((len(words), 2 * DIM), np.float32)
        x[:, :DIM] = self.p["words"][words]
        for k in range(0, len(words), step):
            e = begin[k : k + step + 1]
            x[k : k + step, DIM:] = np.add.reduceat(self.p["chars"][grams[e[0] : e[-1]]], e[:-1] - e[0], axis=0) / np.diff(e)[:, None]
        return x

    def projected(self, x):
        """What the gates take from each distinct word's input, by direction."""
        return {d: x @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def forward(self, x, ids, live, keep=False):
        """Logits of windows. x: projected inputs of the distinct words; ids: windows by WINDOW; live: 1 where a window has a word."""
        p, (m, t) = self.p, ids.shape
        hs = np.zeros((t, m, 2 * HIDDEN), np.float32)
        memo = {}
        for k, d in enumerate("fb"):
            u, proj = p[f"u{d}"], x[d]
            h = np.zeros((m, HIDDEN), np.float32)
            for s in range(t) if d == "f" else range(t - 1, -1, -1):
                g, hu = proj[ids[:, s]], h @ u
                zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                z = 1 - (1 - z) * live[:, s, None]
                if keep:
                    memo[d, s] = (h, z, r, n, hu[:, 2 * HIDDEN :])
                h = n + z * (h - n)
                hs[s, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        e = np.tanh(hs @ p["a"])
        score = e @ p["v"] + np.where(live.T > 0, 0, -1e9).astype(np.float32)
        w = np.exp(score - score.max(axis=0))
        w *= live.T
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = np.einsum("tm,tmh->mh", w, hs)
        out = pooled @ p["o"] + p["bias"]
        return (out, hs, e, w, pooled, memo) if keep else out

    def gradients(self, words, grams, begin, ids, live, target, weight):
        p, (m, t) = self.p, ids.shape
        x = self.inputs(words, grams, begin)
        out, hs, e, w, pooled, memo = self.forward(self.projected(x), ids, live, True)
        do = (_sigmoid(out) - target) * weight / m
        g = {"bias": np.array([do.sum()], np.float32), "o": pooled.T @ do}
        dp = do[:, None] * p["o"]
        dh = w[:, :, None] * dp
        dw = np.einsum("tmh,mh->tm", hs, dp)
        ds = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tm,tma->a", ds, e)
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["a"] = np.einsum("tmh,tma->ha", hs, de)
        dh = dh + de @ p["a"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p[f"u{d}"]
            du, dproj, carry = np.zeros_like(u), np.zeros((t, m, 3 * HIDDEN), np.float32), np.zeros((m, HIDDEN), np.float32)
            for s in range(t - 1, -1, -1) if d == "f" else range(t):
                h, z, r, n, hn = memo[d, s]
                q = dh[s, :, k * HIDDEN : (k + 1) * HIDDEN] + carry
                dn = q * (1 - z) * (1 - n * n)
                dz = q * (h - n) * z * (1 - z) * (live[:, s, None])
                dr = dn * hn * r * (1 - r)
                both = np.concatenate([dz, dr, dn], axis=1)
                hidden = np.concatenate([dz, dr, dn * r], axis=1)
                dproj[s] = both
                du += h.T @ hidden
                carry = q * z + hidden @ u.T
            flat = dproj.transpose(1, 0, 2).reshape(-1, 3 * HIDDEN) * live.reshape(-1, 1)
            total = np.zeros((len(x), 3 * HIDDEN), np.float32)
            order = np.argsort(ids.ravel(), kind="stable")
            sorted_ids = ids.ravel()[order]
            cut = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
            total[sorted_ids[cut]] = np.add.reduceat(flat[order], cut, axis=0)
            g[f"u{d}"], g[f"c{d}"], g[f"w{d}"] = du, total.sum(axis=0), x.T @ total
            dx += total @ p[f"w{d}"].T
        per = np.repeat(dx[:, DIM:] / np.diff(begin)[:, None], np.diff(begin), axis=0)
        return g, (words, dx[:, :DIM]), (grams, per), out


class Adam:
    def __init__(self, params, rate):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}

    def dense(self, k, g, rows=slice(None)):
        self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
        self.s[k][rows] = 0.99 * self.s[k][rows] + 0.01 * g * g
        a, b = self.m[k][rows] / (1 - 0.9**self.t), self.s[k][rows] / (1 - 0.99**self.t)
        self.p[k][rows] -= self.rate * a / (np.sqrt(b) + 1e-8)

    def sparse(self, k, at, g):
        rows, inverse = np.unique(at, return_inverse=True)
        total = np.stack([np.bincount(inverse, g[:, j], len(rows)) for j in range(g.shape[1])], axis=1).astype(np.float32)
        self.dense(k, total, rows)


def grid(start, size, inverse):
    t = np.arange(WINDOW)
    live = (t < size[:, None]).astype(np.float32)
    if not len(inverse):
        return np.zeros((len(start), WINDOW), np.int64), live
    return inverse[np.minimum(start[:, None] + t, len(inverse) - 1)] * (live > 0), live


def train(texts, labels, rounds: int = 8, updates: int = 96, batch: int = 128, seed: int = 11) -> Network | None:
    """Multiple-instance training; None without rows of both classes. texts: strings, or distinct words of chunks of texts.

    Each round picks the windows to learn from by the network so far and takes `updates` batches of them, however many rows there are."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    if isinstance(texts[0], str):
        texts = [_distinct(data, off) for _, _, data, off in chunks(pa.array(texts, pa.string()))]
    words, grams, begin, inverse, first = joined_words(texts)
    owner, start, size = windows(first)
    net, r = Network(), np.random.default_rng(seed)
    adam = Adam(net.p, 0.01)
    group = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for turn in range(rounds):
        score = _score(net, net.inputs(words, grams, begin), start, size, inverse) if turn else r.random(len(owner))
        order = np.lexsort((-score, owner))  # each document's windows, highest first
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(group, np.diff(np.r_[group, len(owner)]))
        positive = np.flatnonzero((y[owner] == 1) & (rank < (1 if turn else 3)))
        hard = np.flatnonzero((y[owner] == 0) & (rank < 1))
        rest = np.flatnonzero((y[owner] == 0) & (rank >= 1))
        negative = np.concatenate([hard, r.choice(rest, min(len(rest), 2 * len(hard)), replace=False) if len(rest) else rest])
        chosen = np.concatenate([positive, negative])
        up = np.float32(max(1.0, len(negative) / max(1, len(positive)))) ** 0.5
        adam.rate = 0.01 * 0.8**turn
        need = updates * batch
        drawn = np.concatenate([r.permutation(chosen) for _ in range(-(-need // len(chosen)))])[:need]
        for k in range(0, need, batch):
            w = drawn[k : k + batch]
            ids, live = grid(start[w], size[w], inverse)
            used, local = np.unique(ids, return_inverse=True)
            count = np.diff(begin)[used]
            at = np.repeat(begin[used] - np.cumsum(count) + count, count) + np.arange(count.sum())
            target = y[owner[w]]
            g, a, b, _ = net.gradients(words[used], grams[at], np.r_[0, np.cumsum(count)], local.reshape(ids.shape), live, target, np.where(target > 0, up, 1).astype(np.float32))
            adam.t += 1
            for name, value in g.items():
                adam.dense(name, value.astype(np.float32))
            adam.sparse("words", *a)
            adam.sparse("chars", *b)
    return net


def _score(net, x, start, size, inverse, step: int = 2048) -> np.ndarray:
    out, proj = np.empty(len(start)), net.projected(x)
    for k in range(0, len(start), step):
        ids, live = grid(start[k : k + step], size[k : k + step], inverse)
        if not len(x):
            out[k : k + step] = net.p["bias"]
        else:
            out[k : k + step] = net.forward(proj, ids, live)
    return out


def score_texts(net: Network | None, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    if net is None:
        return np.zeros(len(off) - 1)
    words, grams, begin, inverse, first = distinct_words(data, off)
    owner, start, size = windows(first)
    logit = _score(net, net.inputs(words, grams, begin), start, size, inverse)
    top = np.maximum.reduceat(logit, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])) if len(owner) else logit
    return 1 / (1 + np.exp(-np.clip(top, -500, 500)))


def _held_out(column, folds: int = 5):
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1200) -> Network | None:
    """Train on at most `sample` toxic and 3 * `sample` clean rows that are not held out."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~_held_out(F.col("id")))
    # ids first: only the sample's texts are read out of the join
    own = marks.groupBy("id").agg(F.max("y").alias("y"))
    pick = None
    for y in (0, 1):
        few = own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample if y else 3 * sample)
        pick = few if pick is None else pick.union(few)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(pick), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def learn(batches):
        parts, y = [], []
        for b in batches:
            y += b.column(0).to_pylist()
            parts += [_distinct(data, off) for _, _, data, off in chunks(b.column(1))]
        net = train(parts, y)
        if net is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    # one task of an executor learns, so that the driver holds neither texts nor the training's arrays
    small_batches(docs)
    got = rows.repartition(1).sortWithinPartitions("id").select("y", "text").mapInArrow(learn, "net binary").collect()
    return pickle.loads(got[0]["net"]) if got else None


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            for i, j, data, off in chunks(b.column(2)):
                s = score_texts(shared.value, data, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=ARROW)

    source = docs.select(F.col(id_col).cast("long").alias("id"), _held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are scored under 0.5, as they are. Rows are judged where they stand, without a join."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for i, j, data, off in chunks(b.column(at).cast(pa.string())):
                good = score_texts(shared.value, data, off) < 0.5
                yield b.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
