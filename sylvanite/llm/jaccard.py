"""op3: n-gram Jaccard self-join by signature trees, and its components.

1. Each document becomes the set of its distinct k-word shingles (64-bit hashes). Equal sets are one node.
2. Links inside groups of near copies are found first: nodes that share one of their least hashes are
   sorted, the likeliest of their next neighbours are compared exactly, and the links' components are taken.
3. Two linked sets share a shingle of their prefixes (the n - ceil(t n) + 1 rarest shingles; rarity by the
   counts of 2**18 hash buckets over all documents, then by hash). Every prefix shingle that several
   components hold gives a signature tree over their nodes: leaves are the components, with the OR of their
   members' token bitmaps, the AND of them and the range of their sizes; inner nodes combine eight each. A dual
   traversal from the root drops pairs of nodes whose sizes cannot fit or whose greatest possible overlap,
   n - |bits of one that the other lacks|, is below what the least union asks.
4. Pairs of components that remain are opened into pairs of sets and held against their own bitmaps. Those
   that remain are compared exactly; if they are many, the likeliest pair of each two components first, then all
   pairs of those that are still apart. All links' components are the result.

Components never compare their own members again, so a group of many near copies costs a few comparisons
a member; equal sets cost none. No link between different sets is lost.

Null, empty and blank texts have no shingles and are linked with nothing. Fewer than k words: the sequence
is the only shingle. Repeated rows count as copies; a null doc_id counts as the least long within a group
and stays null in its row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._run import cut, parallelism, small_batches, table
from ._text import BLANK, chunks, hashed, lowered, mix, ngrams, spans
from .components import LINK, components
from .line_dedup import LOWEST, keyed

BUCKETS, MINS, PARCEL = 1 << 18, 3, 128
#: least and most bits of a token bitmap; between them it has two to four bits for each shingle
BITS = 512, 1 << 16


def _sets(column, k: int):
    """Sorted distinct shingles of each text, text by text."""
    for _, _, data, off in chunks(column):
        low = lowered(data)
        s, e, first = spans(low, off, BLANK)
        g, begin = ngrams(hashed(low, s, e), first, k)
        for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
            yield np.unique(g[a:z])


def _digest(x: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        parts = np.array([len(x), int(x.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(x))) if len(x) else 0], np.uint64)
        h = mix(parts * np.array([3, 5, 7], np.uint64))
        return int(mix(h[:1] ^ (h[1:2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[2:] >> np.uint64(1)))[0].astype(np.int64))


def _bucket_counts(k: int):
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        part = None
        for b in batches:
            part = b.column(1)[0].as_py() if part is None and b.num_rows else part
            for x in _sets(b.column(0), k):
                total += np.bincount((x >> np.uint64(46)).astype(np.int64), minlength=BUCKETS) if len(x) > 20000 else 0
                if len(x) <= 20000:
                    np.add.at(total, (x >> np.uint64(46)).astype(np.int64), 1)
        if part is not None:
            step = 4096
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, BUCKETS, step) // step), pa.array(np.full(BUCKETS // step, part % 64)), pa.array([total[i : i + step].tobytes() for i in range(0, BUCKETS, step)], pa.binary())], ["block", "lane", "counts"])

    return run


def _add_up(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist())
    return pa.Table.from_arrays([t.column("block").slice(0, 1), t.column("lane").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["block", "lane", "counts"])


def prefix_size(n: int, num: int, den: int) -> int:
    """Of a set of n: as many of its rarest elements as two sets of Jaccard num / den or more cannot both miss."""
    return n - -(-n * num // den) + 1


def bitmap(x: np.ndarray) -> np.ndarray:
    width = min(BITS[1], max(BITS[0], 1 << int(2 * len(x)).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(x & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (or rows of them) in `size` bytes: what falls on one place is combined by OR."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, size), axis=-2)


SIG = "doc long, tag long, n long, node long, prefix array<long>, mins array<long>, bits binary"
SIG_ARROW = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("prefix", pa.list_(pa.int64())), ("mins", pa.list_(pa.int64())), ("bits", pa.binary())])


def _signatures(ranks, k: int, num: int, den: int):
    def run(batches):
        rank = ranks.value
        for b in batches:
            ids, tags, rows, at = b.column(0), b.column(2), [], 0
            for x in _sets(b.column(1), k):
                p = x
                if len(x):
                    order = np.argsort(rank[(x >> np.uint64(46)).astype(np.int64)], kind="stable")  # x is sorted by hash
                    p = x[order[: prefix_size(len(x), num, den)]]
                rows.append((len(x), _digest(x), p.view(np.int64), x[:MINS].view(np.int64), bitmap(x).tobytes()))
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), tags.slice(at, len(rows)), *(pa.array(list(c), t) for c, t in zip(zip(*rows), SIG_ARROW.types[2:]))], schema=SIG_ARROW)
                    at, rows = at + len(rows), []
            if rows:
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), tags.slice(at, len(rows)), *(pa.array(list(c), t) for c, t in zip(zip(*rows), SIG_ARROW.types[2:]))], schema=SIG_ARROW)

    return run


def lacking(x: list, y: list) -> np.ndarray:
    """Of pairs of bitmaps: how many bits of one the other lacks, both ways, each in the width of the narrower."""
    out = np.zeros((2, len(x)), np.int64)
    wide = np.array([[len(p), len(q)] for p, q in zip(x, y)]).reshape(-1, 2)
    for w, v in np.unique(wide, axis=0).tolist():
        at, least = np.flatnonzero((wide == (w, v)).all(axis=1)), min(w, v)
        for k in range(0, len(at), 4096):
            some = at[k : k + 4096]
            p, q = (folded(np.frombuffer(b"".join([z[i] for i in some]), np.uint8).reshape(len(some), -1), least).view(np.uint64) for z in (x, y))
            out[0, some], out[1, some] = np.bitwise_count(p & ~q).sum(axis=1), np.bitwise_count(q & ~p).sum(axis=1)
    return out


def _neighbours(num: int, den: int, reach: int = 64, best: int = 2):
    """Rows (key, n, node, comp, bits) in order; of each row the `best` of the next `reach` of its key, and of another component, by the overlap their bitmaps allow."""

    def run(batches):
        for t in _by_group(batches, 4000, reach):
            key, n, node, comp = (t.column(k).to_numpy() for k in range(4))
            bits = t.column(4).to_pylist()
            at, to = [], []
            for d in range(1, min(reach, len(key) - 1) + 1):
                ok = np.flatnonzero((key[d:] == key[:-d]) & (comp[d:] != comp[:-d]) & (den * n[:-d] >= num * n[d:]))
                at.append(ok), to.append(ok + d)
            if not at or not sum(map(len, at)):
                continue
            at, to = np.concatenate(at), np.concatenate(to)
            lack = lacking([bits[i] for i in at], [bits[i] for i in to])
            overlap = np.minimum(n[at] - lack[0], n[to] - lack[1])
            ok = (num + den) * overlap >= num * (n[at] + n[to])
            at, to, overlap = at[ok], to[ok], overlap[ok]
            order = np.lexsort((-overlap, at))
            at, to = at[order], to[order]
            head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
            rank = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            a, z = node[at[rank < best]], node[to[rank < best]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], ["a", "b"])

    return run


def _packed(x: np.ndarray) -> bytes:
    """The first 48 bits of each hash of a set."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return out.view(">u8").ravel().astype(np.uint64)


def _members(bits_of, k: int):
    """The sets of the texts whose node the bitmap lets through."""

    def run(batches):
        for b in batches:
            rows = []
            for x in _sets(b.column(0), k):
                if len(x):
                    d = _digest(x)
                    at = (d & (2**64 - 1)) >> (64 - bits_of.value[1])
                    if bits_of.value[0][at >> 3] >> (at & 7) & 1:
                        rows.append((d, _packed(x)))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles"])

    return run


def _exact(num: int, den: int):
    def run(batches):
        for b in batches:
            a, z = b.column("a"), b.column("b")
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = _unpacked(x.as_buffer()), _unpacked(y.as_buffer())
                if len(x) > len(y):
                    x, y = y, x
                i = np.searchsorted(y, x)
                both = int((y[np.minimum(i, len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(m), z.filter(m)], ["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked. Sets are read again, only those of the pairs (through a bitmap of at most 2**28 bits)."""
    from .repeats import membership

    bits = membership(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    sets = texts.select("text").mapInArrow(_members(bits, k), "node long, shingles binary").dropDuplicates(["node"])
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_exact(num, den), LINK)


#: a leaf of the tree: a component seen through one shingle
LEAF = "token long, comp long, least long, most long"


def _leaves(batches):
    """(comp, n, prefix) in; a row for each shingle and component of a batch out."""
    for b in batches:
        comp, n = np.asarray(b.column(0)), np.asarray(b.column(1))
        p = b.column(2)
        token = np.asarray(p.flatten())
        own = np.repeat(np.arange(len(comp)), np.asarray(pa.compute.list_value_length(p)))
        order = np.lexsort((comp[own], token))
        token, own = token[order], own[order]
        if not len(token):
            continue
        new = np.r_[True, (token[1:] != token[:-1]) | (comp[own][1:] != comp[own][:-1])]
        at = np.flatnonzero(new)
        size = n[own]
        for k in range(0, len(at), 1 << 18):
            s = slice(k, k + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(token[at][s]), pa.array(comp[own][at][s]), pa.array(np.minimum.reduceat(size, at)[s]), pa.array(np.maximum.reduceat(size, at)[s])], ["token", "comp", "least", "most"])


def _by_group(batches, least: int = 50_000, keep: int = 0):
    """Tables of whole groups, from rows sorted by the first column; with `keep`, of parts of groups that overlap by so many rows."""
    wait, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        wait.append(b)
        rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(wait)
            key = t.column(0).to_numpy()
            k = int(np.searchsorted(key, key[-1])) if not keep else t.num_rows - keep
            if k > 0:
                yield t.slice(0, k + keep)
            wait, rows = t.slice(max(k, 0)).to_batches(), t.num_rows - max(k, 0)
    if rows:
        yield pa.Table.from_batches(wait)


def _shared(batches):
    """Leaves sorted by token in; those of tokens that several components hold out. Tokens held by the same components are one group, named by a hash of them."""
    for t in _by_group(batches):
        token, comp = t.column(0).to_numpy(), t.column(1).to_numpy()
        order = np.lexsort((comp, token))
        token, comp = token[order], comp[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (comp[1:] != comp[:-1])]
        token, comp = token[new], comp[new]
        head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.append(head, len(token)))
        with np.errstate(over="ignore"):
            name = mix(np.add.reduceat(mix(comp.view(np.uint64)), head))
        _, one = np.unique(name, return_index=True)
        one = one[size[one] > 1]
        at = np.repeat(head[one] - np.cumsum(size[one]) + size[one], size[one]) + np.arange(size[one].sum())
        group = np.repeat(name[one], size[one]).view(np.int64)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(group[k : k + (1 << 16)]), pa.array(comp[at[k : k + (1 << 16)]])], ["token", "comp"])


def tree_pairs(least, most, some, every, num: int, den: int, fan: int = 8, step: int = 1 << 16):
    """Pairs of leaves that may be linked. least, most: sizes; some, every: OR and AND of the bitmaps, a row of 64-bit words each.

    Levels are made bottom up from the leaves in order of size; pairs of nodes are opened top down."""
    order = np.lexsort((most, least))
    levels = [(least[order], most[order], some[order], every[order])]
    while len(levels[-1][0]) > 1:
        lo, hi, a, e = levels[-1]
        at = np.arange(0, len(lo), fan)
        levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.bitwise_or.reduceat(a, at, axis=0), np.bitwise_and.reduceat(e, at, axis=0)))
    out = []
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, x, y = stack.pop()
        lo, hi, a, e = levels[depth]
        lack = lambda p, q: np.bitwise_count(e[p] & ~a[q]).sum(axis=1).astype(np.int64)
        ok = (den * hi[x] >= num * lo[y]) & (den * hi[y] >= num * lo[x])
        x, y = x[ok], y[ok]
        overlap = np.minimum(hi[x] - lack(x, y), hi[y] - lack(y, x))
        ok = (num + den) * overlap >= num * (lo[x] + lo[y])  # J >= num/den iff overlap >= num/(num+den) of the sizes' sum
        x, y = x[ok], y[ok]
        if depth == 0:
            apart = x < y
            out.append((order[x[apart]], order[y[apart]]))
            continue
        below = len(levels[depth - 1][0])
        i, j = np.divmod(np.arange(fan * fan), fan)
        cx, cy = (x[:, None] * fan + i).ravel(), (y[:, None] * fan + j).ravel()
        ok = (cx < below) & (cy < below) & (cx <= cy)
        cx, cy = cx[ok], cy[ok]
        for k in range(0, len(cx), step):
            stack.append((depth - 1, cx[k : k + step], cy[k : k + step]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _trees(num: int, den: int):
    """(token, comp, least, most, some, every) sorted by token in; pairs of components out."""

    def run(batches):
        for t in _by_group(batches, 8000):
            token, comp, least, most = (t.column(k).to_numpy() for k in range(4))
            some = [np.frombuffer(x, np.uint8) for x in t.column(4).to_pylist()]
            every = [x if y is None else np.frombuffer(y, np.uint8) for x, y in zip(some, t.column(5).to_pylist())]
            width = np.array([len(x) for x in some])
            head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            found = []
            for a, z in zip(head, np.append(head[1:], len(token))):
                c, at = np.unique(comp[a:z], return_index=True)
                if len(c) > 1:
                    at = at + a
                    for w in np.unique(width[at]).tolist():  # a tree for each width; pairs are seen in that of the narrower
                        use = np.flatnonzero(width[at] >= w)
                        if len(use) < 2:
                            continue
                        o, e = (np.stack([folded(x[i], w) for i in at[use]]).view(np.uint64) for x in (some, every))
                        x, y = tree_pairs(least[at[use]], most[at[use]], o, e, num, den)
                        x, y = use[x], use[y]
                        own = (width[at[x]] == w) | (width[at[y]] == w)
                        x, y = x[own], y[own]
                        found.append((np.minimum(c[x], c[y]), np.maximum(c[x], c[y])))
            if found:
                x, y = (np.concatenate(w) for w in zip(*found))
                u = np.unique(np.stack([x, y]), axis=1)
                for k in range(0, u.shape[1], 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(u[0, k : k + 100_000]), pa.array(u[1, k : k + 100_000])], ["a", "b"])

    return run


def _combine(batches):
    """(comp, n, bits) sorted by comp in; (comp, least, most, some, every) out, one row for each component of the partition; every is null where it equals some."""
    key, state, out = None, None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3].tobytes() for x in out], pa.binary()), pa.array([None if np.array_equal(x[3], x[4]) else x[4].tobytes() for x in out], pa.binary())], ["comp", "least", "most", "some", "every"])

    for b in batches:
        comp, n = np.asarray(b.column(0)), np.asarray(b.column(1))
        if not len(comp):
            continue
        bits = [np.frombuffer(x, np.uint8) for x in b.column(2).to_pylist()]
        for c, size, x in zip(comp.tolist(), n.tolist(), bits):
            if c == key:
                w = min(len(x), len(state[3]))
                x = folded(x, w)
                state = (key, min(state[1], size), max(state[2], size), folded(state[3], w) | x, folded(state[4], w) & x)
            else:
                if key is not None:
                    out.append(state)
                key, state = c, (c, size, size, x, x)
        if len(out) > 4096:
            yield flush()
            out = []
    if key is not None:
        out.append(state)
        yield flush()


def _plausible(num: int, den: int):
    """Pairs of parcels of sets with their sizes and bitmaps in; pairs of sets whose greatest possible overlap is enough out."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                one = b.slice(row, 1)
                x, y = (one.column(c)[0].as_py() for c in ("xs", "ys"))
                na, nz = (np.array([m["n"] for m in z], np.int64) for z in (x, y))
                i, j = np.nonzero((den * na[:, None] >= num * nz[None]) & (den * nz[None] >= num * na[:, None]))
                if not len(i):
                    continue
                lack = lacking([x[k]["bits"] for k in i], [y[k]["bits"] for k in j])
                overlap = np.minimum(na[i] - lack[0], nz[j] - lack[1])
                ok = np.flatnonzero((num + den) * overlap >= num * (na[i] + nz[j]))
                if len(ok):
                    a, z = ([m[k]["node"] for k in at[ok]] for m, at in ((x, i), (y, j)))
                    ends = [pa.array(np.full(len(ok), one.column(c)[0].as_py(), np.int64)) for c in ("a", "b")]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(overlap[ok]), *ends], ["a", "b", "overlap", "ca", "cb"])

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc, tag, n, component, stays) for every row; tag: a hash of the text; stays: the one (doc, tag) of its component that is least; doc: the doc_id, or the least long for null. Sets are linked from a Jaccard similarity of num / den on."""
    small_batches(docs)
    sc, n = docs.sparkSession.sparkContext, parallelism(docs)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tag"))
    counts = source.select("text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(_bucket_counts(k), "block long, lane long, counts binary")
    counts = counts.groupBy("block", "lane").applyInArrow(_add_up, "block long, lane long, counts binary").groupBy("block").applyInArrow(_add_up, "block long, lane long, counts binary")
    total = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():  # 64 rows of 32 KB
        total[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["counts"], np.int64)
    # buckets of usual counts rank alike, by hash; fuller ones come later
    rank = np.maximum(0, np.log2(np.maximum(total, 1) / max(1.0, np.median(total)))).astype(np.int8)
    ranks = sc.broadcast(rank)

    sig = cut(source.select("doc", "text", "tag").mapInArrow(_signatures(ranks, k, num, den), SIG))
    nodes = cut(sig.where("n > 0").groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("mins").alias("mins"), F.first("bits").alias("bits")))

    # near copies, by neighbours under their least hashes
    keys = nodes.select(F.explode("mins").alias("key"), "n", "node", F.col("node").alias("comp"), "bits")
    near = keys.repartitionByRange(n, "key", "n", "node").sortWithinPartitions("key", "n", "node").mapInArrow(_neighbours(num, den), LINK).distinct()
    links = cut(_verify(cut(near), source, k, num, den))
    roots = cut(components(links))
    grouped = lambda *c: nodes.select("node", *c).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), *c)

    leaves = grouped("n", "prefix").select("comp", "n", "prefix").mapInArrow(_leaves, LEAF)
    active = leaves.select("token", "comp").repartition(n, "token").sortWithinPartitions("token").mapInArrow(_shared, "token long, comp long").distinct()
    ranges = grouped("n", "bits").select("comp", "n", "bits").repartition(n, "comp").sortWithinPartitions("comp").mapInArrow(_combine, "comp long, least long, most long, some binary, every binary")
    held = active.join(ranges, "comp").select("token", "comp", "least", "most", "some", "every")
    pairs = cut(held.repartition(n, "token").sortWithinPartitions("token").mapInArrow(_trees(num, den), LINK).distinct())

    # members travel in parcels of about PARCEL, however many a component has
    each = grouped("n", "bits")
    sizes = grouped("n").groupBy("comp").agg(F.count("*").alias("size"))
    parcel = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PARCEL))
    members = each.join(pairs.select(F.col("a").alias("comp")).union(pairs.select("b")).distinct(), "comp", "left_semi").join(sizes, "comp")
    members = cut(members.withColumn("parcel", parcel).groupBy("comp", "parcel").agg(F.collect_list(F.struct("node", "n", "bits")).alias("ms")))
    x, y = members.select(F.col("comp").alias("a"), F.col("ms").alias("xs")), members.select(F.col("comp").alias("b"), F.col("ms").alias("ys"))
    opened = pairs.join(x, "a").join(y, "b")
    more = cut(opened.mapInArrow(_plausible(num, den), "a long, b long, overlap long, ca long, cb long"))
    # few pairs are compared at once; of many, the likeliest of two components first and the rest only where they are still apart
    rest = more
    if more.count() > nodes.count():
        top = more.withColumn("r", F.row_number().over(Window.partitionBy("ca", "cb").orderBy(F.desc("overlap"), "a", "b"))).where("r = 1")
        links = links.union(cut(_verify(top.select("a", "b"), source, k, num, den)))
        roots = cut(components(links))
        side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias("r" + c))
        rest = more.join(top.select("a", "b"), ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
        rest = cut(rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")))
    if rest.take(1):
        roots = cut(components(links.union(cut(_verify(rest.select("a", "b"), source, k, num, den)))))
    last = roots

    own = F.when(F.col("n") > 0, F.coalesce("root", "node")).otherwise(None).alias("comp")
    rows = sig.select("doc", "tag", "n", "node").join(last, "node", "left").select("doc", "tag", "n", own)
    best = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc", "tag")).alias("best"))
    named = rows.join(best, "comp", "left")
    return named.select("doc", "tag", "n", F.coalesce("best.doc", "doc").alias("component"), F.coalesce(F.col("best") == F.struct("doc", "tag"), F.lit(True)).alias("stays"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each component, that of its least doc_id; of rows equal in doc_id and text one. Null ids are one id."""
    found = join(docs, id_col, text_col, **options).where("stays").select("doc", "tag")
    return keyed(docs, id_col, text_col).join(found, ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"]).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    null = lambda c: F.when(F.col(c) != LOWEST, F.col(c)).alias
    return found.select(null("doc")("doc_id"), F.col("n").alias("n_shingles"), null("component")("component_id"))
