"""op10: removal of byte strings that occur more than once, by merged suffix orders of the shards.

A string of `size` bytes is looked at through an anchor: of its k-byte grams the one of the least hash (the
rightmost of equal ones). The choice depends on the string alone, so two equal strings have equal anchors in
equal places, and each window start of a text belongs to one anchor. Anchors that occur once cannot lie in a
repeat and are left out (through a bitmap of at most 2**28 bits; what it lets pass too much is found out later).

A shard (a batch of texts) sends its anchored suffixes: the bytes right of the anchor, in order, with what
stands left of it, as the transform keeps it. The shards' rows of one anchor are merged by refinement of
their interleave: all stand in one interval at first, and each round splits the intervals by the next eight
bytes, for intervals of more than one row only. Neighbours then give common prefixes; the same merge over the
bytes left of the anchor, read backwards, gives common suffixes. A window that starts s bytes left of the
anchor is repeated if another row lies in its interval of the right order at depth size - s and in its
interval of the left order at depth s. No byte-wise suffix array of the corpus is built or sorted.

Equal contexts of a shard are sent once and their windows are repeats already. Null texts are empty; rows are
told apart by doc_id and text, and repeated rows count as occurrences of their own. A null doc_id counts as the
least long within and stays null outside. Texts over SEGMENT bytes are read in overlapping segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import cut, parallelism, table
from ._text import buffer, hashed, mix
from .line_dedup import _source, keyed
from .lm_score import Sums, _rows

GRAM, SEGMENT, PLACE = 32, 4 << 20, 24
MAX_BITS = 28


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    padded = np.ascontiguousarray(data)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(0, GRAM, 8):
            h = (h ^ np.ndarray((n,), "<u8", padded, j, (1,))) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return h * np.uint64(0x9E3779B97F4A7C15)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    rows = -(-n // w)
    y = np.full(rows * w, np.uint64(2**64 - 1))
    y[:n] = x
    y = y.reshape(rows, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, off: np.ndarray, size: int):
    """Runs of window starts with one anchor: hash, first start, last start, anchor's place, text."""
    z = np.zeros(0, np.int64)
    if len(data) < size:
        return z.view(np.uint64), z, z, z, z
    h = _grams(data)
    low = np.uint64((1 << PLACE) - 1)
    place = _sliding_min((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), size - GRAM + 1)
    place = (low - (place & low)).astype(np.int64)
    n = np.diff(off)
    long = np.flatnonzero(n >= size)
    count = n[long] - size + 1
    start = np.arange(count.sum()) + np.repeat(off[long] - np.cumsum(count) + count, count)
    text = np.repeat(long, count)
    p = place[start]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (text[1:] != text[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(p)) - 1
    if not len(p):
        return z.view(np.uint64), z, z, z, z
    return mix(h[p[a]]), start[a], start[b], p[a], text[a]


def _pieces(column, size: int):
    """(bytes, offsets, row of each text, where each text's bytes begin in its row) in bounded pieces."""
    data, off = buffer(column)
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > SEGMENT:
            for s in range(0, int(off[i + 1] - off[i]) - size + 1, SEGMENT - size + 1):
                part = data[off[i] + s : min(off[i] + s + SEGMENT, off[i + 1])]
                yield part, np.array([0, len(part)]), np.array([i]), np.array([s])
            i += 1
            continue
        j = i + 1
        while j < n and off[j + 1] - off[i] <= SEGMENT // 2:
            j += 1
        yield data[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j), np.zeros(j - i, np.int64)
        i = j


def _counts(size: int):
    def run(batches):
        sums = Sums()
        for b in batches:
            for data, off, _, _ in _pieces(b.column(0), size):
                u, n = np.unique(anchors(data, off, size)[0], return_counts=True)
                sums.add(u, n)
        yield from _rows(*sums.take(), ["h", "n"])

    return run


def _bitmaps(batches):
    """Rows (block, bit) sorted by block in; a bitmap for each block out."""
    key, bits = None, None
    for b in batches:
        block, bit = np.asarray(b.column(0)), np.asarray(b.column(1))
        for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            if not len(part):
                continue
            if block[part[0]] != key:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["block", "bits"])
                key, bits = int(block[part[0]]), np.zeros(1 << 15, np.uint8)
            bits[bit[part]] = 1
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["block", "bits"])


def membership(hashes: DataFrame, max_bits: int = MAX_BITS):
    """A broadcast (bitmap, places) of the hashes' first `places` bits: at most 2**max_bits bits, about 16 for each hash below that."""
    places = int(min(max_bits, max(16, int(16 * hashes.count() + 1).bit_length())))
    x = F.shiftrightunsigned("h", 64 - places)
    placed = hashes.select(F.shiftright(x, 15).alias("block"), x.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    bits = np.zeros(1 << (places - 3), np.uint8)
    for r in placed.repartition(parallelism(hashes), "block").sortWithinPartitions("block").mapInArrow(_bitmaps, "block long, bits binary").collect():
        bits[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast((bits, places))


def _shards(batches, rows: int = 8192, limit: int = 24 << 20):
    """Batches put together to shards of bounded size."""
    wait, n, size = [], 0, 0
    for b in batches:
        wait.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= limit:
            yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
            wait, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]


ROWS = "h long, doc long, tag long, first long, lead int, spare int, context binary"
ROWS_ARROW = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("first", pa.int64()), ("lead", pa.int32()), ("spare", pa.int32()), ("context", pa.binary())])


def _contexts(shared, size: int):
    """Of each run of an anchor that may repeat: first start, lead (bytes left of the anchor), spare (lead at the last start), context. lead -1: the run is repeated within the shard; then spare is its number of starts."""

    def run(batches):
        bits, places = shared.value
        for b in _shards(batches):
            doc, tag = np.asarray(b.column(0)), np.asarray(b.column(1))
            found = []
            for data, off, rows, base in _pieces(b.column(2), size):
                h, i0, i1, p, text = anchors(data, off, size)
                x = (h >> np.uint64(64 - places)).astype(np.int64)
                keep = np.flatnonzero((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1)
                if not len(keep):
                    continue
                h, i0, i1, p, text = (y[keep] for y in (h, i0, i1, p, text))
                end = i1 + size
                whole = hashed(data, i0, end) ^ h ^ mix((p - i0).astype(np.uint64))
                found.append((h, whole, doc[rows[text]], tag[rows[text]], i0 - off[text] + base[text], p - i0, p - i1, [data[a:z].tobytes() for a, z in zip(i0, end)]))
            if not found:
                continue
            *columns, contexts = zip(*found)
            h, whole, d, t, first, lead, spare = (np.concatenate(c) for c in columns)
            contexts = [x for y in contexts for x in y]
            _, at, inverse, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            alone = np.flatnonzero(n == 1)
            many = np.flatnonzero(n > 1)
            # one copy of a context goes out (marked as settled by a negative first start), the settled runs of all copies return
            out = np.concatenate([at[alone], at[many]])
            mark = np.concatenate([np.zeros(len(alone), bool), np.ones(len(many), bool)])
            order = np.argsort(h[out], kind="stable")
            out, mark = out[order], mark[order]
            for k in range(0, len(out), 4096):
                o, m = out[k : k + 4096], mark[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(h[o].view(np.int64)), pa.array(d[o]), pa.array(t[o]), pa.array(np.where(m, -1, first[o])), pa.array(lead[o].astype(np.int32)), pa.array(spare[o].astype(np.int32)), pa.array([contexts[x] for x in o], pa.binary())], schema=ROWS_ARROW)
            done = np.flatnonzero(n[inverse] > 1)
            if len(done):
                # neighbouring runs of a text are one
                done = done[np.lexsort((first[done], t[done], d[done]))]
                a, z = first[done], first[done] + lead[done] - spare[done] + size
                new = np.ones(len(done), bool)
                new[1:] = (d[done][1:] != d[done][:-1]) | (t[done][1:] != t[done][:-1]) | (a[1:] > z[:-1]) | (a[1:] < a[:-1])
                cut_at = np.flatnonzero(new)
                stop = np.maximum.reduceat(z, cut_at)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(cut_at), np.int64)), pa.array(d[done][cut_at]), pa.array(t[done][cut_at]), pa.array(a[cut_at]), pa.array(np.full(len(cut_at), -1, np.int32)), pa.array((stop - a[cut_at]).astype(np.int32)), pa.array([None] * len(cut_at), pa.binary())], schema=ROWS_ARROW)

    return run


def _merge(bucket: np.ndarray, raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge rows of each bucket by refinement of their interleave: their order, and the common prefix of each with the one before (0 at a bucket's first)."""
    n = len(bucket)
    eight = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    z = np.searchsorted(np.unique(bucket), bucket) if n else bucket
    size = np.bincount(z)
    z = (np.cumsum(size) - size)[z]  # the first place of a row's interval
    live, step = np.arange(n), 0

    def word(rows, step):
        left = length[rows] - step
        x = eight[np.minimum(at[rows] + step, len(eight) - 1)].astype(np.uint64)
        cut_off = np.clip(8 - left, 0, 8)
        mask = np.where(cut_off >= 8, np.uint64(0), ~np.uint64(0) << (np.minimum(cut_off, 7) * 8).astype(np.uint64))
        return x & mask

    while len(live):
        count = np.bincount(z[live], minlength=n)
        live = live[(count[z[live]] > 1)]
        if not len(live) or step >= length[live].max():
            break
        w = word(live, step)
        order = np.lexsort((w, z[live]))
        live, w = live[order], w[order]
        same = np.zeros(len(live), bool)
        same[1:] = (z[live][1:] == z[live][:-1])
        first = np.flatnonzero(~same)
        place = z[live] + np.arange(len(live)) - np.repeat(first, np.diff(np.append(first, len(live))))
        new = ~same
        new[1:] |= w[1:] != w[:-1]
        head = np.flatnonzero(new)
        z[live] = np.repeat(place[head], np.diff(np.append(head, len(live))))
        step += 8
    order = np.argsort(z, kind="stable")
    common = np.zeros(n, np.int64)
    pair = np.flatnonzero(bucket[order][1:] == bucket[order][:-1]) + 1
    most = np.minimum(length[order[pair]], length[order[pair - 1]])
    step = 0
    while len(pair):
        x = word(order[pair], step) ^ word(order[pair - 1], step)
        # whole bytes that agree at the front
        agree = np.full(len(pair), 8, np.int64)
        some = x != 0
        agree[some] = 0
        for k in range(8, 64, 8):
            agree[some & (x >> np.uint64(64 - k) == 0)] = k // 8
        common[pair] += agree
        on = (agree == 8) & (step + 8 < most)
        done = np.minimum(common[pair], most)
        common[pair] = done
        pair, most = pair[on], most[on]
        step += 8
    return order, common


def _settle(h, lead, spare, contexts, size):
    """Runs (row, least s, greatest s) of repeated windows among rows of whole buckets, sorted by bucket."""
    n = len(h)
    lengths = np.array([len(x) for x in contexts])
    begin = np.cumsum(lengths) - lengths
    raw = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    order, right = _merge(h, raw, begin + lead, lengths - lead)
    total = int(lengths.sum())
    backwards = np.concatenate([raw[:total][::-1], np.zeros(8, np.uint8)])
    left_order, left = _merge(h, backwards, total - begin - lead, lead)
    heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.append(heads, n))
    out = []
    # the merges keep buckets together, in the order of their hashes; rows come sorted by hash
    two = heads[sizes == 2]
    r, l = right[two + 1], left[two + 1]
    for row in (two, two + 1):
        lo, hi = np.maximum(spare[row], size - r), np.minimum(lead[row], l)
        ok = lo <= hi
        out.append((row[ok], lo[ok], hi[ok]))
    for a, g in zip(heads[sizes > 2], sizes[sizes > 2]):
        ro, lo = order[a : a + g] - a, left_order[a : a + g] - a
        rc, lc = right[a : a + g].copy(), left[a : a + g].copy()
        rc[0] = lc[0] = -1
        s0, s1 = spare[a : a + g], lead[a : a + g]
        step = max(1, 2_000_000 // g)
        for s in range(int(s0.min()), int(s1.max()) + 1, step):
            at = np.arange(s, min(s + step, int(s1.max()) + 1))
            rid, lid = np.empty((len(at), g), np.int64), np.empty((len(at), g), np.int64)
            rid[:, ro] = np.cumsum(rc[None] < size - at[:, None], axis=1)
            lid[:, lo] = np.cumsum(lc[None] < at[:, None], axis=1)
            key = (np.arange(len(at))[:, None] * (g + 1) + rid) * (g + 1) + lid
            key[(at[:, None] < s0) | (at[:, None] > s1)] = -1
            flat = key.ravel()
            o = np.argsort(flat, kind="stable")
            v = flat[o]
            same = np.zeros(len(v) + 1, bool)
            same[1:-1] = v[1:] == v[:-1]
            hit = np.zeros(len(v), bool)
            hit[o] = (same[:-1] | same[1:]) & (v >= 0)
            hit = hit.reshape(len(at), g).T
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, first = np.nonzero(edge == 1)
            _, last = np.nonzero(edge == -1)
            out.append((row + a, at[first], at[last - 1]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


SPANS = "doc long, tag long, a long, z long"
SPANS_ARROW = pa.schema([(x, pa.int64()) for x in ("doc", "tag", "a", "z")])


def _decide(size: int, block: int = 20_000):
    """Rows sorted by anchor in; removed spans out."""

    def settle(t: pa.Table):
        h = t.column("h").to_numpy()
        u, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        t = t.filter(pa.array(n[inverse] > 1))
        if not t.num_rows:
            return
        h, doc, tag, first, lead, spare = (t.column(k).to_numpy() for k in range(6))
        lead, spare = lead.astype(np.int64), spare.astype(np.int64)
        row, lo, hi = _settle(h, lead, spare, t.column("context").to_pylist(), size)
        ok = first[row] >= 0
        row, lo, hi = row[ok], lo[ok], hi[ok]
        place = first[row] + lead[row]
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(tag[row]), pa.array(place - hi), pa.array(place - lo + size)], schema=SPANS_ARROW)

    def run(batches):
        wait: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            done = pa.compute.equal(b.column("lead"), -1)
            if pa.compute.any(done).as_py():
                d = b.filter(done)
                a, n = d.column("first").to_numpy(), d.column("spare").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([d.column("doc"), d.column("tag"), pa.array(a), pa.array(a + n)], schema=SPANS_ARROW)
                b = b.filter(pa.compute.invert(done))
            if not b.num_rows:
                continue
            wait.append(b)
            rows += b.num_rows
            if rows >= block:
                t = pa.Table.from_batches(wait)
                h = t.column("h").to_numpy()
                k = int(np.searchsorted(h, h[-1]))
                if k:
                    yield from settle(t.slice(0, k))
                wait = t.slice(k).to_batches()
                rows = t.num_rows - k
        if rows:
            yield from settle(pa.Table.from_batches(wait))

    return run


def _union(a: np.ndarray, z: np.ndarray):
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.r_[True, a[1:] > z[:-1]]
    at = np.flatnonzero(new)
    return a[at], np.maximum.reduceat(z, at)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """(doc, tag, starts, ends): the maximal runs of bytes to remove from each document that has any."""
    if size < 2 * GRAM:
        raise ValueError(f"size is {2 * GRAM} at least")
    source = _source(docs, id_col, text_col).where(F.octet_length("text") >= size)
    counted = source.select("text").mapInArrow(_counts(size), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    shared = membership(cut(counted.select("h")))
    # settled runs carry no anchor; they are dealt by their text
    rows = source.mapInArrow(_contexts(shared, size), ROWS)
    key = F.when(F.col("lead") == -1, F.xxhash64("doc", "tag")).otherwise(F.col("h"))
    dealt = rows.withColumn("h", key).repartition(parallelism(docs), "h").sortWithinPartitions("h")
    found = dealt.mapInArrow(_decide(size), SPANS)
    grouped = found.groupBy("doc", "tag").agg(F.collect_list("a").alias("a"), F.collect_list("z").alias("z"))

    def run(batches):
        for b in batches:
            both = [_union(np.array(a), np.array(z)) for a, z in zip(b.column("a").to_pylist(), b.column("z").to_pylist())]
            lists = [pa.array([x[k].tolist() for x in both], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), *lists], ["doc", "tag", "starts", "ends"])

    return grouped.mapInArrow(run, "doc long, tag long, starts array<long>, ends array<long>")


SUMMARY = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def kept(raw: bytes, starts, ends) -> bytes:
    out, at = [], 0
    for a, z in zip(starts or (), ends or ()):
        out.append(raw[at:a])
        at = z
    return b"".join(out) + raw[at:]


def _summary(batches):
    for b in batches:
        rows = []
        for text, a, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            raw = (text or "").encode()
            left = kept(raw, a, z)
            rows.append((len(raw), len(raw) - len(left), len(a or ()), hashlib.sha256(left).hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows), SUMMARY.types[1:]))], schema=SUMMARY)


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """(row, starts, ends): each row of docs as a struct with the spans to remove, null where nothing is to go."""
    return keyed(docs, id_col, text_col).join(spans(docs, id_col, text_col, size), ["doc", "tag"], "left").select("row", "starts", "ends")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_spans(pair, size=size).select("row.doc_id", "row.text", "starts", "ends").mapInArrow(_summary, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
