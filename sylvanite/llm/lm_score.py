"""op6: language-model scores from a log-frequency Bloom filter of n-gram counts.

Model: P(word | previous) with Dirichlet smoothing, P = (c~(previous, word) + MU * P1(word)) / (c(previous) + MU), where
P1(word) = (c + 1) / (N + V + 1). Bigrams of all words, however rare, are counted over all training texts; a count c is
quantised to q = 1 + floor(log_1.5 c) and the filter holds (bigram, 1) ... (bigram, q). A count is read back by probing
levels until one is missing and taken as the least count of its level, so that probabilities never sum to more than one
but for false positives.

The filter grows with the corpus, so it is not broadcast whole: bigrams are dealt by hash into buckets, and a worker holds
the filter of one bucket at a time, with BITS_PER_ENTRY bits for each entry at any size of the corpus. Texts are read in
shards (runs of SHARD rows of an input split, or of a materialised partition where there are no files). A shard sends its
distinct bigrams to their buckets, sorted, with its training counts; the bucket sums the counts of all shards, fills its
filter, probes it for each shard's bigrams and answers with the counts read, in the order asked, a byte or two each.
Exact counts of words take the same way. The shard then meets its answers beside its texts and knows its bigrams by
reading them again, so that neither counts nor filter pass through the driver.

Null text: empty, one end token. Null doc_id: its text form is empty in the crc rule. Repeated rows count and
are scored each. Without training rows N = V = 0 and every token has log10(1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import cut, parallelism, scanned, small_batches, table
from ._text import BLANK, chunks, hashed, lowered, mix, spans

MU, BASE = 200.0, 1.5
BITS_PER_ENTRY, PROBES, BLOCK_BITS = 12, 4, 1 << 15
SHARD = 4096
WORD, GRAM = 0, 1
END = np.uint64(0x1B873593CC9E2D51)
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(data: np.ndarray, off: np.ndarray):
    """Hash of each token, ends included, and where each text's begin."""
    low = lowered(data)
    s, e, first = spans(low, off, BLANK)
    h = np.full(len(s) + len(off) - 1, END)
    h[np.arange(len(s)) + np.repeat(np.arange(len(off) - 1), np.diff(first))] = hashed(low, s, e)
    return h, first + np.arange(len(first))


class Sums:
    """Counts by key over a partition, compacted as they come."""

    def __init__(self, limit: int = 1 << 21):
        self.parts, self.size, self.limit = [], 0, limit

    def add(self, key, count):
        self.parts.append((key, count))
        self.size += len(key)
        if self.size > self.limit:
            done = self.take()
            self.parts, self.size = [done], len(done[0])
            self.limit = max(self.limit, 2 * self.size)

    def take(self):
        if not self.parts:
            z = np.zeros(0, np.int64)
            return z.view(np.uint64), z
        key, count = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
        return key[at], np.add.reduceat(count[order], at) if len(key) else count


def _rows(key, other, names, step=1 << 18):
    for k in range(0, len(key), step):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + step].view(np.int64)) for x in (key, other)], names)


def _pair(previous, word):
    """A bigram's hash. Its last 16 bits are 0, as 48 tell bigrams apart well enough for a filter that errs by itself."""
    with np.errstate(over="ignore"):
        return mix(previous * np.uint64(0x9E3779B97F4A7C15) + word) & np.uint64(2**64 - 2**16)


def _previous(h, first):
    p = np.empty_like(h)
    p[1:] = h[:-1]
    p[first[:-1]] = END  # a text follows an end
    return p


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so that sorted bigrams are sorted by bucket."""
    return ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def level(c: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log_BASE c)."""
    return 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _bits(g: np.ndarray, j: int, blocks: int):
    """Positions of an entry's probes: all in the block of its bigram, among the blocks of its bucket."""
    with np.errstate(over="ignore"):
        x = mix(g ^ (np.asarray(j, np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    base = (((g >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % blocks) * BLOCK_BITS
    return [base + ((x >> np.uint64(15 * k)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for k in range(PROBES)]


class Filter:
    """The log-frequency Bloom filter of a bucket."""

    def __init__(self, g: np.ndarray, c: np.ndarray):
        q = level(c)
        self.blocks = max(1, -(-int(q.sum()) * BITS_PER_ENTRY // BLOCK_BITS))
        bits = np.zeros(self.blocks * BLOCK_BITS, np.uint8)
        for j in range(1, int(q.max(initial=0)) + 1):
            for p in _bits(g[q >= j], j, self.blocks):
                bits[p] = 1
        self.bytes = np.packbits(bits, bitorder="little")

    def counts(self, g: np.ndarray) -> np.ndarray:
        """The least count of the level that each bigram reaches; 0 for one that was not seen."""
        reached, live, j = np.zeros(len(g), np.int64), np.arange(len(g)), 1
        while len(live) and j < 128:
            there = np.ones(len(live), bool)
            for p in _bits(g[live], j, self.blocks):
                there &= (self.bytes[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
            live = live[there]
            reached[live] = j
            j += 1
        return np.where(reached > 0, np.ceil(BASE ** (reached - 1.0) - 1e-6), 0).astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest asks."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys byte by byte, the highest of all first, so that what they share is squeezed out on the way."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _cut_at(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


ASKED = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def _ask(buckets: int):
    """Of each shard and bucket: the shard's distinct words or bigrams there, in order, with their counts in training texts."""

    def run(batches):
        shard, sums = None, (Sums(), Sums())

        def rows():
            for kind, own in enumerate(sums):
                key, n = own.take()
                of = _bucket(key, buckets)
                at = _cut_at(of)
                ends = np.append(at[1:], len(key))
                for k in range(0, len(at), 256):
                    pairs = list(zip(at[k : k + 256].tolist(), ends[k : k + 256].tolist()))
                    yield pa.RecordBatch.from_arrays([pa.array(of[at[k : k + 256]] + kind * buckets), pa.array(np.full(len(pairs), shard)), pa.array([_planes(key[i:j]) for i, j in pairs], pa.binary()), pa.array([_small(n[i:j]) for i, j in pairs], pa.binary())], schema=ASKED)

        for b in batches:
            ids, train = np.asarray(b.column(1)), ~np.asarray(b.column(2).cast(pa.int8())).astype(bool)
            for i, j in zip(c := _cut_at(ids), np.append(c[1:], len(ids))):
                if shard is not None and ids[i] != shard:
                    yield from rows()
                    sums = (Sums(), Sums())
                shard = int(ids[i])
                for x, y, data, off in chunks(b.column(0).slice(i, j - i)):
                    h, first = tokens(data, off)
                    weight = np.repeat(train[i + x : i + y], np.diff(first)).astype(np.float64)
                    for own, key in zip(sums, (h, _pair(_previous(h, first), h))):
                        u, inverse = np.unique(key, return_inverse=True)
                        own.add(u, np.bincount(inverse, weight, len(u)).astype(np.int64))
        if shard is not None:
            yield from rows()

    return run


def _answer(buckets: int):
    """Rows sorted by bucket in; to each of a bucket's shards, the counts of what it asked: of words exact, of bigrams as the filter has them. Each bucket of words also gives its tokens and distinct words, for no shard."""

    def run(batches):
        bucket, wait = None, []

        def rows():
            keys = [_keys(x[1].as_buffer()) for x in wait]
            counts = [_large(x[2].as_py(), len(k)) for x, k in zip(wait, keys)]
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(counts).astype(np.float64), len(key)).astype(np.int64)
            if bucket >= buckets:
                seen = total > 0
                value = Filter(key[seen], total[seen]).counts(key)
            else:
                value = total
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([bucket]), pa.array([b""], pa.binary()), pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])], schema=ANSWER)
            ends = np.cumsum([0] + [len(k) for k in keys])
            for k in range(0, len(wait), 512):
                some = wait[k : k + 512]
                out = [_small(value[inverse[a:z]]) for a, z in zip(ends[k : k + 512], ends[k + 1 :])]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array(np.full(len(some), bucket)), pa.array(out, pa.binary()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], schema=ANSWER)

        for b in batches:
            for own, shard, keys, counts in zip(b.column("bucket").to_pylist(), b.column("shard").to_pylist(), b.column("keys"), b.column("counts")):
                if own != bucket:
                    if bucket is not None:
                        yield from rows()
                    bucket, wait = own, []
                wait.append((shard, keys, counts))
        if bucket is not None:
            yield from rows()

    return run


class Answers:
    """The counts a shard has got back, by word or bigram."""

    def __init__(self, parts: list[np.ndarray], rows: list[bytes], buckets: int):
        self.keys = keys = np.unique(np.concatenate(parts))
        size = np.diff(np.append(at := _cut_at(_bucket(keys, buckets)), len(keys)))
        if len(at) != len(rows):
            raise ValueError("a shard was read otherwise than before")
        self.counts = np.concatenate([_large(x, n) for x, n in zip(rows, size.tolist())])

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.keys, x)]


def held_out(column, folds: int = 7, fold: int = 2):
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD) -> DataFrame:
    """Scores of all rows by a model of those that are not held out. Order 2."""
    small_batches(docs)
    own = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).cast("string").alias("text"))
    place = F.struct(F.input_file_name(), F.input_file_block_start())
    row = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / shard_rows)
    if not scanned(docs):
        own, place = cut(own), F.spark_partition_id()
    source = own.withColumn("shard", F.xxhash64(place, row))

    buckets = 4 * parallelism(docs)
    asked = source.select("text", "shard", "held").mapInArrow(_ask(buckets), "bucket long, shard long, keys binary, counts binary")
    dealt = asked.repartition(parallelism(docs), "bucket").sortWithinPartitions("bucket")
    answers = cut(dealt.mapInArrow(_answer(buckets), "shard long, bucket long, counts binary, n long, v long"))
    n, v = answers.where("shard is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def run(left, right):
        right = right.sort_by("bucket")
        kind, blobs = right.column("bucket").to_numpy() >= buckets, right.column("counts").to_pylist()
        parts = []
        for b in left.combine_chunks().to_batches():
            for i, j, data, off in chunks(b.column("text")):
                h, first = tokens(data, off)
                parts.append((b.slice(i, j - i), first, np.unique(h, return_inverse=True), np.unique(_pair(_previous(h, first), h), return_inverse=True)))
        words = Answers([p[2][0] for p in parts], blobs[: int((~kind).sum())], buckets)
        grams = Answers([p[3][0] for p in parts], blobs[int((~kind).sum()) :], buckets)
        after = float(words.of(np.array([END]))[0])
        out = []
        for b, first, (u, at), (g, to) in parts:
            seen = words.of(u).astype(np.float64)
            p1 = (seen + 1) / (n + v + 1)
            log1, p1, c = np.log10(p1)[at], p1[at], seen[at]
            context = np.empty(len(c))
            context[1:] = c[:-1]
            context[first[:-1]] = after  # a text follows an end
            joint = np.minimum(grams.of(g)[to], context)
            add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023,E731  each text has an end at least
            columns = pa.array(np.diff(first), pa.int64()), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(b.num_rows, n), pa.int64()), pa.array(add(log1)), pa.array(add(np.log10((joint + MU * p1) / (context + MU))))
            out.append(pa.RecordBatch.from_arrays([b.column("id"), b.column("held"), *columns], schema=ARROW))
        return pa.Table.from_batches(out, ARROW)

    got = answers.where("shard is not null").select("shard", "bucket", "counts")
    return source.groupBy("shard").cogroup(got.groupBy("shard")).applyInArrow(run, SCHEMA)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
