"""op1: benchmark decontamination by suffix arrays of the training text.

Every chunk of documents is a shard: its words become numbers of the benchmark's vocabulary, the suffixes
that can begin a window are sorted into a word-level suffix array, and every window of the benchmark
(a test suffix cut to the window's length) is looked up by binary search for the interval of suffixes that
begin with it. Equal windows are looked up once, with the list of their items, so that a word matches at most
one window of each size. Of each document and item found so, the longest verbatim match is the longest run of
windows that both have in a row, found by binary search over its length. A suffix whose next words are not all in the benchmark's
vocabulary can match no window, so it is left out of the array; nothing is lost.

The benchmark is read in blocks of about BLOCK bytes (a longer item is a block of its own); a shard meets one
block after another. At most PASS blocks are broadcast at once: a larger benchmark takes several passes over the
documents, each of which writes what was hit so far to the shared folder before the next begins.

Null texts have no words: such documents are clean, such items occur nowhere. Items of fewer words than
the window are looked up whole. Repeated items count once by item_id; an item_id on several rows has all
their windows. A null item_id is ignored, a null doc_id stays null. Repeated documents give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import cut, small_batches, table
from ._text import ALNUM, buffer, chunks, hashed, lowered, mix, spans

BLOCK, PASS = 8 << 20, 8
FOUND = "array<struct<item:long,words:long,at:long>>"
FOUND_ARROW = pa.list_(pa.struct([(x, pa.int64()) for x in ("item", "words", "at")]))


def _words(data, off):
    low = lowered(data)
    s, e, first = spans(low, off, ALNUM)
    return hashed(low, s, e), first


class Packed:
    """Rows of up to `depth` numbers as byte strings that sort like the rows."""

    def __init__(self, vocabulary: int, depth: int):
        self.bits = max(1, int(vocabulary + 1).bit_length())
        self.each, self.depth = max(1, 64 // self.bits), depth
        self.keys = -(-depth // self.each)

    def rows(self, ids: np.ndarray, at: np.ndarray, size: np.ndarray, fill: int = 0) -> np.ndarray:
        """ids are from 1; beyond `size` words the row is filled with `fill`."""
        out = np.zeros((len(at), self.keys), ">u8")
        for k in range(self.keys):
            x = np.zeros(len(at), np.uint64)
            for j in range(k * self.each, (k + 1) * self.each):
                w = np.where(j < size, ids[np.minimum(at + j, len(ids) - 1)], fill) if j < self.depth else np.zeros(len(at), np.int64)
                x = (x << np.uint64(self.bits)) | w.astype(np.uint64)
            out[:, k] = x
        return out

    def strings(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"V{8 * self.keys}").ravel()


class TestSet:
    """The windows of one block of the benchmark."""

    def __init__(self, items: list[int], texts: list[str | None], window: int):
        h, first = _words(*buffer(pa.array(texts, pa.string())))
        n = np.diff(first)
        self.window, self.vocabulary = window, np.unique(h)
        ids = np.searchsorted(self.vocabulary, h).astype(np.int64) + 1
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        owner = np.repeat(np.arange(len(n)), count)
        self.begin = np.concatenate([[0], np.cumsum(count)])
        at = first[:-1][owner] + np.arange(len(owner)) - self.begin[:-1][owner]
        size = np.minimum(n[owner], window)
        self.least = int(size.min()) if len(size) else 0
        self.pack = Packed(len(self.vocabulary), window)
        if not len(at):
            self.size = size
            return
        low = self.pack.rows(ids, at, size)
        # distinct windows; `of`: that of each window in its place
        order = np.lexsort((size, *low.T[::-1]))
        new = np.r_[True, (low[order][1:] != low[order][:-1]).any(axis=1) | (size[order][1:] != size[order][:-1])]
        self.of = np.empty(len(at), np.int64)
        self.of[order] = np.cumsum(new) - 1
        one = order[new]
        self.size, self.low = size[one], low[one]
        self.high = self.pack.rows(ids, at[one], self.size, (1 << self.pack.bits) - 1)
        # items of each distinct window, and the texts of each item
        item = np.array(items, np.int64)
        pair = np.unique(np.stack([self.of, item[owner]]), axis=1)
        self.items, self.items_at = pair[1], np.searchsorted(pair[0], np.arange(len(one) + 1))
        self.texts: dict[int, list[int]] = {}
        for k, x in enumerate(items):
            if n[k]:
                self.texts.setdefault(x, []).append(k)

    def items_of(self, text: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs, a row each, for texts that hold distinct windows q."""
        both = np.unique(np.stack([text, q]), axis=1)
        count = np.diff(self.items_at)[both[1]]
        at = np.repeat(self.items_at[both[1]] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.unique(np.stack([np.repeat(both[0], count), self.items[at]]), axis=1).T

    def longest(self, item: int, place: np.ndarray, q: np.ndarray, words: int) -> tuple[int, int]:
        """Words of the longest match of a text with an item, and the word it starts at (the first of equal ones). q: distinct windows of the text by place."""
        full = self.size[q] == self.window
        row = np.full(words, -1, np.int64)
        row[place[full]] = q[full]
        best = (0, 0)
        for k in self.texts[item]:
            own = self.of[self.begin[k] : self.begin[k + 1]]
            if self.size[own[0]] < self.window:
                at = place[q == own[0]]
                found = (int(self.size[own[0]]), -int(at.min())) if len(at) else best
            else:
                n, at = common_run(row, own)
                found = (n + self.window - 1, -at) if n else best
            best = max(best, found)
        return best[0], -best[1]

    def matches(self, h: np.ndarray, first: np.ndarray):
        """Of a shard: word position and distinct window of each occurrence."""
        z = np.zeros(0, np.int64)
        if not len(self.size) or not len(h):
            return z, z
        i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[i] == h, i + 1, 0)
        # the next word that is unknown or in another text
        stop = np.full(len(h) + 1, len(h), np.int64)
        stop[np.flatnonzero(ids == 0)] = np.flatnonzero(ids == 0)
        run = np.minimum.accumulate(stop[::-1])[::-1][:-1]
        run = np.minimum(run, np.repeat(first[1:], np.diff(first))) - np.arange(len(h))
        at = np.flatnonzero(run >= self.least)
        if not len(at):
            return z, z
        keys = self.pack.rows(ids, at, run[at])
        order = np.lexsort(keys.T[::-1])
        keys, at = keys[order], at[order]  # the suffix array, to the window's depth
        low, high = _search(keys, self.low, "left"), _search(keys, self.high, "right")
        count = high - low
        q = np.repeat(np.arange(len(low)), count)
        return at[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(q))], q


def _search(keys: np.ndarray, wanted: np.ndarray, side: str) -> np.ndarray:
    """Binary search of all test suffixes at once in sorted rows of numbers."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    native, want = keys.astype(np.uint64), wanted.astype(np.uint64)
    while (live := lo < hi).any():
        mid = (lo + hi) // 2
        less, same = np.zeros(len(want), bool), np.ones(len(want), bool)
        row = native[np.minimum(mid, len(keys) - 1)]
        for k in range(native.shape[1]):
            less |= same & (row[:, k] < want[:, k])
            same &= row[:, k] == want[:, k]
        right = less | same if side == "right" else less
        lo, hi = np.where(live & right, mid + 1, lo), np.where(live & ~right, mid, hi)
    return lo


def common_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The longest run of numbers that a and b have in common, and its first place in a; -1 in a equals nothing."""
    n = max(len(a), len(b)) + 1
    with np.errstate(over="ignore"):
        power = np.full(n, np.uint64(0x9E3779B97F4A7C15))
        power[:1] = 1
        power = np.multiply.accumulate(power)
        back = np.full(n, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
        back[:1] = 1
        back = np.multiply.accumulate(back)
        apart = np.where(a < 0, -2 - np.arange(len(a)), a)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * power[: len(x)])]) for x in (apart, b)]

        def found(k):
            x, y = ((s[k:] - s[:-k]) * back[: len(s) - k] for s in sums)
            return np.flatnonzero(np.isin(x, y))

        lo, hi, at = 0, 1, 0
        while hi <= min(len(a), len(b)) and len(p := found(hi)):
            lo, at, hi = hi, int(p[0]), 2 * hi
        hi = min(hi, min(len(a), len(b)) + 1)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if len(p := found(mid)):
                lo, at = mid, int(p[0])
            else:
                hi = mid
    return lo, at


def _passes(benchmark: DataFrame, item_col: str, item_text: str, block: int, most: int):
    """The blocks of the benchmark, broadcast `most` at a time, and whether they are the last."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    cells = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    for begin in range(0, cells, most):
        out = []
        for k in range(begin, min(cells, begin + most)):
            rows = (items if cells == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(cells)) == k)).collect()
            out.append(benchmark.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows])))
        yield out, begin + most >= cells


class Shards:
    """Searches shards of a task for all blocks, one after another."""

    def __init__(self, blocks: list, window: int):
        self.blocks, self.window, self.kept = blocks, window, {}

    def test(self, k: int) -> TestSet:
        if k not in self.kept:
            if len(self.kept) > 3:
                self.kept.clear()
            self.kept[k] = TestSet(*self.blocks[k].value, self.window)
        return self.kept[k]

    def hits(self, column):
        """(first row, end row, first word of each text, 1 for each word that is hit, matches) by shard. matches: (test set, places, distinct windows)."""
        for i, j, data, off in chunks(column):
            h, first = _words(data, off)
            hit, found = np.zeros(len(h) + 1, np.int32), []
            for k in range(len(self.blocks)):
                test = self.test(k)
                pos, q = test.matches(h, first)
                if len(pos):
                    np.add.at(hit, pos, 1)
                    np.add.at(hit, pos + test.size[q], -1)
                    found.append((test, pos, q))
            yield i, j, first, np.cumsum(hit[:-1]) > 0, found


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block: int = BLOCK, most: int = PASS) -> DataFrame:
    """One row per document: words, words hit, and by item the longest match and the word it starts at."""
    small_batches(docs)

    def one_pass(blocks, keep):
        """keep: a pass follows, which reads the texts again."""

        def run(batches):
            shards = Shards(blocks, window)
            for b in batches:
                bits, known = b.column("bits").to_pylist(), b.column("found").to_pylist()
                for i, j, first, hit, matches in shards.hits(b.column("text")):
                    rows = []
                    best: list[dict] = [{x["item"]: (x["words"], x["at"]) for x in known[k] or ()} for k in range(i, j)]
                    for test, pos, q in matches:
                        text = np.searchsorted(first, pos, "right") - 1
                        begin = np.searchsorted(np.sort(text), np.arange(j - i + 1))
                        order = np.argsort(text, kind="stable")
                        for d, item in test.items_of(text, q).tolist():
                            own = order[begin[d] : begin[d + 1]]
                            new = test.longest(item, pos[own] - first[d], q[own], int(first[d + 1] - first[d]))
                            best[d][item] = min(best[d].get(item, new), new, key=lambda x: (-x[0], x[1]))
                    for d in range(j - i):
                        own = hit[first[d] : first[d + 1]]
                        if before := bits[i + d]:
                            own = own | np.unpackbits(np.frombuffer(before, np.uint8), count=len(own)).astype(bool)
                        rows.append((len(own), np.packbits(own).tobytes() if own.any() else b"", int(own.sum()), [(k, *best[d][k]) for k in sorted(best[d])]))
                    n, own, n_hit, found = zip(*rows)
                    text = b.column("text").slice(i, j - i) if keep else pa.nulls(j - i, pa.string())
                    yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), text, pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(n_hit, pa.int64()), pa.array([[dict(zip(("item", "words", "at"), y)) for y in x] for x in found], FOUND_ARROW)], names=["id", "text", "n_words", "bits", "n_hit", "found"])

        return run

    state = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("bits"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast(FOUND).alias("found"))
    for k, (blocks, last) in enumerate(_passes(benchmark, item_col, item_text, block, most)):
        state = (cut(state) if k else state).mapInArrow(one_pass(blocks, not last), f"id long, text string, n_words long, bits binary, n_hit long, found {FOUND}")
    column = lambda x: F.col("found")[x]
    return state.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), column("item").alias("items"), column("words").alias("longest"), column("at").alias("longest_at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block: int = BLOCK, most: int = PASS) -> DataFrame:
    """The rows of docs without a hit word, as they are, judged where they stand."""
    at, kept = docs.columns.index(text_col), docs

    def one_pass(blocks):
        def run(batches):
            shards = Shards(blocks, window)
            for b in batches:
                for i, j, first, hit, _ in shards.hits(b.column(at).cast(pa.string())):
                    total = np.concatenate([[0], np.cumsum(hit)])[first]
                    yield b.slice(i, j - i).filter(pa.array(total[1:] == total[:-1]))

        return run

    for k, (blocks, _) in enumerate(_passes(benchmark, item_col, item_text, block, most)):
        kept = (cut(kept) if k else kept).mapInArrow(one_pass(blocks), docs.schema)
    return kept


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.concat_ws(",", F.transform("longest", lambda x: x.cast("string"))).alias("longest"))
