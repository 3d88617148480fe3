"""op7: sum-of-squares online packing of token sequences.

Each scan partition is packed on its own, in one pass and without a shuffle. Documents are cut at
whole windows; what is left of one goes to the fill level h that makes the sum of squared counts of
partly filled windows least, where the counts stand in an array by level. When the partition ends (or
MOST windows are open, which bounds memory), the emptiest of the windows still open give their tokens, cut
where need be, to fill the gaps of the fullest, until one is left; the partition's last one is split at powers
of two, which are not padded. All other tokens stay where the sum of squares has put them.

Nulls: a null text is empty and holds its end id alone; a null doc_id is packed and stays null. Repeated
rows are packed each. An empty table gives no rows. Texts of any length stream piece by piece.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._run import table, text_column

MOST = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


class Encoder:
    """Ids of a byte-level BPE. The ranks file holds the JSON's vocabulary; texts with the name of a special token go through the JSON's own encoder."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        lines = [x.split() for x in open(ranks_path, "rb") if x.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self._slow = json_path, None
        self.sizes = np.zeros(max(ranks.values()) + 2, np.int32)
        for k, v in ranks.items():
            self.sizes[v] = len(k)
        self.special = "<|endoftext|>"
        self.sizes[-1] = len(self.special)

    def slow(self):
        if self._slow is None:
            self._slow = Tokenizer.from_file(self.json_path)
        return self._slow

    def ids(self, text: str) -> np.ndarray:
        if self.special in text:
            return np.array(self.slow().encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text).astype(np.uint32, copy=False)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(json_path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """One for each Python worker; the vocabulary files are installed on every node."""
    key = (json_path or P.path("byte_bpe_50k.json"), ranks_path or P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


class Packer:
    """Sum-of-squares placement for one partition. `window`: tokens a sequence holds; `most`: open windows; placed, moved: tokens that the sum of squares has put in place, and those of them dealt again."""

    def __init__(self, window: int, base: int, most: int = MOST):
        self.window, self.next, self.most, self.live = window, base, most, 0
        self.placed = self.moved = 0
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list] = [[] for _ in range(window + 1)]
        self.out: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for s in range(0, whole, w):
            self._emit([(doc, s, ids[s : s + w], n)])
        if whole == n:
            return
        piece, size, c = (doc, whole, ids[whole:], n), n - whole, self.counts
        # change of the sum of squares if a window of level h (0: a new one) takes the piece
        top = w - size
        gain = np.zeros(top + 1, np.int64)
        gain[1:] = np.where(c[1 : top + 1] > 0, 1 - 2 * c[1 : top + 1], np.iinfo(np.int64).max // 4)
        gain[:-1] += 1 + 2 * c[size : size + top] if top else 0
        best = top - int(np.argmin(gain[::-1]))
        pieces = self.open[best].pop() if best else []
        if best:
            c[best] -= 1
            self.live -= 1
        pieces.append(piece)
        self.placed += size
        self._put(pieces, best + size)
        if self.live > self.most:
            left = self._level()
            self.open, self.counts, self.live = [[] for _ in range(w + 1)], np.zeros(w + 1, np.int64), 0
            self._put(left, sum(len(x[2]) for x in left))

    def _put(self, pieces: list, level: int) -> None:
        if level == self.window:
            self._emit(pieces)
        elif level:
            self.open[level].append(pieces)
            self.counts[level] += 1
            self.live += 1

    def _level(self) -> list:
        """Fill the fullest open windows from the emptiest; the pieces of the one that is left."""
        rows = [pieces for level in range(self.window, 0, -1) for pieces in self.open[level]]
        i, j = 0, len(rows) - 1
        while i < j:
            gap = self.window - sum(len(x[2]) for x in rows[i])
            while gap and i < j:
                if not rows[j]:
                    j -= 1
                    continue
                doc, start, ids, total = rows[j].pop()
                k = min(len(ids), gap)
                # the end of the piece goes first, so that what stays is one piece
                rows[i].append((doc, start + len(ids) - k, ids[len(ids) - k :], total))
                if k < len(ids):
                    rows[j].append((doc, start, ids[: len(ids) - k], total))
                gap -= k
                self.moved += k
            if not gap:
                self._emit(rows[i])
                i += 1
        return rows[i] if i < len(rows) else []

    def close(self) -> None:
        """Level what stands in open windows, cutting freely, and split the last one."""
        row = self._level()
        fill = sum(len(x[2]) for x in row)
        while fill:  # the binary digits of what is left
            size, part, got = 1 << (fill.bit_length() - 1), [], 0
            while got < size:
                doc, start, ids, total = row.pop(0)
                k = min(len(ids), size - got)
                part.append((doc, start, ids[:k], total))
                got += k
                if k < len(ids):
                    row.insert(0, (doc, start + k, ids[k:], total))
            self._emit(part)
            fill -= size
        self.open, self.counts, self.live = [[] for _ in range(self.window + 1)], np.zeros(self.window + 1, np.int64), 0

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [[]] * 7
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=ARROW)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, json_path: str | None = None, ranks_path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row for each piece of a document; sequence ids are dense within a partition and start at partition * 2**33."""

    def run(batches):
        enc, packer, end = encoder(json_path, ranks_path), None, np.array([end_id], np.uint32)
        for b in batches:
            if packer is None:
                packer = Packer(window, b.column(2)[0].as_py() << 33 if b.num_rows else 0)
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(doc, np.concatenate([enc.ids(text or ""), end]))
                if len(packer.out) > 4096:
                    yield packer.flush()
        if packer is not None:
            packer.close()
            yield packer.flush()

    return text_column(docs, id_col, text_col).withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
