"""op2: corpus-wide line dedup that keeps a repeated line only in the largest doc_id holding it.

Documents give one row for each distinct key: a 128-bit hash, the doc_id and the lines' positions. The rows
are range-partitioned by (hash, doc_id descending), so that even a key with a third of all rows is dealt over
many partitions, and sorted the same way. Each partition streams its runs of equal hashes: the first document
of a run is the one that keeps its lines. Runs that touch a partition's edge are settled through their
summaries (two for each partition). What returns is one bitmap of dropped lines for each document, compressed
with zlib; texts are never shuffled for the decision.

A null or empty text is one empty line. Documents are told apart by doc_id: rows that repeat a doc_id count
once towards `min_docs`, and all of them keep their lines if it is the largest; a null doc_id is one more
document, smaller than all others. Lines of the same key in one document are kept or dropped together.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import cut, parallelism, small_batches, table
from ._text import chunks, hashed, lowered

LOWEST = -(2**63)
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

LINES = "h1 long, h2 long, doc long, tag long, lines binary"
LINES_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("lines", pa.binary())])
#: kind 0: lines to drop; 1: a run at a partition's edge; 2: a row of such a run
FOUND = "kind int, h1 long, h2 long, doc long, tag long, n_docs long, lines binary"
FOUND_ARROW = pa.schema([("kind", pa.int32()), *[(x, pa.int64()) for x in ("h1", "h2", "doc", "tag", "n_docs")], ("lines", pa.binary())])


def line_spans(data: np.ndarray, off: np.ndarray):
    """Starts and ends of all lines, and the first line of each text."""
    nl = np.flatnonzero(data == 10)
    per = np.searchsorted(nl, off[1:]) - np.searchsorted(nl, off[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per)])
    # texts that are empty share an offset with their neighbour, so lines are laid out by text
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    starts[first[:-1]] = off[:-1]
    ends[first[1:] - 1] = off[1:]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[inner] = nl + 1
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    ends[inner] = nl
    return starts, ends, first


def keys(data: np.ndarray, off: np.ndarray, min_chars: int):
    """The lines that are long enough: number among all lines and the two halves of the key's hash; and the first line of each text."""
    starts, ends, first = line_spans(data, off)
    solid = np.concatenate([[0], np.cumsum(~BLANKS[data])])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    where = np.flatnonzero(~BLANKS[data]) if len(data) else np.zeros(0, np.int64)
    some = np.flatnonzero(solid[ends] > solid[starts])
    s, e = where[solid[starts[some]]], where[solid[ends[some]] - 1] + 1
    long = points[e] - points[s] >= min_chars
    some, s, e = some[long], s[long], e[long]
    low = lowered(data)
    return some, hashed(low, s, e, 1).view(np.int64), hashed(low, s, e, 2).view(np.int64), first


def _lines(min_chars: int):
    def run(batches):
        for b in batches:
            doc, tag = np.asarray(b.column(0)), np.asarray(b.column(1))
            for i, j, data, off in chunks(b.column(2)):
                at, h1, h2, first = keys(data, off, min_chars)
                if not len(at):
                    continue
                owner = np.searchsorted(first, at, "right") - 1
                local = (at - first[owner]).astype("<u4")
                order = np.lexsort((local, h2, h1, owner))
                owner, h1, h2, local = owner[order], h1[order], h2[order], local[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                begin = np.flatnonzero(new)
                bounds = np.append(begin, len(owner)).astype(np.int32) * 4
                lines = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(local.tobytes())])
                own = owner[begin] + i
                yield pa.RecordBatch.from_arrays([pa.array(h1[begin]), pa.array(h2[begin]), pa.array(doc[own]), pa.array(tag[own]), lines], schema=LINES_ARROW)

    return run


def _stream(min_docs: int):
    """Sorted rows in; drops, edge runs and their rows out. A run's rows wait until it has min_docs documents or ends, so at most those of min_docs documents are held."""

    def run(batches):
        rows: list[tuple] = []
        run_key, best, n_docs, last, held, edge = None, None, 0, None, [], True

        def close(at_end):
            # the run's rows that wait are of too few documents, unless it goes on in a neighbour
            if run_key is not None and (edge or at_end):
                rows.append((1, *run_key, best, 0, n_docs, None))
                rows.extend((2, *run_key, d, t, 0, x) for d, t, x in held)

        def flush():
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), FOUND_ARROW.types)], schema=FOUND_ARROW)
            rows = []
            return out

        for b in batches:
            if not b.num_rows:
                continue
            h1, h2, doc, tag = (np.asarray(b.column(k)) for k in range(4))
            text = b.column(4)
            same = np.zeros(len(h1) + 1, bool)  # a row equal in hash to the one before it
            same[1:-1] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            # rows that stand alone inside the batch are of one document and never dropped
            busy = same[:-1] | same[1:]
            busy[0] = busy[-1] = True
            for k in np.flatnonzero(busy):
                key = (int(h1[k]), int(h2[k]))
                if key != run_key:
                    close(False)
                    edge = run_key is None
                    run_key, best, n_docs, last, held = key, int(doc[k]), 0, None, []
                d = int(doc[k])
                if d != last:
                    n_docs, last = n_docs + 1, d
                row = (d, int(tag[k]), text[k].as_py())
                if edge:
                    rows.append((2, *key, *row[:2], 0, row[2]))
                elif n_docs < min_docs:
                    held.append(row)
                else:
                    for x in held:
                        if x[0] != best:
                            rows.append((0, *key, x[0], x[1], 0, x[2]))
                    held = [x for x in held if x[0] == best]
                    if d != best:
                        rows.append((0, *key, *row[:2], 0, row[2]))
                    else:
                        held.append(row)
            if len(rows) > 20000:
                yield flush()
        if run_key is not None:
            close(True)
        if rows:
            yield flush()

    return run


def _bitmap(parts) -> bytes:
    at = np.concatenate([np.frombuffer(x, "<u4") for x in parts])
    bits = np.zeros(int(at.max()) + 1, np.uint8)
    bits[at] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tag, drop): for each document with lines to drop a zlib-compressed bitmap of them, lowest bit first. doc: the doc_id, or the least long for null; tag: a hash of the text."""
    lines = _source(docs, id_col, text_col).mapInArrow(_lines(min_chars), LINES)
    dealt = lines.repartitionByRange(parallelism(docs), "h1", "h2", F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc())
    found = cut(dealt.mapInArrow(_stream(min_docs), FOUND))
    # at most two runs for each partition: small, whatever the input
    edges = found.where("kind = 1").groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc").alias("best"))
    late = found.where("kind = 2").drop("n_docs").join(F.broadcast(edges), ["h1", "h2"]).where((F.col("docs") >= min_docs) & (F.col("doc") < F.col("best")))
    drops = found.where("kind = 0").select("doc", "tag", "lines").union(late.select("doc", "tag", "lines"))
    grouped = drops.groupBy("doc", "tag").agg(F.collect_list("lines").alias("parts"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_bitmap(x) for x in b.column(2).to_pylist()], pa.binary())], ["doc", "tag", "drop"])

    return grouped.mapInArrow(run, "doc long, tag long, drop binary")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def keep(text: str, drop: bytes | None) -> tuple[int, int, str]:
    """Lines, dropped lines and what is left of a text."""
    if drop is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(drop), np.uint8), bitorder="little").tolist()
    left = [x for x, d in zip(lines, bits + [0] * (len(lines) - len(bits))) if not d]
    return len(lines), len(lines) - len(left), "\n".join(left)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, tag): whole rows as structs, so that no column of theirs can clash, with their key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), F.xxhash64(text).alias("tag"))


def with_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(row, drop): each row of docs as a struct with its bitmap, null where nothing goes."""
    return keyed(docs, id_col, text_col).join(dropped_lines(docs, id_col, text_col, **options), ["doc", "tag"], "left").select("row", "drop")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the dropped lines gone from the text."""

    @F.pandas_udf("string")
    def left(text, drop):
        return text.where(drop.isna(), [None if d is None else keep(t or "", d)[2] for t, d in zip(text, drop)])

    old = F.col("row")[text_col]
    new = F.when(F.col("drop").isNull(), old).otherwise(left(old, F.col("drop")))
    return with_drops(docs, id_col, text_col, **options).select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


SUMMARY = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def _summary(batches):
    for b in batches:
        rows = [keep(t or "", d) for t, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        sha = [hashlib.sha256(x[2].encode()).hexdigest() for x in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array(sha, pa.string())], schema=SUMMARY)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_drops(docs).select("row.doc_id", "row.text", "drop").mapInArrow(_summary, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, max(doc_id) AS best FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.doc_id, line, pos, coalesce(keyed.doc_id < often.best, false) AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
