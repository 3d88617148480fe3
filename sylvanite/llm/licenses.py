"""op8: license scans by the Dice coefficient over word bigrams.

Texts are normalised (A-Z lower-cased, words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; line ends are blanks like others) and
compared with templates, full licence texts and short notices alike, in windows of their words: wherever a notice stands,
in a line of its own, inside a paragraph or in a text without line ends, it is found. Dice is 2 * |A & B| / (|A| + |B|)
over sets of bigrams. It can reach the threshold t for a template of b bigrams only with need = ceil(b * t / (2 - t)) of
them, and windows are of need to b * (2 - t) / t bigrams. An index from bigrams to templates counts a text's distinct
bigrams of each template, and templates with less than `need` are dropped before any window is looked at.

Windows begin and end with a bigram of the template. Of those that begin at a place the one of the highest score counts
(of equal ones the shortest); of these the best are taken, the highest score first (of equal ones the first), without
overlap. A document's matches are all of these with a score of t or more, for each template on its own.

Null, empty and one-word texts match nothing. Templates are a parameter, {name: text}, of two words at least; equal
templates all match. A null doc_id stays null; repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import small_batches, table
from ._text import ALNUM, buffer, chunks, hashed, lowered, spans
from .license_texts import NOTICES, TEXTS

TEMPLATES = TEXTS | NOTICES

SCHEMA = "doc_id long, n_words long, n_matches long, licenses array<string>, best_license string, best_score double, match_lines array<long>"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_matches", pa.int64()), ("licenses", pa.list_(pa.string())), ("best_license", pa.string()), ("best_score", pa.float64()), ("match_lines", pa.list_(pa.int64()))])


def bigrams(data: np.ndarray, off: np.ndarray):
    """Hash of each bigram, where each text's begin, where each begins in the bytes, and words of each text."""
    low = lowered(data)
    s, e, first = spans(low, off, ALNUM)
    h, n = hashed(low, s, e), np.diff(first)
    count = np.maximum(n - 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    with np.errstate(over="ignore"):
        g = h[at] * np.uint64(0x9E3779B97F4A7C15) + (h[at + 1] ^ (h[at + 1] >> np.uint64(31)))
    return g, begin, s[at], n


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.names, self.t = sorted(templates), threshold
        g, begin, _, n = bigrams(*buffer(pa.array([templates[x] for x in self.names], pa.string())))
        if len(n) and n.min() < 2:
            raise ValueError("a template has two words at least")
        self.own = [np.unique(g[a:z]) for a, z in zip(begin[:-1], begin[1:])]
        size = np.array([len(x) for x in self.own], np.int64)
        self.need = np.maximum(1, np.ceil(size * threshold / (2 - threshold) - 1e-9)).astype(np.int64)
        self.most = np.floor(size * (2 - threshold) / threshold + 1e-9).astype(np.int64)
        # postings: the templates of each bigram
        gram, of = np.concatenate([g[:0], *self.own]), np.repeat(np.arange(len(size)), size)
        order = np.argsort(gram, kind="stable")
        self.gram, at = np.unique(gram[order], return_index=True)
        self.of, self.at = of[order], np.append(at, len(gram))

    def candidates(self, g: np.ndarray, begin: np.ndarray):
        """(text, template) pairs with enough distinct bigrams in common."""
        if not len(self.gram) or not len(g):
            return
        k = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        hit = np.flatnonzero(self.gram[k] == g)
        text = np.searchsorted(begin, hit, "right") - 1
        seen = np.unique(text * len(self.gram) + k[hit])  # distinct bigrams of each text
        text, gram = np.divmod(seen, len(self.gram))
        count = np.diff(self.at)[gram]
        posting = np.repeat(self.at[gram] - np.cumsum(count) + count, count) + np.arange(count.sum())
        pair, n = np.unique(np.repeat(text, count) * len(self.names) + self.of[posting], return_counts=True)
        for p in pair[n >= self.need[pair % len(self.names)]].tolist():
            yield divmod(p, len(self.names))

    def matches(self, g: np.ndarray, before: np.ndarray, k: int):
        """(score, first bigram, end) of the matches of template k in a text. before: the place of each bigram's equal before it, or -1."""
        own, need, most = self.own[k], int(self.need[k]), int(self.most[k])
        inside = own[np.minimum(np.searchsorted(own, g), len(own) - 1)] == g
        at, found = np.flatnonzero(inside), []
        ahead = np.searchsorted(at, at + most) - np.arange(len(at))
        for s in at[ahead >= need].tolist():
            e = min(len(g), s + most)
            new, held = before[s:e] < s, inside[s:e]
            both = np.cumsum(new & held)
            d = np.where(held, 2 * both / (np.cumsum(new) + len(own)), 0)
            d[: need - 1] = 0
            best = int(np.argmax(d))
            if d[best] >= self.t:
                found.append((-float(d[best]), s, s + best + 1))
        taken = []
        for d, s, e in sorted(found):
            if all(e <= a or z <= s for _, a, z in taken):
                taken.append((-d, s, e))
        return taken


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_matches, licenses, best_license, best_score, match_lines: lines where matches begin) for every row."""
    small_batches(docs)
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(templates, threshold)
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                g, begin, byte, words = bigrams(data, off)
                ends, rows, known = np.flatnonzero(data == 10), [[] for _ in range(j - i)], (None, None)
                for d, k in scanner.candidates(g, begin):
                    own = g[begin[d] : begin[d + 1]]
                    if known[0] != d:
                        order, before = np.argsort(own, kind="stable"), np.full(len(own), -1)
                        same = own[order][1:] == own[order][:-1]
                        before[order[1:][same]] = order[:-1][same]
                        known = d, before
                    for score, s, _ in scanner.matches(own, known[1], k):
                        line = np.searchsorted(ends, byte[begin[d] + s]) - np.searchsorted(ends, off[d])
                        rows[d].append((-score, scanner.names[k], int(line)))
                out = []
                for found in rows:
                    top = min(found, default=(-0.0, None))
                    out.append((len(found), sorted({x[1] for x in found}), top[1], -top[0], sorted({x[2] for x in found})))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words, pa.int64()), *(pa.array(list(c), t) for c, t in zip(zip(*out), ARROW.types[2:]))], schema=ARROW)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from a folder of text files, named as the files are: for licences beside those of license_texts."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.txt)?$", 1).alias("name"), "value")
    return {r["name"]: r["value"] for r in rows.collect()}


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
