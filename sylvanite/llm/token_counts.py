"""op5: token counts of the sections of each document, by offset-mapped attribution.

A document is encoded once. Tokens and sections (by default lines; the line end belongs to the section
before it) are both sorted runs of byte offsets, so one merge of the two sorted lists joins them. Rule for
tokens that cross a boundary: `start` gives the token to the section of its first byte, `largest` to the
section that holds most of its bytes (the earlier one on ties).

Null or empty text: one empty section, no tokens. A null doc_id stays null. Repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._run import table, text_column
from .packing import encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_sections long, n_crossing long, max_section_tokens long, section_tokens array<long>"
ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_bytes", "n_tokens", "n_sections", "n_crossing", "max_section_tokens")] + [("section_tokens", pa.list_(pa.int64()))])


def attribute(sizes: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary. sizes: bytes of each token; starts: where each section begins."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.maximum(first, np.searchsorted(starts, ends - 1, "right") - 1)
    crossing = np.flatnonzero(last > first)
    owner = first
    if rule == "largest":
        stops = np.append(starts[1:], ends[-1] if len(ends) else 0)
        for t in crossing:
            s = np.arange(first[t], last[t] + 1)
            owner[t] = s[np.argmax(np.minimum(stops[s], ends[t]) - np.maximum(starts[s], begins[t]))]
    return np.bincount(owner, minlength=len(starts)), len(crossing)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    if rule not in ("start", "largest"):
        raise ValueError(f"unknown rule {rule!r}")

    def run(batches):
        enc = encoder(json_path, ranks_path)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part, rows = b.slice(k, 512), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = np.frombuffer((text or "").encode(), np.uint8)
                    ids = enc.ids(text or "")
                    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                    counts, crossing = attribute(enc.sizes[ids].astype(np.int64), starts, rule)
                    rows.append((doc, len(raw), len(ids), len(starts), crossing, int(counts.max()), counts))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)

    return text_column(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
