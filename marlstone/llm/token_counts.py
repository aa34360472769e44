"""Token counts by offset-mapped attribution.

Each document is encoded once, whole.  Its fields (columns, in order, joined by
a separator) and their sections (lines) tile the character axis, so an interval
join of token spans with section spans is a binary search on section starts.  A
token that crosses a border goes to one section by an explicit rule:

``first``  the section of the token's first character (default)
``last``   the section of its last character
``most``   the section with most of its characters; of equals the earlier

A separator or line end belongs to the section it closes, so sections tile the
document and the counts of a document always add up to its number of tokens.

Defined results: null fields are left out; a document whose fields are all null
or empty has one empty section with no tokens; a null id is carried through;
repeated rows each get their sections; an empty table gives no rows; ties of the
rule ``most`` go to the earlier section; texts are never cut, and a worker holds
one long document at a time; other columns are ignored, and those made here are
the only ones beside the id, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import load
from .common import ship, small

RULES = ("first", "last", "most")


def token_spans(lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (inclusive) of each token, from byte lengths."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if raw.size == len(text):
        return starts, ends - 1
    char_at = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character each byte belongs to
    return char_at[starts], char_at[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, begins: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and per section those of them that cross a border."""
    a = np.searchsorted(begins, first, side="right") - 1
    b = np.searchsorted(begins, last, side="right") - 1
    owner = a.copy() if rule != "last" else b.copy()
    crossing = a != b
    if rule == "most":
        for k in np.flatnonzero(crossing).tolist():
            cuts = [first[k], *begins[a[k] + 1 : b[k] + 1], last[k] + 1]
            owner[k] = a[k] + int(np.argmax(np.diff(cuts)))
    n = begins.size
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_starts(parts: Sequence[str], separator: str, by_line: bool) -> tuple[list[int], list[int]]:
    """Start of each section and the number of the field it is in."""
    starts, fields, at = [], [], 0
    for k, part in enumerate(parts):
        whole = part + (separator if k + 1 < len(parts) else "")
        lines = whole.split("\n") if by_line else [whole]
        for i, line in enumerate(lines):
            length = len(line) + (i + 1 < len(lines))
            if length:
                starts.append(at)
                fields.append(k)
            at += length
    return starts or [0], fields or [0]


def token_counts(docs: DataFrame, vocab_path: str, fields: Sequence[str] = ("text",), id_col: str = "doc_id", rule: str = "first", separator: str = "\n\n", by_line: bool = True) -> DataFrame:
    """A row per document and section: id, ``field``, ``section``, ``char_start``,
    ``char_end`` (exclusive), ``n_tokens``, ``n_crossing`` (of these, tokens that cross a border).

    A narrow map: no shuffle; every document is encoded once.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("field", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("section", "char_start", "char_end", "n_tokens", "n_crossing"))])
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in small(batches, *range(1, len(names) + 1)):
            rows, columns = [], [batch.column(k + 1).to_pylist() for k in range(len(names))]
            numbers: list[np.ndarray] = []
            labels: list[str] = []
            for k in range(batch.num_rows):
                got = [(name, c[k]) for name, c in zip(names, columns, strict=True) if c[k] is not None] or [(names[0], "")]
                starts, of = section_starts([x for _, x in got], separator, by_line)
                text = separator.join(x for _, x in got)
                begins = np.array(starts, dtype=np.int64)
                lengths = bpe.lengths[np.frombuffer(bpe.encode(text), dtype="<u4")]
                first, last = token_spans(lengths, text)
                tokens, crossing = attribute(first, last, begins, rule)
                numbers.append(np.stack([np.arange(begins.size), begins, np.append(begins[1:], len(text)), tokens, crossing]))
                labels += [got[x][0] for x in of]
                rows.append(begins.size)
            take = pa.array(np.repeat(np.arange(batch.num_rows), rows))
            table = np.concatenate(numbers, axis=1) if numbers else np.zeros((5, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(labels, pa.string()), *(pa.array(x.astype(np.int64)) for x in table)], names=out.names)

    return docs.select(F.col(f"`{id_col}`"), *(F.col(f"`{c}`").cast("string") for c in names)).mapInArrow(run, out)
