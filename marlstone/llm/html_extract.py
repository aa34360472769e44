"""Main text of web pages by a linear-chain conditional random field.

A page is a sequence of leaf blocks.  Each block has features of its ancestors
(tags, words of class and id names, landmarks) and of its text (length, links,
punctuation, position); neighbours are tied by transition weights.  The field is
trained on labelled pages by gradient ascent on the conditional likelihood and
decoded by Viterbi; the blocks labelled as article are the text, one a line.

Training is a small job of the driver over pages it makes itself; the weights (a
few hundred numbers) are broadcast.  Extraction is a narrow map, with no shuffle.

Defined results: a null or empty page, or one without text, gives the empty
string; repeated rows give equal results; long pages are handled whole; broken
markup never fails; other columns are carried through, except those made here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, small
from .html_blocks import Leaf, leaves
from .html_training import MARK, labelled_pages

STEPS, RATE, PENALTY = 180, 0.1, 0.02
#: Features of fewer training pages say nothing.
MIN_PAGES = 3
#: Words that tell about short blocks.
HINTS = {
    "cookie": "cookie", "cookies": "cookie", "privacy": "legal", "copyright": "legal", "rights": "legal", "©": "legal", "advertisement": "ad", "sponsored": "ad", "subscribe": "ask", "newsletter": "ask", "login": "ask", "sign": "ask",
    "share": "share", "follow": "share", "comment": "reply", "comments": "reply", "reply": "reply", "says:": "reply",
}


def text_features(leaf: Leaf, k: int, n: int) -> list[str]:
    text = leaf.text
    size = len(text)
    words = text.count(" ") + 1
    links = min(leaf.linked / size, 1.0)
    density = "none" if links == 0 else "some" if links < 0.4 else "most"
    length = "1" if size < 15 else "2" if size < 40 else "3" if size < 90 else "4" if size < 200 else "5"
    out = [f"length:{length}", f"links:{density}", f"links:{density}:{length}", f"end:{'stop' if text[-1] in '.!?…。' else 'open'}:{length}", f"tag:{leaf.element.tag}", f"tag:{leaf.element.tag}:{density}"]
    if words < 15:
        out += {f"hint:{HINTS[w]}" for w in text.lower().split() if w in HINTS}
    if text[0] == "©":
        out.append("starts:©")
    out.append("where:first" if k == 0 else "where:last" if k == n - 1 else "where:early" if k * 4 < n else "where:late" if k * 4 > 3 * n else "where:middle")
    return out


def path_features(leaf: Leaf) -> list[str]:
    marks = leaf.element.landmarks
    return [*leaf.element.features, *leaf.element.nearest, f"landmarks:{'>'.join(marks) or '-'}", f"landmark:{marks[-1] if marks else '-'}"]


class Field:
    """Weights: of features for the label 1 (label 0 has none), of transitions,
    and of either label at both ends."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray, ends: np.ndarray) -> None:
        self.weights, self.transitions, self.ends = weights, transitions.tolist(), ends.tolist()
        self._paths: dict[tuple, float] = {}

    def score(self, leaf: Leaf, k: int, n: int) -> float:
        """How much the label 1 gains over 0."""
        key = (leaf.element.features, leaf.element.landmarks, leaf.element.nearest)
        path = self._paths.get(key)
        get = self.weights.get
        if path is None:
            path = sum(get(f, 0.0) for f in sorted(path_features(leaf)))
            if len(self._paths) > 20_000:
                self._paths.clear()
            self._paths[key] = path
        return path + sum(get(f, 0.0) for f in text_features(leaf, k, n))

    def decode(self, blocks: list[Leaf]) -> list[bool]:
        """The most probable labels (Viterbi)."""
        n = len(blocks)
        if not n:
            return []
        (t00, t01), (t10, t11) = self.transitions
        (b0, b1), (e0, e1) = self.ends
        back, zero, one = [], b0, b1 + self.score(blocks[0], 0, n)
        for k in range(1, n):
            to0, to1 = one + t10 > zero + t00, one + t11 > zero + t01
            back.append((to0, to1))
            zero, one = max(zero + t00, one + t10), max(zero + t01, one + t11) + self.score(blocks[k], k, n)
        label = one + e1 > zero + e0
        out = [label]
        for to0, to1 in reversed(back):
            label = to1 if label else to0
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        blocks = leaves(page)
        return "\n".join(b.text for b, keep in zip(blocks, self.decode(blocks), strict=True) if keep)


def train(pages: list[str], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """Fit on pages whose article text begins with ``MARK``."""
    labels, sizes, found, of_pages = [], [], [], Counter()
    for page in pages:
        blocks = leaves(page)
        if not blocks:
            continue
        sizes.append(len(blocks))
        for k, b in enumerate(blocks):
            labels.append(MARK in b.text)
            b.text = b.text.replace(MARK, "").strip() or "-"
            found.append({*path_features(b), *text_features(b, k, len(blocks))})
        of_pages.update(set().union(*found[-len(blocks) :]))
    index = {f: k for k, f in enumerate(sorted(f for f, n in of_pages.items() if n >= MIN_PAGES))}
    rows, columns = [], []
    for k, features in enumerate(found):
        known = sorted(index[f] for f in features if f in index)
        rows += [k] * len(known)
        columns += known
    size, y = np.array(sizes), np.array(labels, int)
    n, longest = size.size, int(size.max())
    begin = np.cumsum(size) - size
    page_of = np.repeat(np.arange(n), size)
    step_of = np.arange(y.size) - begin[page_of]
    row, col = np.array(rows), np.array(columns)
    last = size - 1
    alive = np.arange(longest)[:, None] < size[None, :]
    gold = np.zeros((longest, n), int)
    gold[step_of, page_of] = y
    truth = np.zeros((2, 2))
    both = alive[1:]
    np.add.at(truth, (gold[:-1][both], gold[1:][both]), 1)
    truth_ends = np.stack([np.bincount(gold[0], minlength=2), np.bincount(gold[last, np.arange(n)], minlength=2)]).astype(float)
    emitted = np.bincount(col, y[row], minlength=len(index))
    params = np.zeros(len(index) + 8)
    mean, var = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, trans, ends = params[:-8], params[-8:-4].reshape(2, 2), params[-4:].reshape(2, 2)
        score = np.zeros((longest, n, 2))
        score[step_of, page_of, 1] = np.bincount(row, w[col], minlength=y.size)
        # Forward and backward sums in log space, all pages at once.
        alpha, beta = np.empty_like(score), np.empty_like(score)
        alpha[0] = score[0] + ends[0]
        for k in range(1, longest):
            nxt = np.logaddexp.reduce(alpha[k - 1][:, :, None] + trans, axis=1) + score[k]
            alpha[k] = np.where(alive[k][:, None], nxt, alpha[k - 1])
        z = np.logaddexp.reduce(alpha[-1] + ends[1], axis=1)
        beta[-1] = ends[1]
        for k in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(trans + (score[k + 1] + beta[k + 1])[:, None, :], axis=2)
            beta[k] = np.where(alive[k + 1][:, None], nxt, ends[1])
        p = np.exp(alpha + beta - z[:, None]) * alive[:, :, None]
        pair = np.exp(alpha[:-1][:, :, :, None] + trans + (score[1:] + beta[1:])[:, :, None, :] - z[:, None, None]) * both[:, :, None, None]
        gradient = np.concatenate([emitted - np.bincount(col, p[step_of, page_of, 1][row], minlength=len(index)), (truth - pair.sum(axis=(0, 1))).ravel(), (truth_ends - np.stack([p[0].sum(axis=0), p[last, np.arange(n)].sum(axis=0)])).ravel()])
        gradient -= penalty * params
        mean, var = 0.9 * mean + 0.1 * gradient, 0.99 * var + 0.01 * gradient**2
        params = params + rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
    return Field(dict(zip(index, params[:-8].tolist(), strict=True)), params[-8:-4].reshape(2, 2), params[-4:].reshape(2, 2))


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extract_text(pages: DataFrame, html_col: str = "html", field: Field | None = None) -> DataFrame:
    """``pages`` with the column ``text`` in place of the HTML."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    rest = [f for f in pages.schema.fields if f.name != html_col and f.name.lower() != "text"]
    out = T.StructType([*rest, T.StructField("text", T.StringType())])
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in small(batches, n):
            texts = [field.extract(x.as_py()) for x in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=out.names)

    return pages.select(*(F.col(f"`{f.name}`") for f in rest), F.col(f"`{html_col}`").cast("string")).mapInArrow(run, out)
