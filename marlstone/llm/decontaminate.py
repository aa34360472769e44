"""Benchmark decontamination: a prefix-filtered set join with exact windows.

Every benchmark item is cut into windows of ``window`` words (an item with fewer
words, but some, is one window).  A document contains a window only if it has
all of its shingles, so for containment 1 the necessary prefix of a window,
with its shingles ordered by rarity in the corpus, is its rarest shingle.  Only
occurrences of that shingle are looked at: the shingle's position gives where
the window would start, windows that would leave the document are dropped, and
the rest is compared word by word.

A benchmark whose text is at most ``BROADCAST_BYTES``, measured, is one index that
every task gets: two narrow passes over the documents, no shuffle of texts.  One
counts the benchmark's shingles in all documents, one looks windows up.

A larger benchmark is a table.  Documents are passed three times whatever its
size: to count the shingles that a bitmap of the benchmark's lets through, to send
those that are some window's prefix, with the words around them, to the window's
row (a join on the shingle's hash), and to put what was found beside each
document.  The bitmap has a fixed number of bits at most; where it is crowded, more
shingles pass and the join decides.  Found windows are kept per different text,
so copies of a text cost nothing more.

Defined results: null or empty texts and items have no words; repeated items
with one id count once; an item without an id is named by the empty string;
repeated documents get equal results; without items nothing is hit; an empty
table gives no rows; long texts are handled whole; the columns made here
replace others of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WordHashes, materialise, mix, ship, small

WINDOW, SHINGLE = 8, 3
#: Benchmark text, with its ids, in one broadcast index; a larger benchmark is joined.
BROADCAST_BYTES = 4 << 20
#: Bits of the bitmap for each of the benchmark's shingles, and at most; bits of a page of it.
BITS_EACH, BITS_MOST, PAGE_BITS = 8, 1 << 28, 1 << 15
#: Occurrences compared at once.
COMPARE = 1 << 20
_U = np.uint64

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: A-Z to a-z, ASCII without digits and letters to a space.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split() if text else []


class Index:
    """Windows of a block of items and, once counts are known, their prefixes."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, shingle: int) -> None:
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for at in range(max(len(ids) - window, 0) + 1 if ids else 0):
                owners[tuple(ids[at : at + window])].add(item)
        every = sorted(owners)
        self.items = [sorted(owners[w]) for w in every]
        self.length = np.array([len(w) for w in every], dtype=np.int64)
        self.table = np.zeros((len(every), window), dtype=np.int32)
        for k, w in enumerate(every):
            self.table[k, : len(w)] = w
        self.shingle = shingle
        #: Windows by the length of their shingles: short windows have short ones.
        sizes = np.minimum(self.length, shingle)
        self.groups = [(int(s), np.flatnonzero(sizes == s)) for s in np.unique(sizes)]
        self.codes = []
        for size, who in self.groups:
            codes, _ = self.shingle_codes(self.table[who].ravel(), size)
            codes = codes.reshape(who.size, -1)
            # Rows have ``window`` words; shingles that leave the row or the window don't count.
            within = np.arange(codes.shape[1]) + size <= self.length[who][:, None]
            self.codes.append((codes, within, np.unique(codes[within])))

    def shingle_codes(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the shingle that starts at each place, and whether all its words are known.
        Hashes may meet: they choose what is compared, and the words decide."""
        code, known = np.full(ids.size, size, _U), np.ones(ids.size, bool)
        for k in range(size):
            nxt = np.zeros(ids.size, _U)
            nxt[: max(ids.size - k, 0)] = ids[k:].astype(_U)
            code = mix(code * _U(0x9E3779B97F4A7C15) + nxt)
            known &= nxt > 0
        return code, known

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, 0 for words of no item, and where each text begins.
        A 0 stands after every text, so that nothing spans two."""
        found, begins = [], [0]
        for text in texts:
            w = words(text)
            found.append(np.fromiter(map(self.vocab.get, w, repeat(0)), np.int32, len(w)))
            found.append(np.zeros(1, np.int32))
            begins.append(begins[-1] + len(w) + 1)
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.array(begins)

    def count(self, ids: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each group's shingles."""
        out = []
        for (size, _), (_, _, known) in zip(self.groups, self.codes, strict=True):
            codes, whole = self.shingle_codes(ids, size)
            codes = codes[whole]
            at = np.searchsorted(known, codes)
            at[at == known.size] = 0
            out.append(np.bincount(at[known[at] == codes], minlength=known.size))
        return out

    def choose(self, counts: list[np.ndarray]) -> None:
        """Keep of each window its rarest shingle, of equals the smallest."""
        self.prefix = []
        for (size, who), (codes, within, known), n in zip(self.groups, self.codes, counts, strict=True):
            rarity = np.argsort(np.lexsort((known, n)))  # place of each shingle in the order by rarity
            place = np.where(within, rarity[np.clip(np.searchsorted(known, codes), 0, known.size - 1)], known.size)
            offset = np.argmin(place, axis=1)
            anchor = codes[np.arange(who.size), offset]
            order = np.argsort(anchor, kind="stable")
            anchors, first = np.unique(anchor[order], return_index=True)
            self.prefix.append((size, anchors, np.append(first, who.size), who[order], offset[order]))
        self.codes = []

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of every exact occurrence."""
        for size, anchors, first, who, offset in self.prefix:
            codes, whole = self.shingle_codes(ids, size)
            places = np.flatnonzero(whole)
            at = np.searchsorted(anchors, codes[places])
            at[at == anchors.size] = 0
            met = anchors[at] == codes[places]
            places, at = places[met], at[met]
            n = first[at + 1] - first[at]
            ends = np.cumsum(n)
            low = 0
            while low < places.size:  # as many as fit a bounded comparison, one at least
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COMPARE, side="right")))
                many = n[low:high]
                k = np.repeat(first[at[low:high]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                window = who[k]
                start = np.repeat(places[low:high], many) - offset[k]
                fits = (start >= 0) & (start + self.length[window] <= ids.size)
                window, start = window[fits], start[fits]
                same = np.ones(window.size, bool)
                for j in range(self.table.shape[1]):
                    used = j < self.length[window]
                    same &= ~used | (ids[np.minimum(start + j, ids.size - 1)] == self.table[window, j])
                yield window[same], start[same]
                low = high


def broadcast_index(texts: DataFrame, items: DataFrame, window: int, shingle: int):
    """The index of a small benchmark, with the rarest shingle of each window by counts over ``texts``."""
    spark = texts.sparkSession
    index = Index([(r["item"], r["text"]) for r in items.collect()], window, shingle)
    shared = spark.sparkContext.broadcast(index)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = shared.value, None
        for batch in small(batches, 0):
            ids, _ = index.ids(batch.column(0).to_pylist())
            n = index.count(ids)
            total = n if total is None else [a + b for a, b in zip(total, n, strict=True)]
        for g, n in enumerate(total or []):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, g)), pa.array(at), pa.array(n[at])], names=["g", "k", "n"])

    counts = [np.zeros(known.size, np.int64) for _, _, known in index.codes]
    if index.groups:
        for r in texts.mapInArrow(tally, "g long, k long, n long").groupBy("g", "k").agg(F.sum("n").alias("n")).collect():
            counts[r["g"]][r["k"]] = r["n"]
    shared.unpersist()
    index.choose(counts)
    return spark.sparkContext.broadcast(index)


MADE = ("n_words", "n_hit", "hits", "items")
SPAN = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def looked_up(docs: DataFrame, items: DataFrame, window: int, shingle: int, text_col: str) -> DataFrame:
    shared = broadcast_index(docs.select(F.col(f"`{text_col}`").alias("text")), items, window, shingle)
    fields = docs.schema.fields
    names = [f.name for f in fields]
    at = names.index(text_col)
    out = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in small(batches, at):
            texts = batch.column(at).to_pylist()
            found = defaultdict(set)
            ids, begins = index.ids(texts)
            edge = np.zeros(ids.size + 1, np.int64)
            for who, start in index.occurrences(ids) if index.groups else ():
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.length[who], -1)
                doc = np.searchsorted(begins, start, side="right") - 1
                for d, w in np.unique(np.stack([doc, who], axis=1), axis=0).tolist():
                    found[d].update(index.items[w])
            hit = np.cumsum(edge[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            lo, hi = turns[::2], turns[1::2]
            doc = np.searchsorted(begins, lo, side="right") - 1
            n_hit = np.bincount(doc, hi - lo, minlength=len(texts)).astype(np.int64)
            spans: list[list[dict]] = [[] for _ in texts]
            for d, a, b in zip(doc.tolist(), (lo - begins[doc]).tolist(), (hi - begins[doc]).tolist(), strict=True):
                spans[d].append({"begin": a, "end": b})
            n_words = np.diff(begins) - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, SPANS), pa.array([sorted(found.get(d, ())) for d in range(len(texts))], pa.list_(pa.string()))], names=[*names, *MADE])

    return docs.mapInArrow(run, out)


# A benchmark of any size.
def codes_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of ``size`` words, from word hashes."""
    n = hashes.size - size + 1
    code = np.full(max(n, 0), size, _U)
    for k in range(size):
        code = mix(code * _U(0x9E3779B97F4A7C15) + hashes[k : k + max(n, 0)])
    return code


def hashed_words(text: str | None, known: WordHashes) -> tuple[list[bytes], np.ndarray]:
    found = words(text)
    return found, np.fromiter(map(known.__getitem__, found), _U, len(found))


def bitmap(codes: DataFrame) -> np.ndarray:
    """The bits that the values of ``code`` set, a power of two and ``BITS_MOST`` at most: pages of it
    are merged by Spark, so that what reaches the driver is bounded by that."""
    n = codes.count()
    bits = 1 << min(max((BITS_EACH * max(n, 1) - 1).bit_length(), PAGE_BITS.bit_length() - 1), BITS_MOST.bit_length() - 1)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(batch.column(0).to_numpy().view(_U) & _U(bits - 1)).astype(np.int64)
            page, at = np.unique(bit // PAGE_BITS, return_index=True)
            cut = np.append(at, bit.size)
            blobs = []
            for k in range(page.size):
                one = np.zeros(PAGE_BITS, bool)
                one[bit[cut[k] : cut[k + 1]] % PAGE_BITS] = True
                blobs.append(np.packbits(one).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(blobs, pa.binary())], names=["page", "bits"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAGE_BITS // 8, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                total |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["page", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in codes.mapInArrow(pages, "page long, bits binary").groupBy("page").applyInArrow(merge, "page long, bits binary").toLocalIterator():
        out[r["page"] * (PAGE_BITS // 8) : (r["page"] + 1) * (PAGE_BITS // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (codes & _U(8 * bits.size - 1)).astype(np.int64)
    return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def joined(docs: DataFrame, items: DataFrame, window: int, shingle: int, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words(text)
                size = min(window, len(w))
                for low in range(0, len(w) - size + 1 if w else 0, COMPARE):
                    found = sorted({b" ".join(w[k : k + size]) for k in range(low, min(low + COMPARE, len(w) - size + 1))})
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for w in batch.column(0).to_pylist():
                parts = w.split()
                size = min(shingle, len(parts))
                codes = codes_of(np.fromiter(map(known.__getitem__, parts), _U, len(parts)), size).view(np.int64).tolist()
                rows += [(w, c, size, k) for k, c in enumerate(codes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["window", "code", "size", "offset"])

    owners = materialise(items.mapInArrow(windows_of, "item string, window binary").distinct(), "item-windows")
    table = materialise(owners.select("window").distinct().mapInArrow(shingles_of, "window binary, code long, size int, offset int"), "item-shingles")
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())
    text = F.col(f"`{text_col}`").cast("string")
    # Two hashes name a text: 128 bits.
    keyed = docs.withColumn("__k1", F.xxhash64(text)).withColumn("__k2", F.xxhash64(F.lit(1), text))
    texts = keyed.select("__k1", "__k2", text.alias("text")).where("text IS NOT NULL")
    met = sc.broadcast(bitmap(table.select("code").distinct()))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(), met.value
        for batch in small(batches, 2):
            codes = []
            for t in batch.column(2).to_pylist():
                _, h = hashed_words(t, known)
                codes += [c[passes(c, bits)] for c in (codes_of(h, size) for size in sizes)]
            found, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, _U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["code", "n"])

    counts = texts.mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rare = table.join(counts, "code", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code", "offset")).alias("x"))
    # Windows that no document has all shingles of need no look.
    prefixes = materialise(rare.where("x.n > 0").select("window", "x.code", "x.offset"), "item-prefixes")
    anchor = sc.broadcast(bitmap(prefixes.select("code").distinct()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(), anchor.value
        names = ["k1", "k2", "code", "at", "before", "around"]
        for batch in small(batches, 2):
            rows = []
            for k1, k2, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, h = hashed_words(t, known)
                for size in sizes:
                    codes = codes_of(h, size)
                    for at in np.flatnonzero(passes(codes, bits)).tolist():
                        low = max(at - window + 1, 0)
                        rows.append((k1, k2, int(codes[at].view(np.int64)), at, at - low, b" ".join(w[low : at + window])))
                        if len(rows) >= 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                            rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, start, length = [], [], []
            for at, before, around, w, offset in zip(*(batch.column(c).to_pylist() for c in ("at", "before", "around", "window", "offset")), strict=True):
                want, have = w.split(), around.split()
                low = before - offset
                same = low >= 0 and have[low : low + len(want)] == want
                keep.append(same)
                if same:
                    start.append(at - offset)
                    length.append(len(want))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("k1"), kept.column("k2"), kept.column("window"), pa.array(start, pa.int64()), pa.array(length, pa.int64())], names=["k1", "k2", "window", "start", "length"])

    sent = materialise(texts.mapInArrow(places, "k1 long, k2 long, code long, at long, before long, around binary").distinct(), "places")
    found = materialise(sent.join(prefixes, "code").mapInArrow(verify, "k1 long, k2 long, window binary, start long, length long").distinct(), "found")

    def runs(key: tuple, hits: pa.Table) -> pa.Table:
        """Maximal runs of hit words of a text."""
        hits = hits.sort_by("start")
        low, end = hits.column("start").to_numpy(), np.maximum.accumulate(hits.column("start").to_numpy() + hits.column("length").to_numpy())
        new = np.append(True, low[1:] > end[:-1])
        last = end[np.append(new[1:], True)]
        spans = [{"begin": a, "end": b} for a, b in zip(low[new].tolist(), last.tolist(), strict=True)]
        return pa.table({"k1": pa.array([key[0].as_py()], pa.int64()), "k2": pa.array([key[1].as_py()], pa.int64()), "hits": pa.array([spans], SPANS)})

    spans = found.select("k1", "k2", "start", "length").distinct().groupBy("k1", "k2").applyInArrow(runs, "k1 long, k2 long, hits array<struct<begin: long, end: long>>")
    named = found.select("k1", "k2", "window").distinct().join(owners, "window").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    results = materialise(spans.join(named, ["k1", "k2"]).select(F.col("k1").alias("__r1"), F.col("k2").alias("__r2"), "hits", "items"), "hits")
    names = docs.columns
    at = names.index(text_col)
    counted = T.StructType([*keyed.schema.fields, T.StructField("n_words", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(words(t)) for t in batch.column(at).to_pylist()], pa.int64())], names=counted.names)

    done = keyed.mapInArrow(count, counted).join(results, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left")
    hits = F.coalesce("hits", F.array().cast(T.ArrayType(SPAN)))
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda x, s: x + s["end"] - s["begin"])
    return done.select(*(F.col(f"`{c}`") for c in names), "n_words", n_hit.alias("n_hit"), hits.alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (maximal runs of hit words, as [begin, end)),
    ``n_hit`` and ``items`` (the ids, as strings, of items with occurring windows)."""
    ship(docs.sparkSession)
    made = {*MADE, "__k1", "__k2", "__r1", "__r2"}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in made))
    rows = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    return (looked_up if size <= broadcast_bytes else joined)(docs, rows, window, shingle, text_col)
