"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte of a document is removed if a string of ``LENGTH`` bytes that covers it
also starts in a document with a smaller id.  A corpus has no suffix array of its
own, so its windows of ``LENGTH`` bytes are dealt to many small ones:

0. Rows that repeat with id and text are looked at once and given out as often as
   they stand.  A document whose whole text a smaller one has is a repeat from end
   to end; such copies are found by 128-bit hashes and left out of what follows.
1. Each window is keyed by the smallest hash among the strings of ``SEED`` bytes
   in it.  Equal windows have equal keys, and neighbours mostly share a key, so
   a document is cut into runs of windows with one key.
2. Keys that only one document has are dropped: documents are grouped in blocks,
   a block sends each of its keys once to the key's bucket, and the bucket sends
   back those that two documents have.  The number of buckets follows the number
   of keys, ``BUCKET_KEYS`` each, so a block's keys for a bucket stay packed.
3. The text of the other runs is dealt to parts by key.  A part concatenates it,
   sorts its suffixes, and from previous and next smaller documents in suffix
   order gets for each window the longest earlier match.  Windows whose match
   is ``LENGTH`` or longer are sent back, and the bytes they cover are removed.

What a block has several times is sent once, in the name of its smallest
document, so a passage that a third of all documents share costs a row a block,
not one a document.  A part gets runs of one key only as far as their texts
differ; if those are many, they are dealt out again by window.  Strings are grouped
by a 64-bit hash, but those of equal hash are compared byte by byte before one
stands for the others.

Defined results: a null text counts as empty; documents that share an id are one
document for "a smaller id"; a null id is larger than any id; an empty table
gives no rows; other columns are ignored; long texts are handled whole, in a block
of their own if need be: what a byte of text costs is its place in a few arrays
of single bytes and integers, everything wider is made for ``CHUNK`` bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import materialise, ship

LENGTH, SEED = 50, 22
#: Text of a block and of a part: from LEAST to MOST, growing with the square root of the input.
LEAST, MOST, GROWS_FROM = 1 << 20, 4 << 20, 50 << 20
#: Bytes hashed at once.
CHUNK = 1 << 20
#: Keys in a bucket, about; a text has one for each ``KEY_STEP`` bytes.
BUCKET_KEYS, KEY_STEP = 1 << 20, 15
#: A key with more runs than this, about, is dealt out by window.
HOT_RUNS = 8192
#: Runs of a key in a block, as two bits can say: up to so many each.
CLASSES = np.array([1, 8, 64, 512])
NO_ID = 2**63 - 1
_U = np.uint64
_BYTE = np.random.default_rng(20240101).integers(0, 2**64, 256, dtype=_U) | _U(1)
_STEP = 0x9E3779B97F4A7C15


def window_keys(raw: np.ndarray) -> np.ndarray:
    """For each window of ``LENGTH`` bytes the smallest hash of the ``SEED``-byte strings in it."""
    if raw.size < LENGTH:
        return np.zeros(0, _U)
    # Hash of 2^j bytes from two of 2^(j-1); SEED bytes are two overlapping powers of two.
    h, width, factor = _BYTE[raw], 1, _STEP
    while 2 * width <= SEED:
        h = h[:-width] * _U(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    if width < SEED:
        h = h[: h.size - (SEED - width)] * _U(factor) + h[SEED - width :]
    h ^= h >> _U(31)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    span, width = LENGTH - SEED + 1, 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: h.size - (span - width)], h[span - width :]) if width < span else h


def runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: keys, first windows, ends (exclusive)."""
    keys, firsts, ends = [], [], []
    for low in range(0, max(raw.size - LENGTH + 1, 0), CHUNK):
        k = window_keys(raw[low : low + CHUNK + LENGTH - 1])
        first = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        keys.append(k[first])
        firsts.append(first + low)
        ends.append(np.append(first[1:], k.size) + low)
    if not keys:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(ends)


def suffix_order(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the ``LENGTH`` bytes that follow each, and the
    length of the common prefix of each with the one before."""
    padded = np.concatenate([text, np.zeros(LENGTH + 16, np.uint8)]).astype(_U)
    n = padded.size - 7
    eight = np.zeros(n, _U)  # big-endian words at all places
    for b in range(8):
        eight = eight << _U(8) | padded[b : b + n]
    del padded
    width = -(-LENGTH // 8)
    spare = _U(8 * (8 * width - LENGTH))

    def word(j: int, at: np.ndarray) -> np.ndarray:
        w = eight[at + 8 * j]
        return w >> spare << spare if j == width - 1 else w

    first = word(0, starts)
    order = np.argsort(first, kind="stable")
    sorted_ = first[order]
    new = np.ones(starts.size, bool)  # a place whose prefix differs from the one before
    new[1:] = sorted_[1:] != sorted_[:-1]
    for j in range(1, width):  # the next word orders those that are still equal
        todo = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not todo.size:
            break
        group, w = np.cumsum(new)[todo], word(j, starts[order[todo]])
        again = np.lexsort((w, group))
        order[todo] = order[todo][again]
        w = w[again]
        differs = np.ones(todo.size, bool)
        differs[1:] = (w[1:] != w[:-1]) | (group[1:] != group[:-1])
        new[todo] |= differs
    lcp = np.zeros(starts.size, np.uint8)
    open_ = np.arange(1, starts.size)
    for j in range(width):
        diff = word(j, starts[order[open_]]) ^ word(j, starts[order[open_ - 1]])
        lead = np.zeros(open_.size, np.uint8)
        for b in range(1, 9):
            lead += diff < _U(1 << (64 - 8 * b)) if b < 8 else diff == 0
        lcp[open_] += lead
        open_ = open_[diff == 0]
    return order, np.minimum(lcp, LENGTH)


def previous_smaller(value: np.ndarray, lcp: np.ndarray, reach: int) -> np.ndarray:
    """For each place the common prefix with the nearest place before it that has a smaller value.

    A descent over block minima: from the widest block down, blocks without a
    smaller value are passed, and their common prefix is taken along.  Nothing
    further than ``reach`` places away has a common prefix, so 0 stands for it.
    """
    n = value.size
    minima, shared = [value], [lcp]  # of the 2^k places that end at i, and of the prefixes down to the place before them
    while 1 << len(minima) <= min(reach, n):
        half = 1 << (len(minima) - 1)
        m, s = minima[-1].copy(), shared[-1].copy()
        m[half:] = np.minimum(minima[-1][half:], minima[-1][:-half])
        s[half:] = np.minimum(shared[-1][half:], shared[-1][:-half])
        minima.append(m)
        shared.append(s)
    at, best = np.arange(n) - 1, lcp.copy()
    for k in range(len(minima) - 1, -1, -1):
        where = np.maximum(at, 0)
        skip = (at >= (1 << k) - 1) & (minima[k][where] >= value)
        best = np.where(skip, np.minimum(best, shared[k][where]), best)
        at = np.where(skip, at - (1 << k), at)
    found = (at >= 0) & (value[np.maximum(at, 0)] < value)
    return np.where(found, best, 0)


def previous_factors(text: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each start the longest match, in bytes, with a start of a smaller
    document: 0 if it is below ``SEED``, ``LENGTH`` if it is that or longer."""
    out = np.zeros(starts.size, np.uint8)
    if not starts.size:
        return out
    order, lcp = suffix_order(text, starts)
    lcp[lcp < SEED] = 0
    cuts = np.flatnonzero(lcp == 0)
    reach = int(np.diff(np.append(cuts, lcp.size)).max())
    value = np.unique(docs, return_inverse=True)[1].astype(np.int32)[order]
    before = previous_smaller(value, lcp, reach)
    after = previous_smaller(value[::-1].copy(), np.append(lcp[1:], np.uint8(0))[::-1].copy(), reach)[::-1]
    out[order] = np.maximum(before, after)
    return out


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of many ranges, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if length.size else 0) + np.repeat(first - ends + length, length)


def merged(first: np.ndarray, end: np.ndarray) -> bytes:
    """Ranges as sorted disjoint pairs of 32-bit integers."""
    if not first.size:
        return b""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.append(True, first[1:] > end[:-1])
    return np.stack([first[new], end[np.append(new[1:], True)]], axis=1).astype("<i4").tobytes()


def pairs_of(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2).astype(np.int64)


def hashes(raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of ``raw``, equal for equal strings wherever they stand."""
    back_step = pow(_STEP, -1, 1 << 64)
    ends = first + length
    at_first, at_end = np.argsort(first, kind="stable"), np.argsort(ends, kind="stable")
    sums_first, sums_end, back = (np.zeros(first.size, _U) for _ in range(3))
    done_first = done_end = 0
    total, power, inverse = _U(0), 1, 1
    for low in range(0, raw.size + 1, CHUNK):  # sums before each place from low on
        piece = raw[low : low + CHUNK]
        powers = np.cumprod(np.concatenate([np.array([power], _U), np.full(piece.size, _STEP, _U)]))
        sums = total + np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[piece] * powers[:-1])])
        many = int(np.searchsorted(first, low + CHUNK, sorter=at_first))
        here = at_first[done_first:many]
        inverses = np.cumprod(np.concatenate([np.array([inverse], _U), np.full(piece.size, back_step, _U)]))
        sums_first[here], back[here] = sums[first[here] - low], inverses[first[here] - low]
        done_first = many
        many = int(np.searchsorted(ends, low + CHUNK, sorter=at_end))
        here = at_end[done_end:many]
        sums_end[here] = sums[ends[here] - low]
        done_end = many
        total, power, inverse = sums[-1], int(powers[-1]), int(inverses[-1])
    out = (sums_end - sums_first) * back
    out ^= out >> _U(32)
    return out * _U(0xC4CEB9FE1A85EC53) + length.astype(_U)


def differs(raw: np.ndarray, name: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For parts of ``raw`` in order of their hashes: whether each isn't, byte by byte, the one before it.

    Parts of equal hash that do differ begin groups of their own; whatever of
    them is equal after all meets in the suffix order.
    """
    new = np.ones(name.size, bool)
    new[1:] = (name[1:] != name[:-1]) | (length[1:] != length[:-1])
    same = np.flatnonzero(~new)
    ends = np.cumsum(length[same])
    low = 0
    while low < same.size:  # as many as have CHUNK bytes together, one at least
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK, side="right")))
        k = same[low:high]
        apart = raw[ragged(first[k], length[k])] != raw[ragged(first[k - 1], length[k])]
        new[k] = np.logical_or.reduceat(apart, np.cumsum(length[k]) - length[k])
        low = high
    return new


NO_COPIES = pa.table({"id": pa.array([], pa.int64()), "hash": pa.array([], pa.int64())})
ORDER = [("id", "ascending"), ("text", "ascending")]


class Block:
    """The documents of a block, in order of ids, their bytes one after the other."""

    def __init__(self, table: pa.Table, copies: pa.Table) -> None:
        """``copies`` has the ids and text hashes of documents that are copies of smaller ones."""
        table = table.select(["id", "text"]).sort_by(ORDER)
        self.ids = table.column("id").to_numpy()
        texts = [x.as_buffer() for x in table.column("text").cast(pa.large_binary())]
        del table
        self.begins = np.append(0, np.cumsum([len(x) for x in texts])).astype(np.int64)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.copy = np.zeros(len(texts), bool)
        known = set(zip(copies.column("id").to_pylist(), copies.column("hash").to_pylist(), strict=True)) - {(None, None)}
        if known:
            signed = lambda x: int(np.uint64(xxh64_intdigest(x, 42)).astype(np.int64))  # noqa: E731  as Spark's xxhash64
            maybe = np.flatnonzero(np.isin(self.ids, [i for i, _ in known])).tolist()
            self.copy[[k for k in maybe if (int(self.ids[k]), signed(texts[k])) in known]] = True

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows inside documents that aren't copies: document, key, first window, end."""
        key, first, end = runs(self.raw)
        doc = np.searchsorted(self.begins, first, side="right") - 1
        last = np.searchsorted(self.begins, end - 1, side="right") - 1
        n = last - doc + 1  # a run over borders is cut at each
        if (n > 1).any():
            at = np.repeat(np.arange(n.size), n)
            doc = ragged(doc, n)
            key, first, end = key[at], np.maximum(first[at], self.begins[doc]), np.minimum(end[at], self.begins[doc + 1])
        end = np.minimum(end, self.begins[doc + 1] - LENGTH + 1)
        real = (first < end) & ~self.copy[doc]
        return doc[real], key[real], first[real], end[real]

    def keys(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and names (32 bits) of distinct keys.  A name's lowest bit says
        that two documents have it, the next two how many runs there are."""
        doc, key, _, _ = self.runs()
        code, ids = codes(key, n_buckets), self.ids[doc]
        order = np.argsort(code)
        code, ids = code[order], ids[order]
        new = np.ones(code.size, bool)
        new[1:] = code[1:] != code[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], code.size)
        code = code[new]
        flags = np.zeros(0, "<u4")
        if code.size:
            flags = (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)).astype("<u4") | np.searchsorted(CLASSES[:-1], ends - starts).astype("<u4") << np.uint32(1)
        return (code >> _U(32)).astype(np.int64), (code & _U(0xFFFFFFFF)).astype("<u4") | flags

    def segments(self, shared: np.ndarray, n_buckets: int) -> tuple[bytes, dict[str, np.ndarray]]:
        """What to find out elsewhere about keys that two documents have.

        ``shared``: sorted codes, the lowest bit set for hot ones.  Of strings
        that the block has several times, the smallest document's is sent; in
        larger documents they are repeats already (first result).
        """
        doc, key, first, end = self.runs()
        code = codes(key, n_buckets)
        at = np.minimum(np.searchsorted(shared & ~_U(1), code), max(shared.size - 1, 0))
        met = (shared[at] & ~_U(1)) == code if shared.size else np.zeros(key.size, bool)
        doc, key, first, end, hot = doc[met], key[met], first[met], end[met], (shared[at[met]] & _U(1)) == 1 if shared.size else met[met]
        many = (end - first)[hot]
        places = ragged(first[hot], many)
        doc = np.concatenate([doc[~hot], np.repeat(doc[hot], many)])
        length = np.concatenate([(end - first)[~hot] + LENGTH - 1, np.full(places.size, LENGTH)])
        route = np.concatenate([key[~hot], np.zeros(places.size, _U)])
        n_cold = int((~hot).sum())
        first = np.concatenate([first[~hot], places])
        name = hashes(self.raw, first, length)
        route[n_cold:] = name[n_cold:]
        order = np.lexsort((doc, name))
        doc, first, length, route, name = doc[order], first[order], length[order], route[order], name[order]
        new = differs(self.raw, name, first, length)
        group = np.cumsum(new) - 1
        least = self.ids[doc[new]]
        own = self.ids[doc] == least[group] if name.size else new
        whole = np.flatnonzero(self.copy)
        local = merged(np.concatenate([first[~own], self.begins[whole]]), np.concatenate([(first + length)[~own], self.begins[whole + 1]]))
        return local, {"first": first[new], "length": length[new], "id": least, "route": route[new], "n": np.bincount(group[own], minlength=int(new.sum())), "places": first[own]}


def grouped(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each value."""
    order = np.argsort(values, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
        if part.size:
            yield int(values[part[0]]), part


def spread(keys: np.ndarray) -> np.ndarray:
    """Keys are minima of hashes; these are evenly spread again."""
    x = (keys ^ (keys >> _U(31))) * _U(0x9FB21C651E98DF25)
    x = (x ^ (x >> _U(35))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def codes(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each key in the upper half, its name in the lower, with three bits free.
    Two keys of one name cost a needless comparison, no more."""
    x = spread(keys)
    return x % _U(n_buckets) << _U(32) | x >> _U(35) << _U(3)


def deal(keys: np.ndarray, n: int) -> np.ndarray:
    """The part of each key."""
    return (spread(keys) % _U(n)).astype(np.int64)


PACKED = ("raw", "length", "id", "n", "places")


def suffix_part(table: pa.Table) -> pa.Table:
    """For the segments of one part: the byte ranges of each block that repeat; ranges known before are passed on."""
    take = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    known = [(b, x) for b, x in zip(table.column("block").to_pylist(), table.column("spans").to_pylist(), strict=True) if x]
    table = table.filter(pa.compute.greater(pa.compute.binary_length(table.column("raw")), 0))
    blocks = table.column("block").to_numpy()
    if not blocks.size:
        return pa.table({"block": pa.array([b for b, _ in known], pa.int64()), "spans": pa.array([x for _, x in known], pa.binary())})
    raws, lengths, ids, counts, places = (take(c, k) for c, k in zip(PACKED, (np.uint8, "<i4", "<i8", "<i4", "<i4"), strict=True))
    of = np.repeat(np.arange(len(blocks)), [x.size for x in lengths])
    length, id_, count = (np.concatenate(x).astype(np.int64) for x in (lengths, ids, counts))
    text, place = np.concatenate(raws), np.concatenate(places).astype(np.int64)
    # Equal segments go by their smallest document; in the others they are repeats.
    begin = np.cumsum(length) - length
    name = hashes(text, begin, length)
    order = np.lexsort((id_, name))
    new = differs(text, name[order], begin[order], length[order])
    group = np.empty(name.size, np.int64)
    group[order] = np.cumsum(new) - 1
    chosen = order[new]
    windows = length[chosen] - LENGTH + 1
    starts = ragged(begin[chosen], windows)
    segment = np.repeat(np.arange(chosen.size), windows)
    hit = previous_factors(text, starts, id_[chosen][segment]) >= LENGTH
    # Runs of windows that repeat in each segment chosen.
    border = segment[1:] != segment[:-1]
    lo = np.flatnonzero(hit & np.append(True, border | ~hit[:-1])[: hit.size])
    hi = np.flatnonzero(hit & np.append(border | ~hit[1:], True)[: hit.size]) + 1
    found = np.bincount(segment[lo], minlength=chosen.size)
    own = id_ == id_[chosen][group]
    n = np.where(own, found[group], 1)
    seg = np.repeat(np.arange(n.size), n)
    offset, reach, mine = np.zeros(seg.size, np.int64), length[seg], own[seg]
    pick = ragged((np.cumsum(found) - found)[group[own]], found[group[own]])
    offset[mine] = starts[lo[pick]] - begin[chosen][segment[lo[pick]]]
    reach[mine] = (hi - lo)[pick] + LENGTH - 1
    first_place = np.cumsum(count) - count
    n = count[seg]
    at = np.repeat(np.arange(seg.size), n)
    where = place[ragged(first_place[seg], n)] + offset[at]
    end, owner = where + reach[at], of[seg[at]]
    rows = known + [(int(blocks[k]), merged(where[p], end[p])) for k, p in grouped(owner)]
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "spans": pa.array([x for _, x in rows], pa.binary())})


def single(rows: DataFrame) -> DataFrame:
    """``rows`` (id, no_id, text, n) with rows that repeat with id and text as one, ``n`` their number.

    Only ids and hashes are shuffled to find them, and their texts are reduced
    before they are shuffled, so a row that a third of the table repeats stays small.
    """
    names = ["id", "no_id", "hash", "hash2"]
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("hash2", F.xxhash64(F.lit(1), "text"))
    again = materialise(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeated-rows")
    if again.isEmpty():
        return rows
    alone = keyed.join(again, names, "left_anti").select("id", "no_id", "text", "n")
    one = keyed.join(again, names).groupBy(*names).agg(F.first("text").alias("text"), F.first("times").alias("n"))
    return materialise(alone.unionByName(one.select("id", "no_id", "text", "n")), "different-rows")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs) and ``kept`` (the bytes that are left)."""
    ship(docs.sparkSession)
    id_, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(id_, F.lit(NO_ID)).alias("id"), id_.isNull().alias("no_id"), text.alias("text"), F.lit(1).cast("long").alias("n"))
    rows = single(rows)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, int(total // min(MOST, max(LEAST, LEAST * (total / GROWS_FROM) ** 0.5))) + 1)
    n_buckets = int(total // (KEY_STEP * BUCKET_KEYS)) + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    # Whole copies of smaller documents.
    hashed = rows.where(F.octet_length("text") >= LENGTH).select("id", "block", F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("hash2"))
    firsts = materialise(hashed.groupBy("hash", "hash2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most"), "firsts")
    copies = materialise(hashed.join(firsts, ["hash", "hash2"]).where("id > least").select("block", "id", "hash"), "copies")

    def keys_of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        buckets, names = Block(left, right).keys(n_buckets)
        out = [(b, names[at].tobytes()) for b, at in grouped(buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "names": pa.array([x for _, x in out], pa.binary())})

    def shared_keys(key: tuple, table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("names")]
        names = np.concatenate(blobs)
        of = np.repeat(np.arange(len(blobs)), [x.size for x in blobs])
        distinct, group, n = np.unique(names >> 3, return_inverse=True, return_counts=True)
        twice = (n > 1) | (np.bincount(group, names & 1, minlength=distinct.size) > 0)
        many = np.bincount(group, CLASSES[names >> 1 & 3], minlength=distinct.size) > HOT_RUNS
        marked = (distinct << 3 | many).astype("<u4")
        keep = twice[group]
        found, blocks = marked[group][keep], table.column("block").to_numpy()
        out = [(int(blocks[k]), found[at].tobytes()) for k, at in grouped(of[keep])]
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int64()), "names": pa.array([x for _, x in out], pa.binary())})

    def segments_of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, right)
        right = right.filter(pa.compute.is_valid(right.column("names")))
        replies = [np.frombuffer(x.as_buffer(), "<u4") for x in right.column("names")]
        number = key[0].as_py()
        out = []
        if left.num_rows:
            shared = np.sort(np.repeat(right.column("bucket").to_numpy().astype(_U) << _U(32), [x.size for x in replies]) | np.concatenate([np.zeros(0, "<u4"), *replies]))
            local, found = block.segments(shared, n_buckets)
            begin = np.cumsum(found["n"]) - found["n"]
            for part, at in grouped(deal(found["route"], n_blocks)):
                raw = block.raw[ragged(found["first"][at], found["length"][at])]
                places = found["places"][ragged(begin[at], found["n"][at])]
                out.append((part, b"", raw.tobytes(), found["length"][at].astype("<i4").tobytes(), found["id"][at].astype("<i8").tobytes(), found["n"][at].astype("<i4").tobytes(), places.astype("<i4").tobytes()))
            out.append((number, local, b"", b"", b"", b"", b""))
        names = ("part", "spans", *PACKED)
        columns = {c: pa.array([x[k] for x in out], pa.int64() if c == "part" else pa.binary()) for k, c in enumerate(names)}
        return pa.table({"block": pa.array([number] * len(out), pa.int64())} | columns)

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, NO_COPIES)
        left = left.sort_by(ORDER)
        edge = np.zeros(block.raw.size + 1, np.int32)
        spans = pairs_of(right.column("spans").to_pylist())
        np.add.at(edge, spans[:, 0], 1)
        np.add.at(edge, spans[:, 1], -1)
        gone = np.cumsum(edge[:-1], out=edge[:-1]) > 0
        del edge
        begin, end = block.begins[:-1], block.begins[1:]
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        full = begin < end
        starts[begin[full]] = gone[begin[full]]  # a run ends with its document
        n_removed, n_spans = np.zeros(begin.size, np.int64), np.zeros(begin.size, np.int64)
        if full.any():
            n_removed[full] = np.add.reduceat(gone, begin[full], dtype=np.int64)
            n_spans[full] = np.add.reduceat(starts, begin[full], dtype=np.int64)
        offsets = np.append(0, np.cumsum(end - begin - n_removed)).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(block.ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(block.raw[~gone].tobytes())])
        ids = pa.array(block.ids, mask=left.column("no_id").to_numpy())
        return pa.table({"id": ids, "n_bytes": pa.array(end - begin), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept": kept, "n": left.column("n")})

    # One plan, so that its three passes over the blocks read one shuffle of the texts.
    blocks = lambda: rows.groupBy("block")
    keys = blocks().cogroup(copies.groupBy("block")).applyInArrow(keys_of, "bucket long, block long, names binary")
    replies = keys.groupBy("bucket").applyInArrow(shared_keys, "block long, bucket long, names binary")
    told = replies.unionByName(copies, allowMissingColumns=True)
    sent = blocks().cogroup(told.groupBy("block")).applyInArrow(segments_of, "block long, part long, spans binary, raw binary, length binary, id binary, n binary, places binary")
    spans = sent.groupBy("part").applyInArrow(suffix_part, "block long, spans binary")
    done = blocks().cogroup(spans.groupBy("block")).applyInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, n long")
    return done.select("id", "n_bytes", "n_removed", "n_spans", "kept", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")
