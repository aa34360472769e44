"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct word shingles.  Its sketch has
``SKETCH`` coordinates.  In round i < SKETCH every element is thrown into a bin
chosen by the round's hash; in round SKETCH + j every element goes to bin j; a
bin keeps the smallest (round, hash) it gets.  Throwing stops when all bins are
filled, so a set of any size fills every coordinate, after about
SKETCH ln SKETCH / size rounds, and equal coordinates estimate the Jaccard
similarity with Chernoff-type bounds.

Bands of ``ROWS`` coordinates are hashed; documents that agree in a band are
candidates.  With 48 bands of 6 rows a pair at similarity 0.8 has no band in
common once in two million times, one at 0.85 once in ten thousand million.
Every link is confirmed on the full sets.

A bit of each of 256 coordinates gives a cheap second look: candidates that
differ in more than ``FAR`` bits are dropped.  At similarity 0.8 a pair differs in
26 bits, give or take 5, so ``FAR`` is six standard deviations away.

No group is ever expanded into its pairs.  Documents with equal sets are one
class, which its smallest id represents.  In each band bucket, representatives
are tested against a pivot, the one with the most bucket mates (a text and its
edited copies collide more often than the copies do among themselves), then
against another; links merge components.  What remains is every pair of a bucket
whose ends are still in different components.  A task tests those of a bucket in
place, so no candidate is left out, and sends back only links that join two
components.  Members of a bucket with more than ``GROUP_WEIGHT`` elements are dealt
out again by their rarest shingles (a similar pair shares one of the
``n - ceil(0.8 n) + 1`` that are rarest in the bucket), so texts that share nothing
but a large common part meet no more.  What is still large then goes to tasks as
pairs of blocks: a block with itself in one task, with each other block in one more,
so every pair of members meets in exactly one task.

Bands and ``FAR`` are made for similarities of ``LEAST_PERCENT`` and more; a smaller
``percent`` is an error.

Defined results: a document without words, or with a null text, has the empty
set, is linked with nothing and is its own component; a document with fewer
words than a shingle has its whole sequence as one shingle; rows that share an
id are one node and each row has its own set; a null id has a null component
and is kept; an empty table gives no rows; long texts are handled whole; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, materialise, mix, release, ship, small
from .components import components

SHINGLE_WORDS, PERCENT = 5, 80
BANDS, ROWS = 48, 6
SKETCH = BANDS * ROWS
STAR_ROUNDS = 2
BITS, FAR = 256, 56
LEAST_PERCENT = 80
#: Shingles of a bucket that a task has in memory, about.
GROUP_WEIGHT = 1 << 20
#: Elements sketched at once.
CHUNK = 1 << 19
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_U = np.uint64


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (words: anything but ASCII white space)."""
    words = text.encode("utf-8").translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    w = np.fromiter(map(hashes.__getitem__, words), _U, n)
    size = min(k, n)
    h = np.full(n - size + 1, size, _U)
    for j in range(size):
        h = mix(h * _U(0x9E3779B97F4A7C15) + w[j : n - size + 1 + j])
    return np.unique(h)


def sketch(elements: np.ndarray, begins: np.ndarray, t: int = SKETCH) -> np.ndarray:
    """Sketches of non-empty sets; set d is ``elements[begins[d]:begins[d + 1]]``."""
    n = begins.size - 1
    never = _U(2**64 - 1)
    out = np.full(n * t, never, _U)
    owner = np.repeat(np.arange(n), np.diff(begins))
    active = np.ones(n, bool)
    for i in range(2 * t):
        r = mix(elements ^ _U((i * 0x632BE59BD9B4E019 + 0x1234567) % 2**64))
        bins = ((r >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, _U(i << 32) | r & _U(0xFFFFFFFF))
        which = np.flatnonzero(active)
        done = which[(out.reshape(n, t)[which] != never).all(axis=1)]
        if done.size:
            active[done] = False
            left = active[owner]
            elements, owner = elements[left], owner[left]
            if not elements.size:
                break
    return out.reshape(n, t)


def bands(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of it."""
    n = len(sketches)
    parts = sketches.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), (n, BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def bits(sketches: np.ndarray) -> np.ndarray:
    """A bit per coordinate, packed in 64-bit integers."""
    low = (mix(sketches[:, :BITS]) & _U(1)).astype(np.uint8)
    return np.packbits(low, axis=1).view("<i8")


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """Per row: ``id``, ``n`` (set size), ``f1``, ``f2`` (the set's 128-bit name), ``keys`` (bands), ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes = WordHashes()
        for batch in small(batches, 1):
            ids, texts = batch.column(0), batch.column(1)
            low = 0
            while low < batch.num_rows:
                sets, size, high = [], 0, low
                while high < batch.num_rows and size < CHUNK:
                    sets.append(shingles(texts[high].as_py(), k, hashes))
                    size += sets[-1].size
                    high += 1
                n = np.array([s.size for s in sets])
                full = np.flatnonzero(n)
                keys, marks = np.zeros((0, BANDS), _U), np.zeros((len(sets), BITS // 64), np.int64)
                if full.size:
                    s = sketch(np.concatenate([sets[x] for x in full]), np.append(0, np.cumsum(n[full])))
                    keys, marks[full] = bands(s), bits(s)
                names = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
                offsets = np.append(0, np.cumsum(np.where(n > 0, BANDS, 0))).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                packed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)), pa.array(marks.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(n), pa.array(names[:, 0]), pa.array(names[:, 1]), flat, packed], names=["id", "n", "f1", "f2", "keys", "bits"])
                low = high

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>, bits array<long>")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """``id`` and ``set`` (packed sorted hashes) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches, 1):
            packed = [shingles(t, k, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
                both = np.sort(np.concatenate([a, b]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (a.size + b.size - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    second = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def weights(rows: DataFrame) -> DataFrame:
    """Per bucket how many more blocks than one it needs (``more``)."""
    return materialise(rows.groupBy("key").agg((F.sum(F.col("n") + 16) / (GROUP_WEIGHT // 2)).cast("int").alias("more")), "weights")


def by_rare_shingles(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rows`` (key, id, n, label, …) of large buckets in smaller ones, which have keys of their own.

    Counts are aggregated before the shuffle, a list has the shingles of one text, and both
    sides of the joins are written, so that Spark can split a shingle that all members have.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (pc.binary_length(batch.column(2)).to_numpy() // 8).astype(np.int64)
            flat = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)] or [np.zeros(0, np.int64)])
            at = pa.array(np.repeat(np.arange(n.size), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(flat)], names=["key", "id", "element"])

    members = rows.select("key", "id").join(sets, "id").select("key", "id", "set")
    flat = materialise(members.mapInArrow(elements, "key long, id long, element long"), "elements")
    often = materialise(flat.groupBy("key", "element").agg(F.count(F.lit(1)).alias("often")), "often")
    ordered = flat.join(often, ["key", "element"]).groupBy("key", "id").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("x"))
    n = F.size("x")
    needed = n - F.ceil(percent * n / 100).cast("int") + 1
    prefixes = ordered.select("key", "id", F.explode(F.slice("x", F.lit(1), needed)).alias("x")).where("x.often > 1").select("key", "id", F.col("x.element").alias("element"))
    fine = materialise(rows.join(prefixes, ["key", "id"]).withColumn("key", F.xxhash64("key", "element")).drop("element").select(*rows.columns), "fine")
    release(flat, often)
    open_ = fine.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return fine.join(materialise(open_, "open"), "key", "left_semi")


def with_small_buckets(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rows`` with large buckets split by rare shingles."""
    hot = weights(rows).where("more > 0").select("key")
    if hot.isEmpty():
        return rows
    fine = by_rare_shingles(rows.join(hot, "key", "left_semi"), sets, percent)
    return materialise(rows.join(hot, "key", "left_anti").unionByName(fine), "small-buckets")


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, n, …) with ``part``, ``own`` and ``crossed``: large buckets as all pairs of their blocks.

    A row is in the part of its own block, where members of the block meet each
    other, and in a crossed part for each other block, where the two blocks meet.
    """
    weight = weights(rows)
    own = F.pmod(F.xxhash64("id"), F.col("more") + 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("more")), lambda j: F.least(own, j) * (F.col("more") + 1) + F.greatest(own, j))
    dealt = rows.join(weight, "key").withColumn("own", own).withColumn("part", F.explode(F.when(F.col("more") == 0, F.array(F.lit(0))).otherwise(parts)))
    return dealt.withColumn("crossed", F.col("part") != F.col("own") * (F.col("more") + 2)).drop("more")


def sides(table: pa.Table) -> tuple[pa.Table, int]:
    """The rows of a part and how many of them are to meet the rest: those of the smaller block,
    which come first.  In a block's own part (0) each row meets those after it."""
    if not table.num_rows or not table.column("crossed")[0].as_py():
        return table, 0
    own = table.column("own").to_numpy()
    names, n = np.unique(own, return_counts=True)
    if names.size < 2:
        return table.slice(0, 0), 0
    small_one = own == names[np.argmin(n)]
    return table.take(pa.array(np.argsort(~small_one, kind="stable"))), int(small_one.sum())


def near(table: pa.Table) -> pa.Table:
    """The members of a bucket that another component has a likely partner for."""
    table, first = sides(table)
    label, n = table.column("label").to_numpy(), table.column("n").to_numpy()
    marks = np.stack([table.column(f"b{k}").to_numpy().view(_U) for k in range(BITS // 64)], axis=1)
    found = np.zeros(n.size, bool)
    high = first or n.size
    rest = slice(first, n.size)
    step = max(1, (1 << 19) // max(n.size, 1))
    for low in range(0, high, step):
        rows = slice(low, min(low + step, high))
        apart = np.bitwise_count(marks[rows, None, :] ^ marks[None, rest, :]).sum(axis=2, dtype=np.int64)
        fits = (apart <= FAR) & (label[rows, None] != label[None, rest])
        found[rows] |= fits.any(axis=1)
        found[rest] |= fits.any(axis=0)
    return table.select(["key", "part", "own", "crossed", "id", "n", "label"]).filter(pa.array(found))


def linker(percent: int):
    def link(table: pa.Table) -> pa.Table:
        """Links between the components in a bucket, as few as join them."""
        table, first = sides(table)
        label, ids = table.column("label").to_numpy(), table.column("id").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table.column("set")]
        n = np.array([x.size for x in sets], np.int64)
        begin = np.append(0, np.cumsum(n))
        names, element = np.unique(np.concatenate([np.zeros(0, _U), *sets]), return_inverse=True)
        tree = np.unique(label, return_inverse=True)[1]  # component numbers, renamed as they merge
        a, b = [], []
        mark = np.zeros(names.size, bool)
        for k in range(first or n.size - 1):
            rest = first or k + 1
            if (tree[rest:] == tree[k]).all():
                continue
            mark[element[begin[k] : begin[k + 1]]] = True
            common = np.add.reduceat(mark[element[begin[rest] :]], begin[rest:-1] - begin[rest], dtype=np.int64)
            mark[element[begin[k] : begin[k + 1]]] = False
            for j in np.flatnonzero(100 * common >= percent * (n[k] + n[rest:] - common)).tolist():
                other = rest + j
                if tree[other] != tree[k]:
                    tree[tree == tree[other]] = tree[k]
                    a.append(min(ids[k], ids[other]))
                    b.append(max(ids[k], ids[other]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the label of their component, written."""
    known = members.join(labels, F.col("id") == F.col("node"), "left")
    return materialise(known.select(*members.columns, F.coalesce("label", "id").alias("label")), "labelled")


def near_dedup(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_shingles``, ``component_id``, ``kept``."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"bands and bits are made for {LEAST_PERCENT} percent and more")
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = materialise(sketched(texts, shingle_words), "sketches")
    full = rows.where("n > 0 AND id IS NOT NULL")
    # Equal sets: one class, named by its smallest id.
    classes = materialise(full.groupBy("f1", "f2").agg(F.min("id").alias("rep")), "classes")
    rep_rows = full.join(classes.select("f1", "f2", F.col("rep").alias("id")), ["f1", "f2", "id"], "left_semi").dropDuplicates(["f1", "f2", "id"])
    # Buckets with two representatives at least.
    entries = rep_rows.select("id", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("key", "size")
    shared = materialise(shared, "shared")  # a join of two scans is one that Spark can split
    found = materialise(entries.join(shared, "key"), "buckets")
    mates = found.groupBy("id").agg(F.sum("size").alias("mates"))
    about = rep_rows.select("id", "n", *(F.col("bits")[k].alias(f"b{k}") for k in range(BITS // 64))).join(mates, "id")
    members = materialise(found.select("key", "id").join(about, "id"), "members")
    wanted = members.select("id").distinct()
    # Texts are dealt by id at every size: ids to look at grow with them.
    sets = materialise(sets_of(texts.join(wanted.hint("merge"), "id", "left_semi"), shingle_words), "sets")
    # An id with several sets links the classes they are in.
    several = full.groupBy("id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo < hi").select("id")
    links = materialise(full.join(several, "id", "left_semi").join(classes, ["f1", "f2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "links")
    labels = components(links)
    marks = [f"b{k}" for k in range(BITS // 64)]
    own = ("id", "n", *marks, "label")

    def alike(x: str, y: str):
        """Sizes and bits that a similar pair can have; a column prefix for either side."""
        n, m = F.col(f"{x}n"), F.col(f"{y}n")
        apart = sum((F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in marks), F.lit(0))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= FAR)

    def joined(links: DataFrame, new: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        if new.isEmpty():
            return links, labels
        links = links.unionByName(new)
        release(labels)
        return links, components(links)

    for turn in range(STAR_ROUNDS):
        now = labelled(members, labels)
        rank = F.struct("mates", "id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)))
        open_ = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max_by(F.struct(*own), rank).alias("p")).where("lo < hi")
        pivots = materialise(open_.select("key", "p"), "open")
        pairs = now.join(pivots, "key").where((F.col("label") != F.col("p.label")) & alike("", "p.")).select("id", F.col("p.id").alias("other"))
        candidates = materialise(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "candidates")
        new = materialise(verified(candidates, sets, percent).distinct(), "links")
        release(now, pivots, candidates)
        links, labels = joined(links, new, labels)
    now = labelled(members, labels)
    open_ = materialise(now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "open")
    rest = with_small_buckets(materialise(now.join(open_, "key", "left_semi"), "left"), sets, percent)
    left = in_blocks(rest).groupBy("key", "part").applyInArrow(near, "key long, part int, own int, crossed boolean, id long, n long, label long")
    tested = left.join(sets, "id").select("key", "part", "own", "crossed", "id", "label", "set").groupBy("key", "part").applyInArrow(linker(percent), "a long, b long")
    links, labels = joined(links, materialise(tested.distinct(), "links"), labels)
    release(now, open_, rest, sets, members, found, shared)
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("label", "rep").alias("component"))
    of_rows = rows.join(named, ["f1", "f2"], "left").select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"))
    return of_rows.select("id", F.col("n").alias("n_shingles"), "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("id"))).alias("kept"))
