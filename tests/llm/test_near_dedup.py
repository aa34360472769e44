import random

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import near_dedup as nd, queries
from marlstone.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = [w for w in (text or "").translate(LOWER).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    return {tuple(words[j : j + k]) for j in range(max(len(words) - k, 0) + 1)} if words else set()


def by_hand(docs, k, percent):
    sets = [(d, shingles(t, k)) for d, t in docs]
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted(((d, len(s), root(d), d is None or d == root(d)) for d, s in sets), key=str)


def run(spark, docs, **options):
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, LABEL string")
    return sorted(((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dedup(frame, **options).collect()), key=str)


def test_families_around_the_threshold(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(rng.randint(2, 9)):
            w = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else x for x in base]
            docs.append((n, " ".join(w)))
            n += 1
    rng.shuffle(docs)
    for k in (2, 5):
        assert run(spark, docs, shingle_words=k) == by_hand(docs, k, 80)


def test_defined_results(spark):
    docs = [(9, None), (8, ""), (7, " \n"), (6, "One"), (5, "one"), (4, "a b"), (3, "A\tB"), (2, "a b"), (1, "É x"), (0, "é x")]
    docs += [(20, "same text of five words"), (21, "same text of five words"), (21, "a different text under one id"), (22, "a different text under one id"), (None, "one"), (None, None), (30, "w " * 50_000), (31, "w " * 40_000)]
    assert run(spark, docs, shingle_words=2) == by_hand(docs, 2, 80)
    assert nd.near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_coordinate_fills_and_estimates(spark):
    rng = np.random.default_rng(1)
    for size in (1, 2, 10, 400, 5000):
        one = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        cut = one[: max(1, int(size * 0.9))]
        s = nd.sketch(np.concatenate([one, cut]), np.array([0, one.size, one.size + cut.size]))
        assert (s != np.uint64(2**64 - 1)).all()
        assert abs((s[0] == s[1]).mean() - cut.size / one.size) < 0.1
        alone = nd.sketch(one, np.array([0, one.size]))
        assert (alone[0] == s[0]).all()  # a sketch depends on its own set only


def test_components_of_stars_chains_and_rings(spark):
    rng = random.Random(8)
    edges = [(0, k) for k in range(1, 200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(3000 + k, 3000 + (k + 1) % 17) for k in range(17)]
    names = {x: rng.randrange(10**9) for e in edges for x in e}
    edges = [(names[a], names[b]) for a, b in edges]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for low, high in ((0, 999), (1000, 2999), (3000, 3999)):
        group = {names[x] for x in names if low <= x <= high}
        assert {got[x] for x in group} == {min(group)}


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op2_minhash_near_dedup(spark, sf).collect()), key=str)
    assert got == by_hand(docs, 2, 80)
    kept = sum(r[3] for r in got)
    assert 0 < kept < len(docs)


def test_large_buckets_are_tested_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "GROUP_WEIGHT", 200)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(60)]
    docs = [(k, " ".join(word() if rng.random() < 0.045 else x for x in base)) for k in range(60)]
    want = by_hand(docs, 2, 80)
    assert len({r[2] for r in want}) > 1
    assert run(spark, docs, shingle_words=2) == want


def test_every_pair_of_a_large_bucket_meets_once(spark, monkeypatch):
    monkeypatch.setattr(nd, "GROUP_WEIGHT", 2_000)
    members = spark.range(400).selectExpr("1L AS key", "id", "10L AS n").unionByName(spark.createDataFrame([(2, 1000, 5), (2, 1001, 5)], "key long, id long, n long"))
    met, rows = {}, 0
    parts = {}
    for r in nd.in_blocks(members).collect():
        parts.setdefault((r["key"], r["part"]), []).append(r.asDict())
        rows += 1
    for part in parts.values():
        table, first = nd.sides(pa.Table.from_pylist(part))
        ids = table.column("id").to_pylist()
        for k in range(first or max(len(ids) - 1, 0)):
            for other in ids[first or k + 1 :]:
                pair = (min(ids[k], other), max(ids[k], other))
                met[pair] = met.get(pair, 0) + 1
    assert set(met.values()) == {1} and len(met) == 400 * 399 // 2 + 1
    assert rows < 400 * 12 + 3


def test_similarities_that_bands_are_not_made_for_are_refused(spark):
    with pytest.raises(ValueError):
        nd.near_dedup(spark.createDataFrame([], "doc_id long, text string"), percent=50)


def test_members_of_a_large_bucket_meet_by_rare_shingles_only(spark, monkeypatch):
    """Texts that share half of their shingles, among them a few that are similar."""
    monkeypatch.setattr(nd, "GROUP_WEIGHT", 2_000)
    rng = np.random.default_rng(12)
    common = rng.integers(0, 2**62, 60, dtype=np.int64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**62, 60, dtype=np.int64)])) for _ in range(400)]
    for k in range(0, 40, 2):
        sets[k + 1] = np.unique(np.concatenate([sets[k][6:], rng.integers(0, 2**62, 6, dtype=np.int64)]))
    rows = spark.createDataFrame([(1, k, int(s.size), k) for k, s in enumerate(sets)], "key long, id long, n long, label long")
    packed = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "id long, set binary")
    got = nd.with_small_buckets(rows, packed, 80).collect()
    buckets = {}
    for r in got:
        buckets.setdefault(r["key"], set()).add(r["id"])
    met = {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}
    share = lambda a, b: np.intersect1d(sets[a], sets[b]).size / np.union1d(sets[a], sets[b]).size
    similar = {(a, b) for a in range(400) for b in range(a + 1, 400) if share(a, b) >= 0.8}
    assert len(similar) >= 20 and similar <= met and len(met) < 2 * len(similar)
