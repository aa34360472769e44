import hashlib
import random

import numpy as np
import pytest

from marlstone.llm import queries, repeats as rp


def by_hand(docs):
    """docs: (id, text); per row what is left and the number of removed runs."""
    first = {}
    for d, t in docs:
        raw, d = (t or "").encode(), rp.NO_ID if d is None else d
        for k in range(len(raw) - rp.LENGTH + 1):
            w = raw[k : k + rp.LENGTH]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        raw, gone = (t or "").encode(), set()
        for k in range(len(raw) - rp.LENGTH + 1):
            if first[raw[k : k + rp.LENGTH]] < (rp.NO_ID if d is None else d):
                gone.update(range(k, k + rp.LENGTH))
        runs = sum(k - 1 not in gone for k in gone)
        out.append((d, len(raw), len(gone), runs, hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs):
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, ID string")
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rp.remove_repeats(frame).collect()), key=str)


def cases(seed, n=60):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice("abcdefghij é\n") for _ in range(k))
    pool = [say(k) for k in (20, 49, 50, 51, 60, 120, 400)] + ["ab" * 60, "x" * 150]
    docs = [(k, "".join(rng.choice(pool) if rng.random() < 0.5 else say(rng.randint(0, 90)) for _ in range(rng.randint(0, 5)))) for k in range(n)]
    rng.shuffle(docs)
    docs += [(n, docs[0][1]), (n + 1, docs[0][1]), (3, pool[5]), (3, pool[5]), (3, pool[6]), (None, pool[5] + say(9)), (None, None), (n + 2, None), (n + 3, ""), (n + 4, say(80_000)), (n + 5, "q" * 3000)]
    return docs


@pytest.mark.parametrize(("seed", "least", "hot"), [(1, 1 << 20, 8192), (2, 700, 8192), (3, 1500, 20), (4, 400, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, least, hot):
    monkeypatch.setattr(rp, "LEAST", least)
    monkeypatch.setattr(rp, "MOST", least if seed == 1 else least * 20)
    monkeypatch.setattr(rp, "HOT_RUNS", hot)
    docs = cases(seed)
    assert run(spark, docs) == by_hand(docs)


def test_long_texts_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(rp, "CHUNK", 1000)
    docs = cases(9)
    assert run(spark, docs) == by_hand(docs)


def test_empty_table(spark):
    assert rp.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_previous_factors_equal_brute_force():
    rng = np.random.default_rng(5)
    for size, letters in ((400, 2), (900, 3), (300, 1)):
        text = rng.integers(97, 97 + letters, size).astype(np.uint8)
        starts = np.arange(0, size - rp.LENGTH + 1)
        docs = rng.integers(0, 6, starts.size)
        raw, got = text.tobytes(), rp.previous_factors(text, starts, docs)
        for a in starts[::7].tolist():
            best = 0
            for b in starts.tolist():
                if docs[b] < docs[a]:
                    k = next((j for j in range(rp.LENGTH) if raw[a + j] != raw[b + j]), rp.LENGTH)
                    best = max(best, k)
            assert got[a] == (best if best >= rp.SEED else 0)


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op8_suffix_array_dedup(spark, sf).collect()), key=str) == by_hand(docs)


def test_a_row_that_repeats_very_often_is_one_row(spark):
    text = "a passage that is a good deal longer than fifty bytes, and then some more"
    many = spark.range(30_000).selectExpr("7L AS doc_id", f"'{text}' AS text")
    rows = many.unionByName(spark.createDataFrame([(1, text), (7, "x"), (None, text), (None, text)], "doc_id long, text string"))
    got = rp.remove_repeats(rows).groupBy("id", "n_bytes", "n_removed", "n_spans").count().collect()
    n = len(text)
    assert sorted(map(tuple, got), key=str) == sorted([(7, n, n, 1, 30_000), (1, n, 0, 0, 1), (7, 1, 0, 0, 1), (None, n, n, 1, 2)], key=str)
    assert rp.single(rows.selectExpr("coalesce(doc_id, 99) AS id", "doc_id IS NULL AS no_id", "text", "1L AS n")).count() == 4


def test_hashes_by_chunks_and_bytes_where_hashes_meet(monkeypatch):
    rng = np.random.default_rng(8)
    raw = rng.integers(0, 3, 5_000).astype(np.uint8)
    first = rng.integers(0, 4_000, 700)
    length = rng.integers(1, 1_000, 700)
    whole = rp.hashes(raw, first, length)
    monkeypatch.setattr(rp, "CHUNK", 333)
    assert (rp.hashes(raw, first, length) == whole).all()
    again = np.concatenate([raw, raw])
    assert (rp.hashes(again, first + raw.size, length) == whole).all()
    # One name for all: bytes decide.
    length = np.full(700, 4)
    got = rp.differs(raw, np.zeros(700, np.uint64), first, length)
    want = [True] + [raw[a : a + 4].tobytes() != raw[b : b + 4].tobytes() for a, b in zip(first[1:], first[:-1])]
    assert got.tolist() == want and 0 < sum(want) < 700
