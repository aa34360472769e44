import hashlib
import random
import re

import pytest

from marlstone.llm import decontaminate as dc, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text.translate(LOWER)) if text else []


def by_hand(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, other in items:
        v = words(other)
        for k in range(max(len(v) - 8, 0) + 1 if v else 0):
            window = v[k : k + 8]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def cases():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("ab c de é日 x1".split()) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 3, 5, 8, 9, 20]))) for k in range(12)] + [(12, None), (13, ""), (14, "..."), (14, "A-b! c"), (0, "twice the id")]
    docs = [None, "", "a", "A", "!!", "b" * 10] + [say(rng.randint(1, 60)) for _ in range(60)]
    for _ in range(30):
        inner = rng.choice(items)[1] or ""
        docs.append(f"{say(5)}. {inner.upper() if rng.random() < 0.3 else inner}; {say(4)}")
    return docs, items


@pytest.mark.parametrize(("broadcast_bytes", "shingle"), [(1 << 20, 3), (1 << 20, 7), (-1, 3), (-1, 1)])
def test_equals_brute_force(spark, broadcast_bytes, shingle):
    docs, items = cases()
    frame = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(docs)], "doc_id long, text string, N_HIT string")
    for r in dc.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), shingle=shingle, broadcast_bytes=broadcast_bytes).collect():
        n, hit, found = by_hand(docs[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], sorted(r["items"])) == (n, hit, found), docs[r["doc_id"]]
        assert sum(s["end"] - s["begin"] for s in r["hits"]) == hit


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_empty_tables_and_null_ids(spark, broadcast_bytes):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    assert [(r["n_hit"], r["items"]) for r in dc.decontaminate(docs, items, broadcast_bytes=broadcast_bytes).collect()] == [(2, [""])] * 3
    assert [r["n_hit"] for r in dc.decontaminate(docs, items.limit(0), broadcast_bytes=broadcast_bytes).collect()] == [0, 0, 0]
    assert dc.decontaminate(docs.limit(0), items, broadcast_bytes=broadcast_bytes).collect() == []


def test_query_on_the_whole_table(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    grams = {" ".join(words(t)[k : k + 8]) for _, t in items for k in range(len(words(t)) - 7)}
    for r in queries.op7_decontaminate(spark, sf).collect():
        text = texts[r["doc_id"]]
        w = words(text)
        near = any(" ".join(w[k : k + 8]) in grams for k in range(len(w)))
        n, hit, found = by_hand(text, items) if near else (len(w), 0, [])
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest() and r["contaminated"] == (len(found) >= 2)


def test_a_large_benchmark_is_joined(spark):
    """A long item with more than a million different words; documents that quote it, one of them long."""
    many = [f"w{k:x}" for k in range(1_050_000)]
    quote = " ".join(many[700_000:700_012])
    items = spark.createDataFrame([(1, " ".join(many)), (2, quote), (2, quote)], "item_id long, text string")
    docs = spark.createDataFrame([(1, quote), (2, f"x {quote[:-1]} y"), (3, "other words " * 300_000 + quote), (4, " ".join(many[700_000:700_007]))], "doc_id long, text string")
    assert items.selectExpr("sum(length(text))").first()[0] > dc.BROADCAST_BYTES
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in dc.decontaminate(docs, items).collect()}
    assert got == {1: (12, ["1", "2"]), 2: (11, ["1", "2"]), 3: (12, ["1", "2"]), 4: (0, [])}
