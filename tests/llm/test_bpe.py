import bisect
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import bpe, queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "a", "\n\n\n", "  leading and trailing  ", "a" * 5000, "ab" * 3000, "é" * 999, "don't we'll I'D they're",
    "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "日本語のテキスト", "  x　y\u0085z ", "\x1c\x1d\x1e\x1f a \x0b\x0c b",
    "١٢٣ ⅷ ² 12 3,456.78", "é ̀x", "🎉🎊 👩‍👩‍👧", "�﻿", "A\r\nB\r\n\r\n  C\t\tD", "#### $$%%&& <b>x</b> ||",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_every_character_is_split_as_the_library_splits_it(library):
    codec = bpe.load(PATH)
    letters = [chr(c) for c in range(0x11_0000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}1{c} {c}\n" for c in letters[:0x3100])
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == expected(library, text)[0]
    for at in range(0, len(letters), 20_000):
        text = "".join(f"a{c} " for c in letters[at : at + 20_000])
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == expected(library, text)[0], at


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(library, text):
    codec = bpe.load(PATH)
    ids, decoded = expected(library, text)
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
    assert codec.decode(codec.encode(text)) == decoded


def test_random_pieces(library):
    codec, rng = bpe.load(PATH), random.Random(7)
    for alphabet in ("ab", "aeinorst", "the in ion", "01", "=-_", "éèaß"):
        for _ in range(300):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == expected(library, text)[0]


def test_query_equals_library_on_the_whole_table(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_bpe_encode_decode(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = expected(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_nulls_ties_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "same", "y"), (None, "same", None), (2, "", "z")], "doc_id long, text string, IDS string")
    rows = bpe.encode_decode(docs, PATH).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in rows) == [(0, 4, "same"), (0, 4, "same"), (1, 0, ""), (2, 0, "")]
    assert bpe.encode_decode(docs.limit(0), PATH).collect() == []
    counted = token_counts.token_counts(docs, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["section"], r["n_tokens"]) for r in counted) == [(0, 0, 1), (0, 0, 1), (1, 0, 0), (2, 0, 0)]
    assert token_counts.token_counts(docs.limit(0), PATH).collect() == []


def by_hand(library, text, rule):
    """Tokens of each line, from the library's own offsets."""
    cuts, at = [], 0
    for line in text.split("\n"):
        if len(line) + 1 and at <= len(text):
            cuts.append(at)
        at += len(line) + 1
    if len(cuts) > 1 and cuts[-1] >= len(text):
        cuts.pop()
    spans = library.encode(text, add_special_tokens=False).offsets
    counts = [0] * len(cuts)
    section = lambda c: max(k for k, x in enumerate(cuts) if x <= c)
    for a, b in spans:
        inside = [section(c) for c in range(a, b)]
        counts[{"first": inside[0], "last": inside[-1], "most": max(dict.fromkeys(inside), key=inside.count)}[rule]] += 1
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_equals_offsets_of_the_library(spark, library, rule):
    texts = ["one line", "a\n\n\n\nb\nc\n", "\n\n", "é\n日本\n\n\n語 x\n", "word \n\n\n   indented\n\t\n\n\ny", "🎉\n🎉🎉\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in token_counts.token_counts(docs, PATH, rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r["n_tokens"])
    for k, text in enumerate(texts):
        assert got[k] == by_hand(library, text, rule), text


def test_sections_tile_documents_and_counts_add_up(spark, sf):
    counted = queries.op4_token_counts(spark, sf).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))
    whole = queries.op10_bpe_encode_decode(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length("text").alias("len"))
    assert counted.join(whole, "doc_id").join(docs, "doc_id").where("n <> n_tokens OR chars <> len").count() == 0


def test_fields(spark):
    docs = spark.createDataFrame([(1, "title", None, "the body\nin two lines")], "doc_id long, title string, none string, text string")
    rows = token_counts.token_counts(docs, PATH, fields=("title", "none", "text"), by_line=False).orderBy("section").collect()
    assert [(r["field"], r["char_start"], r["char_end"]) for r in rows] == [("title", 0, 7), ("text", 7, 28)]


def test_counts_of_every_line_equal_offsets_of_the_library(spark, sf, library):
    """The query over the whole table, section by section."""
    got = {}
    for r in queries.op4_token_counts(spark, sf).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        starts = [r["char_start"] for r in got[k]]
        cuts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
        assert starts == cuts and [r["char_end"] for r in got[k]] == [*cuts[1:], len(text)]
        counts = [0] * len(cuts)
        for a, _ in library.encode(text, add_special_tokens=False).offsets:
            counts[bisect.bisect_right(cuts, a) - 1] += 1
        assert [r["n_tokens"] for r in got[k]] == counts


def test_a_long_document_and_clashing_columns(spark):
    text = "word 日本 line\n" * 150_000
    docs = spark.createDataFrame([(1, text, "x", 5), (1, text, "x", 5), (None, "a", "x", 5)], "doc_id long, text string, section string, n_tokens int")
    got = token_counts.token_counts(docs, PATH).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("char_end").alias("end")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 300_000, len(text)), (None, 1, 1)], key=str)
