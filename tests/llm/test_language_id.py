import math
import zlib

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import language_id as lid, queries


def test_query_is_right_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    fold = got.where("held_out")
    assert got.count() == 1000 and fold.count() > 250
    assert fold.where("lang_pred = lang").count() >= 0.98 * fold.count()
    assert got.where("score < 0 OR score > 1").count() == 0
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)).count() == 0


def test_known_words_come_first_and_unseen_words_back_off():
    model = lid.Model({("en", "the"): 50, ("en", "thing"): 5, ("fr", "chose"): 9, ("fr", "thon"): 1})
    n = len(model.words.gains)
    assert np.allclose(model.word_scores("the"), [math.log(50.5 / (55 + 0.5 * n)), math.log(0.5 / (10 + 0.5 * n))])
    unseen = model.word_scores("things")
    assert unseen[model.langs.index("en")] > unseen[model.langs.index("fr")]
    assert set(model.word_scores("日本")) == {0}


def test_defined_results(spark):
    model = lid.Model({("en", "the"): 5, ("fr", "le"): 5})
    rows = [(1, None, "q"), (2, "", "q"), (3, "12 34 !!", "q"), (4, "the " * 50_000, "q"), (5, "LE LE", None), (5, "LE LE", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    got = lid.predict(docs, model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (5, "fr")]
    assert [r["score"] for r in got[:3]] == [0, 0, 0]
    assert lid.predict(docs.limit(0), model).collect() == []
    empty = lid.train(spark.createDataFrame([(None, "x"), ("en", None)], "lang string, text string"))
    assert lid.Scorer(empty).predict("the") == ("und", 0.0)


def test_training_is_bounded_by_texts_alone(spark):
    docs = spark.createDataFrame([("en", f"word{chr(97 + k // 26)}{chr(97 + k % 26)} the") for k in range(300)], "lang string, text string")
    model = lid.train(docs, docs_per_lang=10)
    assert len(model.words.gains) == 11 and "the" in model.words.gains


def test_every_language_is_learned(spark):
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    docs = spark.createDataFrame([(f"l{k:03}", f"{name(k)}q{name(k)} {name(k)}") for k in range(100)], "lang string, text string")
    model = lid.train(docs)
    assert model.langs == [f"l{k:03}" for k in range(100)]
    assert all(lid.Scorer(model).predict(f"{name(k)}q{name(k)}")[0] == f"l{k:03}" for k in range(100))


def test_every_word_of_the_sample_is_learned(spark):
    words = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(25_000)]
    model = lid.train(spark.createDataFrame([("en", " ".join(words)), ("fr", "le")], "lang string, text string"))
    assert set(words) <= set(model.words.gains)


def by_hand(text, sample):
    """Word-first backoff without tables: ``sample`` is a list of (lang, words)."""
    langs = sorted({lang for lang, _ in sample})
    words = regex.findall(r"\p{L}+", (text or "").lower())
    if not words:
        return "und", 0.0
    scores = dict.fromkeys(langs, 0.0)
    for w in words:
        parts = COUNTS.get(w)
        if parts is None:
            units = [("w", w)]
            for order in (4, 3, 2, 1):
                if units[0] in KNOWN:
                    break
                marked = w if order == 1 else f"<{w}>"
                grams = [(order, marked[k : k + order]) for k in range(len(marked) - order + 1)]
                units = [g for g in grams if g in KNOWN]
                if units and 2 * len(units) >= len(grams):
                    break
                units = [("w", w)]
            parts = COUNTS[w] = {}
            for lang in langs:
                logs = [math.log((KNOWN[u].get(lang, 0) + 0.5) / (TOTALS[u[0]].get(lang, 0) + 0.5 * SIZES[u[0]])) for u in units if u in KNOWN]
                parts[lang] = sum(logs) / len(logs) if logs else 0.0
        for lang in langs:
            scores[lang] += parts[lang]
    odds = {lang: s / len(words) * min(len(words), 12) for lang, s in scores.items()}
    best = max(langs, key=lambda x: odds[x])
    return best, 1 / sum(math.exp(v - odds[best]) for v in odds.values())


COUNTS, KNOWN, TOTALS, SIZES = {}, {}, {}, {}


def test_query_equals_brute_force_backoff(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    sample, per_lang = [], {}
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            h = xxhash.xxh64_intdigest(r["text"].encode(), 42)
            per_lang.setdefault(r["lang"], {})[(h - (1 << 64) if h >> 63 else h) % 1_000_000_007] = r["text"]
    for lang, texts in per_lang.items():
        sample += [(lang, regex.findall(r"\p{L}+", texts[d].lower())) for d in sorted(texts)[:400]]
    for lang, words in sample:
        for w in words:
            for unit in [("w", w), *((o, m[k : k + o]) for o in (4, 3, 2, 1) for m in [w if o == 1 else f"<{w}>"] for k in range(len(m) - o + 1))]:
                of = KNOWN.setdefault(unit, {})
                of[lang] = of.get(lang, 0) + 1
    for unit in [u for u, of in KNOWN.items() if u[0] != "w" and sum(of.values()) < 2]:
        del KNOWN[unit]
    for (kind, _), of in KNOWN.items():
        SIZES[kind] = SIZES.get(kind, 0) + 1
        for lang, c in of.items():
            TOTALS.setdefault(kind, {})[lang] = TOTALS.get(kind, {}).get(lang, 0) + c
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, sf).collect()}
    for r in docs:
        lang, score = by_hand(r["text"], sample)
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-6 and (got[r["doc_id"]]["lang_pred"] == lang or score < 0.51), r["doc_id"]


def test_short_texts_of_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = lid.held_out(F.col("doc_id"))
    model = lid.train(docs.where(~fold))
    cut = docs.where(fold).select("lang", F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("text"))
    right = lid.predict(cut, model).where("lang_pred = lang").count()
    assert right >= 0.93 * cut.count()


def test_words_are_letters_and_a_long_text_is_chunked():
    model = lid.Model({("en", "the"): 5, ("en", "cat"): 3, ("fr", "le"): 5, ("fr", "chat"): 3})
    assert lid.words_of("The½cat ١٢ x_y") == ["the", "cat", "x", "y"]
    many = " ".join("".join(chr(97 + k // 26**i % 26) for i in range(5)) for k in range(300_000))
    scorer = lid.Scorer(model)
    scorer.most = 2_000
    assert scorer.predict(many + " the" * 200_000)[0] == "en" and len(scorer.table) <= 8_192


def test_a_language_that_is_mostly_copies_of_one_text_is_learned_from_the_others(spark):
    copied = spark.range(100_000).selectExpr("'en' AS lang", "'hello' AS text")
    words = ["".join(chr(97 + k // 26**i % 26) for i in range(3)) for k in range(300)]
    others = spark.createDataFrame([("en", f"q{w}") for w in words] + [("fr", f"z{w}") for w in words], "lang string, text string")
    model = lid.train(copied.unionByName(others))
    assert set(model.words.gains) == {"hello", *(f"{c}{w}" for c in "qz" for w in words)}
