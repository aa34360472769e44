import hashlib
import random

from pyspark.sql import functions as F

from marlstone.llm import line_dedup as ld, queries


def by_hand(docs, min_sites, min_words=ld.MIN_WORDS):
    """docs: (id, text, site); the texts that are left."""
    sites, first = {}, {}
    for d, text, site in docs:
        for line in (text or "").split("\n") if text is not None else []:
            x = line.strip(ld.SPACES)
            if len(x.split()) >= min_words:
                sites.setdefault(x, set()).add(site)
                if d is not None:
                    first[x] = min(first.get(x, d), d)
    gone = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for d, text, _ in docs:
        keep = [x for x in text.split("\n") if x.strip(ld.SPACES) not in gone or first.get(x.strip(ld.SPACES)) == d] if text is not None else None
        out.append((d, None if keep is None else "\n".join(keep)))
    return out


def test_equals_brute_force_around_the_threshold(spark):
    rng = random.Random(2)
    pool = [f"line number {k} of many" for k in range(60)] + ["a b", " spaced  line here ", "é 日本 🎉 x"]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6))), f"s{rng.randint(0, 14)}") for k in range(120)]
    docs += [(None, pool[0], None), (200, None, "s1"), (201, "", "s1"), (201, pool[1], "s2"), (202, "x " * 20_000, "s1")]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, N_LINES string")
    for sites in (2, 6, 8):
        got = ld.line_dedup(frame, min_sites=sites).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(by_hand(docs, sites), key=str)
    assert ld.line_dedup(frame.limit(0)).collect() == []


def test_sketches_estimate_large_spreads(spark):
    lines = spark.range(20_000).selectExpr("1L AS line", "xxhash64(id) AS site", "id")
    register, rank = ld.registers(lines.site)
    from pyspark.sql import functions as F

    sketch = lines.groupBy(register.alias("r")).agg(F.max(rank).alias("k")).agg(F.sum(F.pow(F.lit(2.0), -F.col("k"))).alias("p"), F.count(F.lit(1)).alias("n"))
    assert abs(sketch.select(ld.estimate(F.col("p"), F.col("n"))).first()[0] / 20_000 - 1) < 0.25


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["kept_sha256"] for r in queries.op9_line_dedup(spark, sf).collect()}
    assert got == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in by_hand(docs, ld.MIN_SITES)}


def test_short_lines_and_lines_without_spaces_count(spark):
    short = ["Les.", "And ornd.", "版权所有，未经许可不得转载。"]
    docs = [(k, "\n".join([*short, "", f"own line {k} here", " \t"]), f"s{k}") for k in range(ld.MIN_SITES)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got[0] == (docs[0][1], 0)
    assert all(got[k] == (f"\nown line {k} here\n \t", 3) for k in range(1, ld.MIN_SITES))


def test_ten_sites_that_share_registers_are_counted_exactly(spark):
    site = spark.range(3_000).select(F.concat(F.lit("s"), "id").alias("s"))
    register, _ = ld.registers(F.xxhash64("s"))
    by_register = {}
    for r in site.select("s", register.alias("r")).collect():
        by_register.setdefault(r["r"], []).append(r["s"])
    crowded = sorted(by_register.values(), key=len)[-3:]
    seven = [s for v in crowded for s in v][:6] + [v[0] for v in sorted(by_register.values(), key=len)[:4]]
    assert len(set(seven)) == 10
    docs = [(k, "one line here\nonly nine", s) for k, s in enumerate(seven[:9])] + [(9, "one line here", seven[9])]
    got = ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(0, "one line here\nonly nine"), *((k, "only nine") for k in range(1, 9)), (9, "")]
    assert ld.least_filled(10) <= 4 and ld.least_filled(1) == 1


def test_thresholds_beyond_the_registers(spark):
    docs = spark.range(700).selectExpr("id AS doc_id", "concat('common', if(id < 600, '\nrarer', '')) AS text", "concat('s', id) AS source")
    got = ld.line_dedup(docs, min_sites=650).groupBy("text").count().collect()
    assert {(r["text"], r["count"]) for r in got} == {("common\nrarer", 1), ("rarer", 599), ("", 100)}
