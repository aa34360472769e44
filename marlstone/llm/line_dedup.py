"""Line dedup: cross-site boilerplate by the number of sites a line is on.

A line's sites are counted with a HyperLogLog sketch: a site's hash picks one of
``REGISTERS`` registers and raises it to its rank.  Sketches are kept as rows
(line, register, rank), so they merge by ``max`` and Spark combines them before
the shuffle; a line on every site has ``REGISTERS`` rows at most.  As many
registers as sites that are asked for prove that a line is on enough sites; so
few that chance can't explain it rule it out; lines between get exact distinct
counts.  A line
on ``min_sites`` sites or more is removed, except from the document with the
smallest id that has it, so no text is lost from the corpus.

Lines are compared without white space at their ends.  Every line that isn't
blank counts, however short: the number of sites alone decides.

Defined results: a null text has no lines and stays null; a document of which no
line is left keeps the empty string; documents that share an id keep or lose a
line together; a null site is a site of its own, a null id is never the
smallest; an empty table gives no rows; long texts are handled whole; columns
other than the text, ``n_lines`` and ``n_removed`` are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import WHITE_SPACE, materialise, ship, small

MIN_SITES, MIN_WORDS = 10, 1
REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
#: A line that is on enough sites is left without an exact count with less than this probability.
MISS = 1e-12
#: Where sketches are full, estimates within this share of the threshold get exact counts: 7.5 standard errors.
NEAR = 7.5 * 1.04 / REGISTERS**0.5
SPACES = " \t\n\x0b\x0c\r"


def registers(site: Column) -> tuple[Column, Column]:
    """Register and rank of a site's hash."""
    h = F.xxhash64(site)
    rest = F.shiftrightunsigned(h, REGISTER_BITS)
    return F.pmod(h, F.lit(REGISTERS)).cast("int"), (F.lit(65 - REGISTER_BITS) - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))).cast("int")


def estimate(power_sum: Column, filled: Column) -> Column:
    """Distinct count from the sum of 2^-rank over filled registers and their number."""
    m, empty = F.lit(float(REGISTERS)), F.lit(REGISTERS) - filled
    raw = F.lit(0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS**2) / (power_sum + empty)
    return F.when((raw <= 2.5 * REGISTERS) & (empty > 0), m * F.log(m / empty)).otherwise(raw)


@lru_cache
def least_filled(sites: int) -> int:
    """Registers that so many sites fill at least, but for the probability ``MISS``."""
    chance = [1.0] + [0.0] * REGISTERS  # of k filled registers after each site
    for _ in range(sites):
        chance = [0.0] + [chance[k] * k / REGISTERS + chance[k - 1] * (REGISTERS - k + 1) / REGISTERS for k in range(1, REGISTERS + 1)]
    below, k = 0.0, 0
    while below + chance[k] < MISS:
        below += chance[k]
        k += 1
    return k


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``line`` and ``first_id`` of lines on enough sites; ``lines`` has line, site, id."""
    register, rank = registers(F.col("site"))
    sketches = lines.groupBy("line", register.alias("register")).agg(F.max(rank).alias("rank"), F.min("id").alias("first_id"))
    merged = sketches.groupBy("line").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("powers"), F.count(F.lit(1)).alias("filled"), F.min("first_id").alias("first_id"))
    # Sites fill a register each at most.  With few sites their number decides alone, with many the estimate.
    few = min_sites <= REGISTERS
    sure = F.col("filled") >= min_sites if few else F.col("sites") > min_sites * (1 + NEAR)
    possible = F.col("filled") >= least_filled(min_sites) if few else F.col("sites") >= min_sites * (1 - NEAR)
    judged = materialise(merged.withColumn("sites", estimate(F.col("powers"), F.col("filled"))).where(sure | possible).select("line", "first_id", sure.alias("sure")), "line-spread")
    far = judged.where("sure").select("line", "first_id")
    near = judged.where("NOT sure").select("line", "first_id")
    pairs = lines.join(near.select("line"), "line", "left_semi").select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line")
    return far.unionByName(near.join(exact, "line", "left_semi"))


def line_dedup(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without boilerplate lines, with ``n_lines`` and ``n_removed``."""
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    long_enough = F.filter(trimmed, lambda x: (x != "") & (F.size(F.split(x, WHITE_SPACE)) >= min_words))
    hashes = F.array_distinct(F.transform(long_enough, lambda x: F.xxhash64(x)))
    site = F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0"))
    # Rows are named by id and text, so that no id, null least of all, gathers the lines of many texts.
    lines = materialise(docs.select(F.explode(hashes).alias("line"), F.xxhash64(site).alias("site"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text")), "lines")
    found = boilerplate(lines, min_sites)
    later = lines.join(found, "line").where(~F.col("id").eqNullSafe(F.col("first_id")))
    removed = later.groupBy(F.col("id").alias("__id"), F.col("text").alias("__text")).agg(F.collect_set("line").alias("__removed"))
    rest = [f for f in docs.schema.fields if f.name.lower() not in ("n_lines", "n_removed")]
    names = [f.name for f in rest]
    at = names.index(text_col)
    out = T.StructType([*rest, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in small(batches, at):
            texts, counts, cut = batch.column(at).to_pylist(), [], []
            for k, gone in enumerate(batch.column(len(names)).to_pylist()):
                lines = texts[k].split("\n") if texts[k] is not None else []
                kept = lines
                if gone:
                    gone = {h & (1 << 64) - 1 for h in gone}
                    kept = [x for x in lines if xxh64_intdigest(x.strip(SPACES).encode(), 42) not in gone]
                    texts[k] = "\n".join(kept)
                counts.append(len(lines))
                cut.append(len(lines) - len(kept))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(cut, pa.int64())], names=out.names)

    joined = docs.select(*(F.col(f"`{c}`") for c in names)).join(removed, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__text")), "left")
    return joined.select(*(F.col(f"`{c}`") for c in names), "__removed").mapInArrow(run, out)
