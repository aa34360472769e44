"""The training-data pipeline: five stages over ``documents``, each written as
Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of ``documents``.

Defined results of every stage: an empty table gives no rows; texts are handled
whole, however long; columns beside ``doc_id`` and ``text`` (and ``lang``, ``source``,
``n_chars``, where a stage says so) are carried through whatever their names and
types, and need not exist.  Null and empty texts, ties and repeated rows are stated
with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.llm import bpe, decontaminate as dc, language_id as lid, line_dedup as ld, near_dedup as nd
from marlstone.llm.common import materialise
from marlstone.llm.queries import vocabulary
from marlstone.sources.scratch import scratch

#: A text whose best language gets less than this is in none that the model knows.
MIN_SCORE = 0.3
#: Benchmark items with an occurring window that make a document a leak.
MIN_ITEMS = 1


def carried(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with the columns that a stage doesn't use under names that clash with nothing, and
    what gives the columns back; ``changes`` replace some, in the type they have."""
    names = {c: c if c in used else f"__carried{k}" for k, c in enumerate(docs.columns)}

    def back(done: DataFrame, **changes: Column) -> DataFrame:
        kinds = {f.name: f.dataType for f in docs.schema.fields}
        return done.select(*(changes[c].cast(kinds[c]).alias(c) if c in changes else F.col(f"`{n}`").alias(c) for c, n in names.items()))

    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), back


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language; ``lang`` becomes the predicted one.

    Null, empty and letterless texts go; equal texts get equal results; of languages
    that fit equally the first by name is taken; rows without an id or a label are
    judged, but not learned from; repeated rows stay repeated.
    """
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    own, back = carried(docs, "doc_id", "text")
    model = lid.train(docs.where(~lid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("text", "lang"))
    done = lid.predict(own, model).where((F.col("lang_pred") != lid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return back(done, lang=F.col("lang_pred"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove boilerplate lines, and documents of which nothing else is left.

    A line stays in the document with the smallest id, in all rows of that id; null and
    empty texts stay as they are; a null ``source`` is a source of its own; ``n_chars``,
    where there is one, follows the text.
    """
    own, back = carried(docs, "doc_id", "text", "source")
    if "source" not in docs.columns:
        own = own.withColumn("source", F.lit(None).cast("string"))
    done = ld.line_dedup(own).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return back(done, **({"n_chars": F.length("text")} if "n_chars" in docs.columns else {}))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-copies (five words, 0.8) the document with the smallest id.

    Rows without an id are documents like others, larger than any id; of rows that
    repeat with id and text one stays; different texts under one id are one document,
    which stays or goes as one; null and empty texts are copies of nothing.
    """
    own, back = carried(docs, "doc_id", "text")
    # An id for each row: without one of its own, one above all others that the text gives.
    name = F.xxhash64("text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.lit(2), "text"), 2))
    keyed = own.withColumns({"__key": key, "__name": F.coalesce(name, F.lit(0))})
    groups = materialise(nd.near_dedup(keyed, id_col="__key").select("id", "kept"), "near-copies")
    dropped = groups.where("NOT kept").select(F.col("id").alias("__key")).distinct()
    kept = keyed.join(dropped.hint("merge"), "__key", "left_anti")  # dealt by id at every size
    again = materialise(groups.groupBy(F.col("id").alias("__key")).count().where("count > 1").select("__key"), "repeated-ids")
    if again.isEmpty():
        return back(kept)
    several = kept.join(again, "__key", "left_semi").dropDuplicates(["__key", "__name"])
    return back(kept.join(again, "__key", "left_anti").unionByName(several))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with passages of the benchmark.

    Null and empty texts have none; repeated rows get equal results; without items
    every document stays.
    """
    own, back = carried(docs, "doc_id", "text")
    done = dc.decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return back(done.where(F.size("items") < MIN_ITEMS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: a row per row; a null text counts as empty."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"), vocabulary())
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]
#: Language models and BPE can't be stated in SQL; the tests use a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
