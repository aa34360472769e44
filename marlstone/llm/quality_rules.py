"""Quality rules with thresholds that follow the corpus.

Each document gets counts: words, symbols, repeated lines, repeated words.  Four
rates are judged: symbols to characters, repeated lines to lines, repeated words
to words, characters to words.  What is usual is learned per language and source
from mergeable quantile sketches of the rates and of the sizes they refer to:
counts of integer buckets whose width is a fixed share of the value, so merging
is addition, the result doesn't depend on the order of the rows, and every
quantile is within that share (1/256) of the true one.  Sketches hold each
different text once and leave out texts that fail the base rules, so copies of a
text and plain junk don't say what is usual.  A source with few such texts uses
its language's sketch, a rare language that of all documents.

A rate's upper threshold is made of quantiles of the group alone:

    spread = the smaller distance of a quartile from the median
    unit   = one event (a symbol, a line, a window's words) in a text of median size
    reach  = max(FENCE * spread, EVENTS * unit)
    high   = the 0.9 quantile plus TAIL times its distance from the median,
             but at least median + reach and at most median + WIDEN * reach

Median and reach move only if half of a group does, and bound what its upper tail
can add, so junk can't lift its own threshold beyond; a source whose tail is usually
heavier gets more room than one whose tail isn't.  A document passes if its
events are within the threshold of its size plus EVENTS more, which is what
chance adds in short texts.  Characters to words have a lower threshold as well.
Thresholds are joined back to the counts.

Native: DataFrame functions only.

Defined results: a null or empty text has no words and fails the base rules;
null language and source form a group of their own; repeated rows get equal
results and change no threshold; on an empty table there are no rows; other
columns are ignored; texts are never cut, and a word of a long text costs a few
bytes beside the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WHITE_SPACE, materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: Rates are integers, so many to one.
SCALE = 10_000
#: Buckets keep so many leading bits: exact below 512, then 256 buckets to a doubling.
BUCKET_BITS = 9
#: Groups with fewer different texts use a coarser group's sketch.
MIN_GROUP = 100
#: See above.
FENCE, EVENTS, TAIL, WIDEN = 8, 4, 2, 2
#: Rate, what it counts, the size it refers to, what an event counts (a number of these, or
#: None: as much as a median document has to a unit of size), and whether small values fail, too.
RATES = (
    ("symbol_rate", "n_symbols", "word_chars", 1, False),
    ("dup_line_rate", "n_dup_lines", "n_lines", 1, False),
    ("repeat_rate", "n_repeat_words", "n_words", 6, False),
    ("word_length", "word_chars", "n_words", None, True),
)
SIZES = ("word_chars", "n_lines", "n_words")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``."""
    made = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    rest = [c for c in docs.columns if c != text_col and c.lower() not in made]
    split = docs.select(
        *(F.col(f"`{c}`") for c in rest),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"),
    ).select(
        *(F.col(f"`{c}`") for c in rest),
        "__text",
        F.filter(F.split("__text", WHITE_SPACE), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    # Windows are compared by a hash of their words, and those of equal hash by the words. Only a
    # text in which a hash repeats is looked at closer: equal hashes are neighbours after a sort.
    n = F.size("__words")
    word = lambda i: F.get("__words", i)
    window = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))
    places = F.sequence(F.lit(0), n - 3)
    hashed = split.select(
        *(F.col(f"`{c}`") for c in rest),
        "__words",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 4, F.transform(places, window)).alias("__hashes"),
    )
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    sorted_ = hashed.select("*", F.when(repeats, F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__windows"))
    same = lambda a, b: (a["h"] == b["h"]) & (word(a["i"]) == word(b["i"])) & (word(a["i"] + 1) == word(b["i"] + 1)) & (word(a["i"] + 2) == word(b["i"] + 2))
    pairs = F.zip_with("__windows", F.slice("__windows", 2, F.greatest(F.size("__windows") - 1, F.lit(0))), lambda a, b: F.when(same(a, b), F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))
    return sorted_.select(*(F.col(f"`{c}`") for c in (*rest, *made[:-1])), F.greatest(F.coalesce(F.size(covered), F.lit(0)), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket that holds ``value``."""
    shift = F.greatest(F.length(F.bin(value)) - BUCKET_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def quantiles(values: DataFrame, names: list[str]) -> DataFrame:
    """Per (lang, source), language and corpus (``level`` 0, 1, 2): ``total`` and, of
    every column named, quantiles from merged sketches as ``name_q25`` and so on."""
    long = values.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), bucket(F.col(name)).alias("b")) for k, name in enumerate(names)))).alias("x"))
    sketches = long.groupBy("lang", "source", F.col("x.k").alias("k"), F.col("x.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    levels = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), lang.alias("g_lang"), source.alias("g_source")) for level, lang, source in ((0, F.col("lang"), F.col("source")), (1, F.col("lang"), none), (2, none, none)))))
    merged = sketches.select(levels.alias("g"), "k", "b", "n").groupBy("g", "k", "b").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("g", "k")
    at = merged.withColumn("upto", F.sum("n").over(up.orderBy("b"))).withColumn("total", F.sum("n").over(up))
    least = lambda k, q: F.min(F.when((F.col("k") == k) & (100 * F.col("upto") >= q * F.col("total")), F.col("b")))
    return at.groupBy("g").agg(F.max("total").alias("total"), *(least(k, q).alias(f"{name}_q{q}") for k, name in enumerate(names) for q in (25, 50, 75, 90))).select("g.*", "total", *(f"{name}_q{q}" for name in names for q in (25, 50, 75, 90)))


def thresholds(rates: DataFrame) -> DataFrame:
    """Thresholds per (lang, source); ``rates`` has counts, rates and ``hash`` of the text."""
    names = list(dict.fromkeys([name for name, *_ in RATES] + list(SIZES)))
    usual = rates.where(~base_failed()).select("lang", "source", "hash", *names).distinct()
    found = quantiles(usual, names)
    made = []
    for name, _, size, event, two in RATES:
        q = lambda p, c=name: F.col(f"{c}_q{p}")
        slack = F.lit(EVENTS * event * SCALE) if event else EVENTS * q(50)
        unit = F.floor(slack / F.greatest(q(50, size), F.lit(1)))
        reach = F.greatest(FENCE * F.least(q(75) - q(50), q(50) - q(25)), unit)
        high = F.greatest(q(50) + reach, F.least(q(90) + TAIL * (q(90) - q(50)), q(50) + WIDEN * reach))
        made += [high.cast("long").alias(f"high_{name}"), slack.cast("long").alias(f"slack_{name}")]
        if two:
            made.append((q(50) - reach).cast("long").alias(f"low_{name}"))
    fences = found.select("level", "g_lang", "g_source", F.struct("total", *made).alias("f"))
    level = lambda k: fences.where(F.col("level") == k).select(F.col("g_lang").alias(f"lang{k}"), F.col("g_source").alias(f"source{k}"), F.col("f").alias(f"f{k}"))
    # Every group of the table, also those in which all fail the base rules.
    groups = rates.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).distinct()
    own = groups.join(level(0), F.col("t_lang").eqNullSafe(F.col("lang0")) & F.col("t_source").eqNullSafe(F.col("source0")), "left")
    both = own.join(level(1).drop("source1"), F.col("t_lang").eqNullSafe(F.col("lang1")), "left")
    enough = lambda k: F.col(f"f{k}.total") >= MIN_GROUP
    whole = level(2).select("f2").scalar()
    return both.select("t_lang", "t_source", F.when(enough(0), F.col("f0")).when(enough(1), F.col("f1")).otherwise(whole).alias("f")).select("t_lang", "t_source", "f.*")


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and rates of every document, written once: both the sketches and the filter read them."""
    present = {c.lower() for c in docs.columns}
    extra = [F.col(f"`{c}`").cast("string").alias(c) if c in present else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    text = F.col(f"`{text_col}`").cast("string")
    counts = text_counts(docs.select(F.col(f"`{id_col}`"), text.alias("text"), F.xxhash64(text).alias("hash"), *extra))
    # A rate of word_length keeps hundredths, the others ten-thousandths.
    rate = lambda n, size, event: F.expr(f"{SCALE if event else 100}L * {n} DIV greatest({size}, 1L)").cast("long")
    return materialise(counts.select("*", *(rate(n, size, event).alias(name) for name, n, size, event, _ in RATES)), "quality-rates")


def thresholds_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``t_lang``, ``t_source``, ``total`` and the thresholds of each group of ``docs``."""
    return thresholds(rated(docs, id_col, text_col))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, counts, rates, thresholds, ``base_failed`` and ``kept``.

    Sketch rows are summed before they are shuffled, so a hot source costs a few
    rows a task; the join is left to Spark, which broadcasts the thresholds only
    if they are measured to be small and splits a hot source otherwise.
    """
    rates = rated(docs, id_col, text_col)
    fences = materialise(thresholds(rates).drop("total"), "quality-thresholds")
    joined = rates.join(fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_lang", "t_source", "hash")
    passes = F.lit(True)
    for name, n, size, event, two in RATES:
        scale = SCALE if event else 100
        passes &= scale * F.col(n) <= F.col(f"high_{name}") * F.col(size) + F.col(f"slack_{name}")
        if two:
            passes &= scale * F.col(n) >= F.col(f"low_{name}") * F.col(size) - F.col(f"slack_{name}")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(passes, F.lit(True)))
