"""Quality rules with host verdicts, in DataFrame functions only.

Each text gets its counts within its own row. Windows of five words are sorted
by hash within their document, where equal windows become neighbours, so no
window leaves its row. Failures of the base rules are summed
by host; a beta prior fitted to the hosts' rates by moments (the between-host
variance less the sampling variance) shrinks each rate, and a host fails whose
shrunk rate passes ``host_limit``. The verdict is joined back to the documents.

Defined results: null text has no words and fails the base rules; the null host
is a host of its own; with one host, or no variance between hosts, every rate
is the global one; repeated rows count each; a very long text is measured within its
row, in arrays of its words and windows; an empty table gives an empty
result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, Scratch, whole

WINDOW, LEAST_WORDS, REPEAT_PERCENT, HOST_LIMIT = 5, 10, 20, 0.5
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_GAPS = " \t\n\x0b\f\r"


def _window(i: Column) -> Column:
    return F.array(*(F.get("words", i + k) for k in range(WINDOW)))


def _starts(base: DataFrame) -> DataFrame:
    """Add ``starts``: in order, the places in ``words`` of the windows found twice or more.

    A window's hash, its low bits replaced by the window's place, sorts as a
    plain long; windows with equal high bits become neighbours. Only those are
    compared word by word. Should two different windows meet there, the row
    is sorted again by the words themselves.
    """
    at = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    base = base.withColumn("low", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("words") + F.lit(2)))).cast("long") - 1)
    high = F.bitwise_not(F.col("low"))
    packed = F.transform(at, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))).bitwiseAND(high).bitwiseOR(i.cast("long")))
    base = base.withColumn("packed", F.array_sort(packed))

    def near(x: Column, k: Column) -> Column:
        def same(y: Column) -> Column:
            return F.coalesce(x.bitwiseXOR(y).bitwiseAND(high) == 0, F.lit(False))

        return same(F.get("packed", k - 1)) | same(F.get("packed", k + 1))

    base = base.withColumn("met", F.filter("packed", near)).drop("packed")
    place = F.transform("met", lambda x: x.bitwiseAND(F.col("low")).cast("int"))
    base = base.withColumn("met_at", place)
    mixed = F.exists(
        F.sequence(F.lit(1), F.size("met") - 1),
        lambda k: (F.get("met", k).bitwiseXOR(F.get("met", k - 1)).bitwiseAND(high) == 0) & (_window(F.get("met_at", k)) != _window(F.get("met_at", k - 1))),
    )
    base = base.withColumn("mixed", F.when(F.size("met") > 1, mixed).otherwise(F.lit(False)))
    by_words = F.array_sort(F.transform("met_at", lambda i: F.struct(_window(i).alias("w"), i.alias("i"))))
    base = base.withColumn("sorted", F.when(F.col("mixed"), by_words))

    def again(x: Column, k: Column) -> Column:
        return F.coalesce(F.get("sorted", k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get("sorted", k + 1)["w"] == x["w"], F.lit(False))

    exact = F.transform(F.filter("sorted", again), lambda x: x["i"])
    return base.withColumn("starts", F.array_sort(F.when(F.col("mixed"), exact).otherwise(F.col("met_at")))).drop("low", "met", "met_at", "mixed", "sorted")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    text = whole("text")
    words = F.filter(F.split("t", WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, _GAPS, "")) > 0)
    base = docs.select("doc_id", "source", text.alias("t"))
    base = base.withColumn("words", words).withColumn("lines", lines)
    base = base.select(
        "doc_id",
        "source",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", _GAPS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    base = _starts(base).drop("words")
    covered = F.aggregate(
        F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b
    )
    return base.withColumn("n_repeat_words", covered.cast("long")).drop("starts")


def host_rates(failed: DataFrame) -> DataFrame:
    """source, documents, failures, rate (shrunk by the fitted beta prior) of ``failed`` (source, base_failed)."""
    per = failed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    # Moments of the hosts' rates: m and the between-host variance give the prior's weight a + b = m (1 - m) / v - 1.
    sums = per.agg(
        F.sum("failures").alias("f"), F.sum("documents").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("failures") * F.col("failures") / F.col("documents")).alias("ff"), F.sum(F.col("documents").cast("double") * F.col("documents")).alias("nn"),
    )
    f, n, k, ff, nn = (float(x or 0) for x in sums.first())
    mean = f / n if n else 0.0
    within = mean * (1 - mean)
    # sum n_i (p_i - m)^2 = ff - f m; its expectation is (k - 1) within + (n - nn / n) v, v the variance between hosts.
    spread = (ff - f * mean - (k - 1) * within) / (n - nn / n) if k > 1 else 0.0
    if spread <= 0:
        return per.withColumn("rate", F.lit(mean))
    weight = max(within / spread - 1, 1.0)
    return per.withColumn("rate", (F.col("failures") + mean * weight) / (F.col("documents") + weight))


def quality_rules(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Per document: doc_id, n_words, the four counts, base_failed, kept, host_rate."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    found = scratch.keep(measures(docs).withColumn("base_failed", failed))
    hosts = scratch.keep(host_rates(found).select(F.col("source").alias("host"), F.col("rate").alias("host_rate")))
    return found.join(hosts, found["source"].eqNullSafe(hosts["host"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= host_limit)).alias("kept"), "host_rate"
    )
