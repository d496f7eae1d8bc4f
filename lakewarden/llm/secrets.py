"""Secrets in texts, and by how many owners each is held, in DataFrame functions only.

Fixed patterns give the base spans. Beside them stand candidates that a pattern
alone cannot judge: assigned values too short for the base rule, and long mixed
tokens outside of base spans. Every value, base or candidate, goes as its SHA-256
into one count over the whole corpus: the repositories and the owners that hold
it. A value that several owners hold is a copied example; one that a single owner
holds looks live, and such a candidate becomes a span of kind ``owned``. Base
spans stay whatever the count, and carry it.

Places come without a Python worker: a text split by a pattern gives what lies
between the matches, so a match starts after the lengths of all pieces and
matches before it, a running sum over the matches of one text. Only texts with a
match are split, and only matches are shuffled, never texts. A value that very
many rows hold is counted in three steps (repository, owner, value), each summed
before its shuffle, and its rows meet the count in many tasks (``hub_join``).

Defined results: null text counts as empty; texts without a match get no spans
and the digest of the empty text; the null owner and the null repository count as
one each; spans of different kinds may overlap; repeated rows are repeated and
are one repository; a very long text is scanned within its row, its matches in
one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, hub_join, whole


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Kinds in the order of the report, and what they match (fixed values). For hex and access a failing match hides no
#: other one, so the least length stands in the pattern; an assignment's length is tested afterwards, as it may.
KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
PATTERNS = {
    "assign": rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
LEAST_ASSIGNED = 12
#: Candidates: shorter assigned values with a letter and a digit, and tokens with letters of both cases and two digits.
LEAST_CANDIDATE, TOKEN, DISTINCT = 8, r"[A-Za-z0-9+/_=-]{20,}", 10
#: A value that more owners hold is an example.
MAX_OWNERS = 1
KINDS = (*PATTERNS, "owned")


_MATCH = "array<struct<kind:string,k:int,gap:int,length:int,value:string>>"


def _matches(kind: str, pattern: str) -> Column:
    """The matches of a kind: kind, number, characters since the match before, characters, value."""
    found = F.col(f"m_{kind}")
    value = F.col("v_assign") if kind == "assign" else found
    gaps = F.transform(F.split("text", pattern, -1), lambda x: F.char_length(x))
    zipped = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    rows = F.transform(zipped, lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), x["gap"].alias("gap"), F.char_length(x["m"]).alias("length"), x["v"].alias("value")))
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast(_MATCH))


def find(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """rid, doc_id, owner, repository, found (the matches of all kinds; null if there are none)."""
    patterns = PATTERNS | {"token": TOKEN}
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(owner).alias("owner"), F.col(repository).alias("repository"), whole("text").alias("text"))
    rows = rows.withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    rows = rows.withColumn("v_assign", F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(PATTERNS["assign"]), F.lit(2))))
    some = F.size("m_assign") + F.size("m_access") + F.size("m_hex") + F.size("m_token") > 0
    return rows.select("rid", "doc_id", "owner", "repository", F.when(some, F.concat(*(_matches(k, p) for k, p in patterns.items()))).alias("found"))


def spans_of(found: DataFrame) -> DataFrame:
    """Base spans and candidates: rid, owner, repository, kind, at (place of the kind), base, start, end, value."""
    order = W.partitionBy("rid", "kind").orderBy("k")
    rows = found.select("rid", "owner", "repository", F.explode("found").alias("f")).select("rid", "owner", "repository", "f.*")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(order)).withColumn("start", F.col("end") - F.col("length"))
    long = F.char_length("value")
    base = F.col("kind").isin("access", "hex") | ((F.col("kind") == "assign") & (long >= LEAST_ASSIGNED))
    short = (F.col("kind") == "assign") & long.between(LEAST_CANDIDATE, LEAST_ASSIGNED - 1) & F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]")
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9].*[0-9]")
    token = (F.col("kind") == "token") & mixed & (F.size(F.array_distinct(F.split("value", ""))) >= DISTINCT)
    rows = rows.withColumn("base", base).filter(F.col("base") | short | token)
    # A candidate that touches a base span of its text is none: those that start up to its start, and those after.
    along = W.partitionBy("rid").orderBy("start", F.desc("base"))
    before = F.max(F.when(F.col("base"), F.col("end"))).over(along.rowsBetween(W.unboundedPreceding, 0)) > F.col("start")
    after = F.min(F.when(F.col("base"), F.col("start"))).over(along.rowsBetween(0, W.unboundedFollowing)) < F.col("end")
    rows = rows.withColumn("touches", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).filter(F.col("base") | ~F.col("touches"))
    kind = F.when(F.col("base"), F.col("kind")).otherwise(KINDS[-1])
    at = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    return rows.select("rid", "owner", "repository", kind.alias("kind"), at.alias("at"), "base", "start", "end", F.sha2("value", 256).alias("value"))


def ownership(spans: DataFrame) -> DataFrame:
    """value, n (spans), repositories, owners: how widely each value is held."""
    per = spans.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return per.groupBy("value").agg(F.sum("n").alias("n"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_owned, n_live and found.

    ``found`` are the spans (start, at, kind, end, base, owners, repositories, live) in the
    order of the report; ``n_live`` counts those whose value at most ``max_owners`` owners hold.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    texts = scratch.keep(find(docs, owner, repository))
    spans = scratch.keep(spans_of(texts))
    held = hub_join(spans, scratch.keep(ownership(spans)), ["value"], "rid").withColumn("live", F.col("owners") <= max_owners)
    one = F.struct("start", "at", "kind", "end", "base", "owners", "repositories", "live")
    counts = {f"n_{k}": F.count_if(F.col("kind") == k) for k in KINDS} | {"n_live": F.count_if("live")}
    # What is gathered are the spans of one text.
    per = held.filter(F.col("base") | F.col("live")).groupBy("rid").agg(*(c.alias(n) for n, c in counts.items()), F.array_sort(F.collect_list(one)).alias("found"))
    none = F.array().cast(per.schema["found"].dataType)
    return texts.select("rid", "doc_id").join(per, "rid", "left").select("doc_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in counts), F.coalesce("found", none).alias("found"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
