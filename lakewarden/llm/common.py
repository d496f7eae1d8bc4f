"""Shared plumbing of the corpus operators: scratch tables, row keys, Arrow batches, words."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D, as a Java character class.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
_GAP = re.compile(rb"[\x20\x09-\x0d]")
#: Characters (or bytes) of a very long text that are cut into words at once.
PORTION = 1 << 20
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session, whose driver and executors are one
    process, gets a temporary folder of its own; a cluster session must name
    one, as a local folder would not be shared.
    """
    given = spark.conf.get("spark.checkpoint.dir", "") or ""
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lakewarden-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: The scratch tables made since each open scope.
_scopes: list[list[Scratch]] = []


@contextmanager
def scratch_scope() -> Iterator[list[Scratch]]:
    """Collect the scratch tables made inside."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


class Stages:
    """Turns operators into stages, each called on the written result of the one before.

    So when a stage is called nothing reads the scratch tables of the stage before any more, and they are deleted.
    """

    def __init__(self) -> None:
        self.left: list[Scratch] = []

    def __call__(self, stage: Callable) -> Callable:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            self.clear(spark)
            with scratch_scope() as made:
                self.left = made
                return stage(spark, docs, sf_dir)

        return run

    def clear(self, spark: SparkSession) -> None:
        for scratch in self.left:
            if scratch.spark is spark:
                scratch.clear()
        self.left = []


class Scratch:
    """Intermediate tables in the shared folder; they cut lineage and survive lost executors.

    A table is deleted by ``drop``, by ``Stages`` or, as a result may still read it, when the
    application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        if _scopes:
            _scopes[-1].append(self)

    def _at(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the table that was written; the shuffles that made it are freed."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(_FREE_SHUFFLES)
        self.spark.conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            path, fs = self._at(table._scratch_path)
            fs.delete(path, True)

    def clear(self) -> None:
        """Delete all tables."""
        path, fs = self._at(self.root)
        fs.delete(path, True)


def keyed(docs: DataFrame, **derived: Column) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names), ``rid`` (a number of its own) and ``derived``.

    ``rid`` is fixed once the table is written.
    """
    return docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("rid"), *(c.alias(n) for n, c in derived.items()))


def unkeyed(rows: DataFrame) -> DataFrame:
    """The columns that ``keyed`` put in ``row``."""
    return rows.select("row.*")


def placed(values: DataFrame, scratch: Scratch, *by: Column) -> DataFrame:
    """``values`` with ``place``, from 0 in the order of ``by``.

    Sorted by ranges of the order and numbered within each; what goes to the
    driver is a count per range.
    """
    part = F.shiftright("place", 33)
    sorted_ = scratch.keep(values.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    begin, total = [(-1, 0)], 0
    for p, n in sorted((r["p"], r["n"]) for r in sorted_.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        begin.append((p, total))
        total += n
    starts = values.sparkSession.createDataFrame(begin, "part bigint, begin bigint")
    # One row per range is broadcast.
    return sorted_.join(F.broadcast(starts), part == F.col("part")).withColumn("place", F.col("begin") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "begin")


#: Keys of more than a ten-thousandth of all rows are hubs, so there are 10,000 at most; a hub's rows are dealt to so many tasks.
HUBS, SALTS = 10_000, 64


def hub_join(rows: DataFrame, per: DataFrame, by: list[str], spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per``, a written table of unique keys ``by`` and the number ``n`` of rows of each.

    Hubs are broadcast to mark their rows, which are then dealt out by ``spread``, a
    column of ``rows``; so no key has all its rows in one task, and ``rows`` are read once.
    """
    total = per.agg(F.sum("n")).first()[0] or 0
    hub = F.col("n") > F.lit(max(total // HUBS, 1000))
    hubs = per.filter(hub).select(*by, F.lit(True).alias("__hub"))
    if hubs.isEmpty():
        return rows.join(per.drop("n").hint("merge"), by, how)
    salts = F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    per = per.withColumn("__salt", F.explode(salts)).drop("n").hint("merge")
    salt = F.when(F.col("__hub"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    marked = rows.join(F.broadcast(hubs), by, "left").withColumn("__salt", salt).drop("__hub")
    return marked.join(per, [*by, "__salt"], how).drop("__salt")


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch (Spark bounds its bytes), so that a Python worker holds few texts at a time.

    The setting stays, as the plans returned run later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole(text: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def word_blocks(text: bytes, size: int = PORTION) -> Iterator[list[bytes]]:
    """The words of a text in order, those of about ``size`` bytes at a time."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
