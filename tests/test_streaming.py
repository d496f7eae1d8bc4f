from __future__ import annotations

import pytest

from lakewarden.model import Rule, RuleSkipped
from lakewarden.streaming import violations

from .helpers import leaf


def test_row_local_rules_on_a_stream(spark, tmp_path):
    rows = [(1, "2024-02-30", "x"), (2, "2024-02-01", ""), (3, "2024", "y")]
    spark.createDataFrame(rows, "id long, d string, t string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, d string, t string").parquet(str(tmp_path / "in"))
    rules = [Rule("DATE", leaf("d", "invalid_date")), Rule("TEXT", {"any": [leaf("t", "empty"), leaf("t", "equal_to", "y", value_is_literal=True)]})]
    query = violations(stream, rules, "XX", ["id"]).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("found").collect()) == [("DATE", 1), ("TEXT", 2), ("TEXT", 3)]
    with pytest.raises(RuleSkipped, match="more than the row"):
        violations(stream, [Rule("U", leaf("t", "is_unique_set", ["id"]))], "XX", ["id"])


def test_state_over_many_batches(spark, tmp_path):
    """The same as in one batch, however the rows are dealt to batches; a late row is left out of the order."""
    from lakewarden.streaming.stateful import duplicates, without_next

    rows = [("a", 1, "x", "2024-01-01 00:00:01"), ("b", 2, "y", "2024-01-01 00:00:02"), ("a", 3, "z", "2024-01-01 00:00:03"), ("a", 4, "z", "2024-01-01 00:00:04"), ("b", 5, "y", "2024-01-01 00:00:05"), ("c", 6, "q", "2024-01-01 00:00:09")]
    schema = "g string, id long, v string, at timestamp"
    for i, r in enumerate([*rows, ("a", 7, "w", "2024-01-01 00:00:02")]):
        frame = spark.createDataFrame([r], "g string, id long, v string, at string").selectExpr("g", "id", "v", "CAST(at AS timestamp) AS at")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name, make):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = tmp_path / name
        make(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(out)).collect())

    assert run("dup", lambda s: duplicates(s, ["g", "v"], ["id"])) == [2, 3, 4, 5]
    assert run("next", lambda s: without_next(s, "v", "v", "g", "at", ["id"], late="0 seconds")) == [1]


def test_duplicates_of_many_keys_share_states(spark, tmp_path):
    """Calls of Python are bounded by the states, not by the keys; rows come back as they were, nulls and long numbers too."""
    from lakewarden.streaming.stateful import duplicates

    schema = "g string, x double, id bigint, d decimal(20,3), at timestamp"
    rows = spark.range(20_000).selectExpr("concat('g', id) AS g", "1.5D AS x", "id", "CAST(id AS decimal(20,3)) AS d", "timestamp_micros(id) AS at")
    odd = [("g7", 1.5, 9007199254740993, None, None), (None, -0.0, None, None, None), (None, 0.0, 5, None, None), ("é\"\n", float("nan"), 6, None, None), ("é\"\n", float("nan"), 6, None, None), ("", None, 8, None, None)]
    rows.repartition(2).union(spark.createDataFrame(odd, schema)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    found = duplicates(stream, ["g", "x"], ["id", "d", "at", "g"], states=16)
    assert found.schema.simpleString() == "struct<g:string,x:double,id:bigint,d:decimal(20,3),at:timestamp>"
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 16
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("g", "CAST(x AS string) AS x", "id", "CAST(d AS string) AS d", "unix_micros(at) AS at")
    want = [("g7", "1.5", 7, "7.000", 7), ("g7", "1.5", 9007199254740993, None, None), (None, "0.0", None, None, None), (None, "0.0", 5, None, None), ("é\"\n", "NaN", 6, None, None), ("é\"\n", "NaN", 6, None, None)]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_duplicates_forget_keys_by_their_own_last_row(spark, tmp_path):
    """Keys that share a state are forgotten one by one."""
    from lakewarden.streaming.stateful import duplicates

    rows = [("a", 1, 0), ("b", 2, 50), ("c", 3, 100), ("b", 4, 101), ("a", 5, 102), ("d", 6, 300), ("e", 9, 301), ("b", 7, 302), ("d", 8, 303)]
    for g, i, s in rows:
        spark.sql(f"SELECT '{g}' AS g, {i}L AS id, timestamp_seconds({s}) AS at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = duplicates(stream, ["g"], ["id"], time="at", late="1 second", horizon_ms=60_000, states=1)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4, 6, 8]
