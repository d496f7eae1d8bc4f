from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import lakewarden.llm.merkle as m
from lakewarden.llm import queries
from lakewarden.llm.merkle import FIELDS, fold, merkle_manifest, proof_digest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Levels, built by threes."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out += [x for k, x in enumerate(level[first : first + 3], first) if k != i]
        i //= 3
    return out


def plain(rows):
    """Per row (doc_id, leaf, subroot, root, digest of the siblings), by building all trees in memory."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf(row)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x for _, x in sorted(groups[s], key=lambda p: (p[0] is not None, p[0] or 0, p[1]))]) for s in order}
    over = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, own) in enumerate(sorted(groups[s], key=lambda p: (p[0] is not None, p[0] or 0, p[1]))):
            out.append((doc_id, own, trees[s][-1][0], over[-1][0], h(*path(trees[s], i), *path(over, k))))
    return sorted(out, key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(7) for c in ("grp", "item", "leaf", "rid")})
    got = merkle_manifest(docs, **options).select("*", proof_digest(F.col("proof")).alias("d")).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.d) for r in got), key=str) == plain(rows)
    for r in got:
        assert fold(r.leaf, r.proof) == r.root
    return got


def some_rows(n, seed, sources=("a", "b", "é", "Z", "", None)):
    rng = random.Random(seed)
    return [(rng.choice([i, i // 2, None]), rng.choice(sources), "en", rng.choice([None, i]), rng.choice([None, "", f"t{i}\nx", "日本\n"])) for i in range(n)]


@pytest.mark.parametrize("levels,first,rise", [(8, 6, 9), (0, 1, 1), (1, 1, 2)])
def test_equals_trees_in_memory(spark, monkeypatch, levels, first, rise):
    for name, value in (("CHUNK_LEVELS", levels), ("FIRST_RISE", first), ("RISE", rise), ("OUT_ROWS", 7)):
        monkeypatch.setattr(m, name, value)
    assert all(r.verified for r in check(spark, some_rows(700, levels)))


@pytest.mark.parametrize("n", [1, 4, 28])
def test_one_group(spark, n):
    check(spark, [(i, "s", "en", i, f"t{i}") for i in range(n)])


def test_groups_of_one_row_and_equal_rows(spark):
    check(spark, [(i, f"s{i}", "en", i, "t") for i in range(50)])
    check(spark, [(1, "s", "en", 1, "t")] * 40 + [(2, None, None, None, None)] * 5)


def test_changed_rows_do_not_verify(spark):
    rows = [(i, "s" if i % 3 else None, "en", i, f"a\nb{i}" if i % 5 else None) for i in range(60)]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    for r in check(spark, rows, presented={"text": tampered}):
        changed = r.doc_id % 5 and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        assert r.verified == (not changed) and (r.folded_root == r.root) == r.verified


def test_sql_on_awkward_rows(spark, tmp_path):
    rows = [(d, s, g, n, t) for d, s, g, n, t in some_rows(200, 5)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = queries.op11_merkle(spark, str(tmp_path)).toPandas(), con.execute(queries.OP11_SQL).fetchdf()
    rows = [sorted(map(str, f[sorted(f)].fillna({"doc_id": -1}).astype({"doc_id": int}).values.tolist())) for f in (got, want)]
    assert rows[0] == rows[1]
    assert 0 < (~got["verified"]).sum() < len(got)


def test_awkward(awkward, nothing):
    got = merkle_manifest(awkward, fields=FIELDS).collect()
    assert len(got) == awkward.count() and all(r.verified for r in got) and len({r.root for r in got}) == 1
    assert merkle_manifest(nothing).count() == 0


def test_long_texts(documents):
    got = merkle_manifest(documents([(1, "x" * 3_000_000, "s"), (2, "日本" * 500_000, "s"), (3, "short", "t")])).collect()
    assert len(got) == 3 and all(r.verified for r in got)
