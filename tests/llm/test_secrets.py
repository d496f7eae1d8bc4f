from __future__ import annotations

import random
import re
from collections import defaultdict

from lakewarden.llm.secrets import KINDS, listed, secrets

BASE = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def plain(docs):
    """A scan text by text, then a count by owner: what ``secrets`` must give for (owner, text) rows."""
    spans, held = [], defaultdict(set)
    for i, (owner, text) in enumerate(docs):
        mine, more = [], []
        for kind, pattern in BASE:
            for m in pattern.finditer(text):
                value = m.group(2) if kind == "assign" else m.group()
                if len(value) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                    mine.append((m.start(), KINDS.index(kind) + 1, kind, m.end(), value))
                elif kind == "assign" and len(value) >= 8 and re.search("[A-Za-z]", value) and re.search("[0-9]", value):
                    more.append((m.start(), len(KINDS), "owned", m.end(), value))
        for m in MIXED.finditer(text):
            v = m.group()
            if all(re.search(p, v) for p in ("[a-z]", "[A-Z]", "[0-9].*[0-9]")) and len(set(v)) >= 10:
                more.append((m.start(), len(KINDS), "owned", m.end(), v))
        more = [x for x in more if not any(x[0] < b[3] and b[0] < x[3] for b in mine)]
        for x in mine + more:
            held[x[4]].add(owner)
        spans.append(sorted(mine + more))
    return [[x for x in s if x[2] != "owned" or len(held[x[4]]) == 1] for s in spans]


def shown(spans):
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z, _ in spans)


def test_equals_a_plain_scan(spark, documents):
    rng = random.Random(4)
    bits = ["token", "Password", "api_key", "APIKEY", "secret", ":", "=", " = ", "'", '"', "abcdefghijkl", "abc12345", "0123456789abcdef", "AKIA", "AKIA" + "Z9" * 8, "Ab3dEf7hIj1kLmNoPqRs", "Zz9" * 9 + "qwertyuiop", " ", "\n", "é", "日本", "\U0001f600", "==", "Tk9" + "aBcDeFgHiJkLmNoPqRsTu"]
    docs = [(rng.choice(["a", "b", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))) for _ in range(400)]
    docs += [("a", "token: password: abcdefghijklmnop"), ("a", "token=secret=abcdefghijklmnop"), ("b", "TOKEN = \"9233A8ECF7C5B09FE594\""), ("b", "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop")]
    got = {r.doc_id: r for r in secrets(documents([(i, t, o) for i, (o, t) in enumerate(docs)])).withColumn("spans", listed("found")).collect()}
    for i, want in enumerate(plain(docs)):
        assert got[i].spans == shown(want), docs[i]
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[2] == k for x in want) for k in KINDS]


def test_query_equals_sql_on_every_kind(spark, tmp_path):
    import duckdb

    from lakewarden.llm import queries

    rng = random.Random(5)
    bits = ["token", "PASSWD", "api_key", ":", "=", " = ", "'", "abcdefghijkl", "abc12345", "0123456789abcdef", "AKIA" + "Z9" * 8, "Ab3dEf7hIj1kLmNoPqRs", "Kk7" * 9 + "qwertyuiop", " ", "é", "\U0001f600"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) if i % 40 else None, "en", rng.choice(["a", "b", "c", None]), 1) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = queries.op13_secrets(spark, str(tmp_path)).toPandas(), con.execute(queries.OP13_SQL).fetchdf()
    assert sorted(map(tuple, got[sorted(got)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))
    assert got["spans"].str.contains("owned").sum() > 20 and (got["n_access"] > 0).sum() > 20


def test_copied_examples_are_told_from_credentials_of_one_owner(documents):
    example, own = "Ex4mpl3KeyThatAllCopyAround", "Pr1v4teKeyOfASingleOwnerXyz"
    rows = [(i, f"set it to {example} please", f"o{i % 7}") for i in range(60)] + [(100 + i, f"we use {own} here", "o1") for i in range(5)] + [(200, "token = 'abcdefgh1234' and then", "o2"), (201, "token = 'abcdefgh1234' and then", "o3")]
    got = {r.doc_id: r for r in secrets(documents(rows)).collect()}
    assert all(not got[i].found for i in range(60))
    for i in range(100, 105):
        (span,) = got[i].found
        assert (span.kind, span.owners, span.repositories, span.live, got[i].n_owned, got[i].n_live) == ("owned", 1, 5, True, 1, 1)
    for i in (200, 201):  # a base span stays, though two owners hold its value
        (span,) = got[i].found
        assert (span.kind, span.owners, span.live, got[i].n_live) == ("assign", 2, False, 0)
    assert {r.n_owned for r in secrets(documents(rows), max_owners=7).collect()} == {0, 1}


def test_hot_values_are_dealt_out(documents, monkeypatch):
    import lakewarden.llm.common as common

    monkeypatch.setattr(common, "HUBS", 1)
    rows = [(i, f"token='{'a1' * 10}' 0123456789abcdef{i:04x}", "s") for i in range(50)]
    want = secrets(documents(rows)).orderBy("doc_id").collect()
    monkeypatch.setattr(common, "HUBS", 10_000)
    assert secrets(documents(rows)).orderBy("doc_id").collect() == want


def test_awkward(awkward, nothing):
    got = secrets(awkward).collect()
    assert len(got) == awkward.count() and not any(r.found for r in got)
    assert secrets(nothing).count() == 0


def test_long_texts(documents):
    text = " ".join(f"w{i} token={'k' * 12}{i}" for i in range(20_000)) + " " + "f" * 400_000
    r = secrets(documents([(1, text, "s"), (2, "short", "s")])).filter("doc_id = 1").first()
    assert (r.n_assign, r.n_hex) == (20_000, 1) and r.found[-1].end == len(text)


def test_query_runs_without_python_workers(spark, documents):
    plan = secrets(documents([(1, "token=abcdefghijkl", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
