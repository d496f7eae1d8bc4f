from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from lakewarden.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    return sorted(((i, max((g for g in groups[t or ""] if g is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows), key=repr)


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_equals_brute_force(spark, documents, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(25)]
    rows = [(i, rng.choice([*texts, None]), "s") for i in range(120)]
    got = exact_dedup(documents(rows), block).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_awkward_rows(awkward):
    from .conftest import AWKWARD

    got = exact_dedup(awkward, 16).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(AWKWARD)
    assert sum(r.kept for r in got) == len({t or "" for _, t, _ in AWKWARD})


def test_kept_rows_have_all_columns(awkward):
    from .conftest import AWKWARD

    out = drop_exact_copies(awkward)
    assert out.columns == awkward.columns
    assert out.count() == len({t or "" for _, t, _ in AWKWARD})


def test_empty_table(nothing):
    assert exact_dedup(nothing).count() == 0 and drop_exact_copies(nothing).count() == 0
