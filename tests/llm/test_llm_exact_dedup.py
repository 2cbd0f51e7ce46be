"""Exact duplicates against a dictionary of texts."""

import hashlib
import random
from collections import defaultdict

import pytest

from fieldlight.llm.exact_dedup import BLOCK, exact_duplicates
from pyspark.sql import functions as F

random.seed(11)
LONG = "".join(random.choice("abcdefgh ") for _ in range(3_000_000))
ROWS = [
    (1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, None), (5, "A"), (16, "x" * (BLOCK - 1)),
    *[(20 + i, "x" * (BLOCK * n)) for i, n in enumerate((1, 1, 2, 3, 3, 4))], (30, "x" * (2 * BLOCK + 1)),
    (41, "é" * 5000), (42, "é" * 5000), (51, LONG), (52, LONG), (53, LONG[:-1] + "z"), (54, "z" + LONG[1:]), *[(100 + i, "same") for i in range(50)],
]


def brute(rows, keep, fold=lambda t: t):
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[fold(t or "")].append((i is not None, i or 0, at))
    out = []
    for t, members in groups.items():
        best = max(members) if keep == "largest" else min(members)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(str(rows[m[2]][0]), str(best[1] if best[0] else None), len(members), sha) for m in members]
    return sorted(out), len(groups)


@pytest.mark.parametrize(("keep", "bits"), [("largest", 64), ("smallest", 64), ("largest", 2)])
def test_equals_brute_force(spark, keep, bits):
    """With two bits of hash many blocks share a key and are looked up by their bytes."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("row", "key", "name", "at", "id")})
    found = exact_duplicates(docs, keep=keep, key_bits=bits).collect()
    want, groups = brute(ROWS, keep)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_normalise_and_other_ids(spark):
    rows = [(f"n{i}", t) for i, t in enumerate(("A b", "a b", "a  b", None, ""))]
    found = exact_duplicates(spark.createDataFrame(rows, "name string, body string"), "name", "body", normalise=lambda t: F.lower(t)).collect()
    assert sorted((r.name, r.keep_id, r.group_size, r.kept) for r in found) == [("n0", "n1", 2, False), ("n1", "n1", 2, True), ("n2", "n2", 1, True), ("n3", "n4", 2, False), ("n4", "n4", 2, True)]


def test_empty_and_native(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(none).collect() == []
    with pytest.raises(ValueError):
        exact_duplicates(none, keep="first")
