"""Phrase counts, scores and ranks against dictionaries of all n-grams."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldlight.llm import collocations as c


def brute(rows, longest, least, top, scale=1000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {(lang, w[i:j]) for (lang, w), a in kept.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and a >= kept[lang, w[i:j]]}
    ranked = defaultdict(list)
    for (lang, w), a in kept.items():
        if (lang, w) not in inside:
            score, k = min((scale * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            ranked[lang].append((-score, -a, " ".join(w).encode(), k, f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, k, l, r, n[lang], -s) for lang, rs in ranked.items() for i, (s, a, p, k, l, r) in enumerate(sorted(rs)[:top], 1))


def rows():
    rng, out = random.Random(3), []
    words = ["A", "b", "c", "É", "dd", "x\x00y", "Z z"]
    for i in range(300):
        text = " ".join(rng.choice(words) + (rng.choice([",", ",", "\n", "\t", " .", "!?"]) if rng.random() < 0.1 else "") for _ in range(rng.randint(0, 60)))
        out.append((text if i % 17 else None, rng.choice(["en", "de", None, "und"])))
        if i % 5 == 0:
            out.append(out[-1])
    return [*out, ("no stop " * 4000, "en"), ("", "fr"), (" \t.,", "fr")]


@pytest.mark.parametrize(("longest", "least", "top", "shard", "buckets"), [(5, 5, 2000, c.SHARD_WORDS, None), (5, 4, 30, 200, 512), (2, 4, 2000, 200, 1024), (8, 20, 2000, 1000, 512)])
def test_equals_brute_force(spark, longest, least, top, shard, buckets):
    docs = spark.createDataFrame(rows(), "text string, lang string").selectExpr("*", "1 AS phrase", "2 AS shard", "3 AS words")
    found = c.collocations(docs, longest=longest, min_count=least, top=top, shard_words=shard, buckets=buckets).collect()
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.cut, r.l, r.r, r.n, r.score) for r in found)
    assert got == brute(rows(), longest, least, top)


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_scores_pass_64_bits(spark):
    a, n = 9 * 10**15, 8 * 10**18
    row = spark.range(1).selectExpr(f"{a}L AS a", f"{n}L AS n", f"{10**16 + 1}L AS l", f"{10**16 - 1}L AS r")
    got = row.select(c.floor_ratio([1000, "a", "n"], ["l", "r"]).alias("s")).head().s
    assert got == 1000 * a * n // ((10**16 + 1) * (10**16 - 1))


def test_intervals_stay_together(monkeypatch):
    """Growing at either end gives the same counts, and both indexes hold intervals of the same phrase."""
    rng = np.random.default_rng(5)
    text = np.r_[0, rng.integers(0, 6, 500), 0].astype(np.int32)
    index = c.BiIndex(*[c.restored(c.squeezed(c.transform(t))) for t in (text, text[::-1])], 6)
    where = lambda p: sum(tuple(text[i : i + len(p)]) == tuple(p) for i in range(len(text)))
    monkeypatch.setattr(c, "SLICE", 100)
    phrases, at = index.words()
    for left in (False, True, True, False):
        phrases, at = index.grown(phrases, at, left, lambda p: np.ones(len(p), bool))
        assert [where(p) for p in phrases] == at[:, 2].tolist()
        assert len({tuple(p) for p in phrases}) == len(phrases)


@pytest.mark.parametrize("most", [c.HELD_PHRASES, 64])
def test_a_task_reports_a_phrase_once(spark, most):
    """Many shards of a language in one task: its phrases come with their sums, not once a shard; also where few are held."""
    docs = spark.createDataFrame([("a b c d. " * 60, "en"), ("a b c e. " * 60, "de")] * 20, "text string, lang string").coalesce(1)
    shards = docs.mapInArrow(c._shards("text", "lang", 300), c.SHARD_DDL).localCheckpoint()
    every = np.packbits(np.ones(512, bool)).tobytes()
    found = shards.select("lang", "words", "forward", "reverse").mapInArrow(c._counted(3, {2: every}, most), c.FOUND_DDL).collect()
    total = Counter()
    for r in found:
        total[r.lang, r.phrase] += r.n
    assert shards.count() > 20 and len(found) == 10
    assert total == {(lang, w): 1200 for lang, x in (("en", "d"), ("de", "e")) for w in ("a b", "b c", f"c {x}", "a b c", f"b c {x}")}
