"""Near copies against brute force, and the pipeline's stage on copies that one fingerprint does not link."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlight.llm import common, near_copies
from tests.llm.test_llm_small import docs_of, words_of


def sets_of(own, width=5):
    words = [words_of((t or "").lower()) for t in own]
    return [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups_brute(own, least=0.8):
    sets, up = sets_of(own), list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if up[i] != up[j] and jaccard(sets[i], sets[j]) >= least:
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    return up


def varied(seed=3):
    """Bases of 20 to 400 words, each with copies that have more and more words changed, and chains of copies of copies."""
    r = random.Random(seed)
    out = []
    for n in (20, 60, 100, 250, 400):
        for _ in range(4):
            base = [f"w{r.randrange(3000)}" for _ in range(n)]
            out.append(" ".join(base))
            for k in range(6):
                copy = list(base)
                for at in r.sample(range(n), max(1, n * k // 100)):
                    copy[at] = f"x{r.randrange(10**6)}"
                out.append(" ".join(copy))
                if k % 2:
                    base = copy
    return out


@pytest.mark.parametrize("block", [4096, 20])
def test_groups_equal_brute_force(spark, block):
    own = [*varied(), None, "", " \n ", "one two", "ONE  two", "one two three"]
    r = random.Random(1)
    passage = [f"p{i}" for i in range(70)]  # two texts with one passage are not copies
    own += [" ".join([*passage, *(f"q{r.randrange(10**6)}" for _ in range(30))]) for _ in range(40)]
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs_of(spark, own), recall=0.9999, bits=512, block=block).collect()}
    want = groups_brute(own)
    assert 20 < len(set(want)) < len(own) - 20
    assert [got[i] for i in range(len(own))] == want
    assert near_copies.near_copies(docs_of(spark, own).limit(0)).count() == 0


def test_recall_at_the_least_similarity(spark):
    """Pairs of a similarity of 0.8 to 0.85, of which the operator in its own setting links nine tenths or more."""
    r = random.Random(2)
    own = []
    while len(own) < 800:
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        copy = list(base)
        for at in r.sample(range(200), 4):
            copy[at] = f"x{r.randrange(10**6)}"
        a, b = (near_copies.shingle_set(" ".join(t).encode(), 5) for t in (base, copy))
        if 0.8 <= near_copies.similarity(a, b) < 0.85:
            own += [" ".join(base), " ".join(copy)]
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs_of(spark, own)).collect()}
    linked = sum(got[i + 1] == i for i in range(0, 800, 2))
    print("linked", linked, "of 400")
    assert linked >= 360 and all(got[i] in (i, i - i % 2) for i in got)


def test_stage_drops_copies_with_one_word_changed(spark):
    r = random.Random(9)
    own = []
    for _ in range(30):
        base = [f"w{r.randrange(10**6)}" for _ in range(100)]
        copy = list(base)
        copy[50] = "changed"
        own += [" ".join(base), " ".join(copy)]
    docs = docs_of(spark, own)
    kept = corpus_pipeline.dedup(spark, docs, "").select(F.col("doc_id")).collect()
    assert sorted(x.doc_id for x in kept) == list(range(0, len(own), 2))


def test_fingerprints_that_find_next_to_nothing_leave_no_link_out(spark):
    """With keys that find one pair in twenty, groups are those of all pairs: the exact join finds the others."""
    own = [*varied(5), None, "", "one two"]
    for k in range(30):  # texts that share most of a passage that very many have, and so no rare shingle
        own.append(" ".join([*(f"p{i}" for i in range(60)), *(f"q{k}x{i}" for i in range(2 + k % 3))]))
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs_of(spark, own), recall=0.05).collect()}
    assert [got[i] for i in range(len(own))] == groups_brute(own)


def test_prefixes_of_similar_sets_meet():
    """Any order, sets of exactly the least similarity and empty ones."""
    import numpy as np

    r = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 10, 45, 90):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            gone = int(len(a) * 0.2)  # n - gone of n: a similarity of 0.8 at least
            b = np.sort(r.permutation(a)[: len(a) - gone])
            often = np.sort(r.permutation(a)[: n // 2])
            frequent = often, r.integers(3, 90, len(often))
            assert np.intersect1d(near_copies.prefix(a, 0.8, frequent), near_copies.prefix(b, 0.8, frequent)).size
    assert not len(near_copies.prefix(np.empty(0, np.uint64), 0.8, (np.empty(0, np.uint64), np.empty(0, np.int64))))


def test_disk_holds_only_what_the_result_reads(spark):
    """Tables of the steps go with the steps: what is left is three tables without texts."""
    with common.scratch(spark):
        got = near_copies.near_copies(docs_of(spark, varied()[:60]))
        there = Path(common._folder(spark, "x").removeprefix("file://")).parent
        assert sorted(p.name.split("-")[0] for p in there.iterdir() if p.is_dir()) == ["marked", "nodes", "roots"]
        assert got.count() == 60


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    def files():
        return set(Path(spark.sparkContext.getConf().get("spark.local.dir", "/tmp")).glob("blockmgr-*/*/shuffle_*.data"))

    rows = spark.range(1000).repartition("id")
    start = files()
    with common.shuffles_removed(spark):
        rows.write.parquet(f"{tmp_path}/inside")
    assert not files() - start
    rows.write.parquet(f"{tmp_path}/outside")
    assert files() - start and spark.read.parquet(f"{tmp_path}/outside").count() == 1000


def test_pairs_are_verified_in_rounds_of_about_as_many_as_sets(spark, monkeypatch):
    own = [" ".join([*(f"p{k // 4}x{i}" for i in range(64)), *(f"q{k}x{i}" for i in range(10))]) for k in range(40)]  # six pairs of 0.75 to four texts
    counts, was = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: counts.append(pairs.count()) or was(pairs, *rest))
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs_of(spark, own), recall=0.05).collect()}
    assert sum(counts) > len(own) > max(counts), counts
    assert [got[i] for i in range(len(own))] == groups_brute(own)


def test_sketches_rule_out_no_similar_pair():
    """Any sizes, folded sketches and sets without one; unlike sets are ruled out."""
    import numpy as np

    r = np.random.default_rng(5)
    for n in (0, 1, 95, 96, 127, 128, 129, 500, 513, 3000):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            gone, new = int(r.integers(0, n // 5 + 1)), int(r.integers(0, n // 8 + 1))
            b = np.unique(np.r_[r.permutation(a)[: len(a) - gone], r.integers(0, 2**63, new).astype(np.uint64)])
            near = near_copies.similarity(a, b)
            told = near_copies.may_be_similar(len(a), near_copies.sketch(a), len(b), near_copies.sketch(b), near)
            assert told and near_copies.may_be_similar(len(b), near_copies.sketch(b), len(a), near_copies.sketch(a), near)
    a, b = (np.unique(r.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2))
    assert not near_copies.may_be_similar(300, near_copies.sketch(a), 300, near_copies.sketch(b), 0.8)


def test_texts_of_pairs_that_sketches_rule_out_do_not_travel(spark, monkeypatch):
    """Candidates of a similarity of 0.66 that share rare shingles: all of them were verified on their texts."""
    own = [" ".join([*(f"p{k // 4}x{i}" for i in range(240)), *(f"q{k}x{i}" for i in range(60))]) for k in range(40)]
    own += [" ".join([*own[-1].split(), "one", "more"])]
    counts, was = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: counts.append(pairs.count()) or was(pairs, *rest))
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs_of(spark, own), recall=0.05).collect()}
    assert [got[i] for i in range(len(own))] == groups_brute(own) and got[40] == 39
    assert 1 <= sum(counts) < 10, counts
