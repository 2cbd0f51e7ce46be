"""Added tokens of the vocabulary file that stand in documents."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldlight.llm import packing, queries, urls, warc
from fieldlight.llm.decontaminate import decontaminate
from tests.llm.test_llm_small import docs_of, texts

OWN = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n  y", "  <|endoftext|>  ", "<|endoftext| >", "<|endoftext|", *texts(20), None]


def test_packing_of_added_tokens(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)  # default setting
    want = {i: [*t.encode(text or "", add_special_tokens=False).ids, 0] for i, text in enumerate(OWN)}
    assert want[0] == [64, 220, 50256, 275, 0]
    pieces = defaultdict(list)
    for x in packing.pack(docs_of(spark, OWN).repartition(3), path, length=256, windows=4, special=True).collect():
        pieces[x.doc_id].append((x.start, x.ids))
    assert {i: [k for _, ids in sorted(p) for k in ids] for i, p in pieces.items()} == want

    docs_of(spark, OWN).write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id: x.doc_tokens for x in queries.op8_packing(spark, str(tmp_path)).collect()} == {i: len(ids) for i, ids in want.items()}


def test_long_runs_and_long_texts(monkeypatch):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    encode = packing.encoder(path, True)
    n = 2_000_000
    for text in ("a" + " " * n + "b", "\n" * n, "abcdefghij" * 300_000, "x <|endoftext|>" + " \t" * n + "<|endoftext|>y", "one two\n" * 400_000):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "LONG_RUN", 4)
    monkeypatch.setattr(packing, "_RUN", packing.re.compile(f"[{packing._WHITE}]{{3,}}"))
    monkeypatch.setattr(packing, "PART_CHARS", 5)
    dice = random.Random(3)
    bits = [" ", "\n", "\t", "\xa0", "　", "\x1c", "​", "a", "Bc", "é", "漢", "1", "!?", "'s", "<|endoftext|>"]
    for special in (True, False):
        t.encode_special_tokens = not special
        encode = packing.encoder.__wrapped__(path, special)
        for _ in range(4000):
            text = "".join(dice.choice(bits) * dice.choice((1, 1, 2, 5)) for _ in range(dice.randint(0, 14)))
            assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_unsupported_vocabularies_are_refused():
    good = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    assert packing._checked(good) == {}
    for bad in (good | {"normalizer": {"type": "NFC"}}, good | {"pre_tokenizer": {"type": "Whitespace"}}, good | {"added_tokens": [{"content": "x", "id": 3, "lstrip": True}]}, good | {"model": {**good["model"], "vocab": {"a": 0, "b": 2, "ab": 1, "ba": 0}, "merges": ["a b", "b a"]}}):
        with pytest.raises(ValueError, match="not|more"):
            packing._checked(bad)


OWN_NAMES = ("_id", "_id2", "_key", "_key2", "_text", "_doc", "_digest", "_digest2", "_n", "_c", "block", "window", "row", "n")


@pytest.mark.parametrize("block_bytes", [1 << 23, 100])
def test_op1_keeps_columns_with_its_own_names(spark, block_bytes):
    """With one block of windows and with many."""
    rows = [(1, "a b c d e"), (2, None), (3, "x y z a b c q"), (3, "x y z a b c q"), (None, "b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"mine {c}") for c in OWN_NAMES})
    bench = spark.createDataFrame([("i", "a b c d"), ("j", "z a b"), ("k", "b c d")], "item_id string, text string")
    found = decontaminate(docs, bench, ngram=3, block_bytes=block_bytes)
    assert found.columns[: len(docs.columns)] == docs.columns
    got = found.collect()
    assert all(r[c] == f"mine {c}" for r in got for c in OWN_NAMES)
    assert sorted((str(r.doc_id), r.n_hit, ",".join(r["items"])) for r in got) == [("1", 4, "i,k"), ("2", 0, ""), ("3", 4, "i,j"), ("3", 4, "i,j"), ("None", 3, "i,k")]


def test_op9_keeps_columns_with_its_own_names_and_states_its_ids(spark):
    pages = spark.createDataFrame([(2, "u", "x"), (1, "v", "x"), (3, "w", None), (4, None, "")], "page_id long, url string, html string").withColumns({c: F.lit(f"mine {c}") for c in OWN_NAMES})
    found = warc.with_originals(pages).collect()
    assert all(r[c] == f"mine {c}" for r in found for c in OWN_NAMES)
    assert {r.page_id: r.refers_to for r in found} == {1: None, 2: 1, 3: None, 4: 3}
    assert {r.page_id: r.refers_to for r in warc.read_bundles(warc.write_bundles(pages)).collect()} == {1: None, 2: 1, 3: None, 4: 3}
    with pytest.raises(TypeError):
        warc.write_bundles(pages.withColumn("page_id", F.col("page_id").cast("string")))


def test_op7_many_rules_in_one_directory(spark):
    """Tails are looked up, not walked: 200,000 rules in one directory; the trie and the join agree."""
    trie = urls.Trie([("block", "a.b", f"/d/{i:07d}") for i in range(200_000)] + [("allow", "b", "/d/00"), ("block", "a.b", "/"), ("allow", "a.b", "/d/0000007x/")])
    began = time.perf_counter()
    found = [trie.find("c.a.b", f"/d/{i:07d}/more") for i in range(0, 200_000, 20)]
    assert time.perf_counter() - began < 1 and all(f == ("block", f"a.b/d/{i:07d}") for i, f in zip(range(0, 200_000, 20), found, strict=True))
    assert trie.find("a.b", "/d/00z") == ("allow", "b/d/00") and trie.find("a.b", "/e") == ("block", "a.b/")
    rng = random.Random(4)
    rules = [(rng.choice(["allow", "block"]), rng.choice(["b", "a.b", "x.a.b"]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 5)))) for _ in range(300)]
    pages = [("http://" + rng.choice(["b", "a.b", "z.x.a.b"]) + "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 8))),) for _ in range(300)]
    p, r = spark.createDataFrame(pages, "url string"), spark.createDataFrame(rules, "action string, host string, path string")
    plain = lambda d: sorted(map(str, d.collect()))
    assert plain(urls.url_verdicts(p, r)) == plain(urls.url_verdicts(p, r, broadcast_chars=1))


def test_threads_keep_their_stored_tables(spark):
    """What one thread stores inside scratch() is gone after it, also after an exception; another thread's tables stay."""
    from concurrent.futures import ThreadPoolExecutor

    from fieldlight.llm import common

    def outer(fails):
        with common.scratch(spark):
            mine = common.stored(spark.range(5), "mine")
            kept = common.Tables(spark)
            first = kept.stored(spark.range(3), "first")
            with ThreadPoolExecutor(1) as other:
                theirs = other.submit(lambda: common.stored(spark.range(7), "theirs")).result()
            kept.clear()
            assert mine.count() == 5 and first is not None
            left.append((mine, theirs))
            if fails:
                raise RuntimeError("stopped")

    left, before = [], common.Tables(spark)
    with common.scratch(spark):
        outlives = before.stored(spark.range(4), "outlives")
    assert outlives.count() == 4
    outer(False)
    with pytest.raises(RuntimeError, match="stopped"):
        outer(True)
    for mine, theirs in left:
        assert theirs.count() == 7
        with pytest.raises(Exception, match="(?i)not exist|no such|not found"):
            mine.collect()
