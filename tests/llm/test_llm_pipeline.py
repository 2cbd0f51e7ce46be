"""The pipeline, stage by stage, against brute force on the smallest tables and on odd rows."""

from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlight.llm import quality, secrets
from fieldlight.llm.common import table
from fieldlight.llm.queries import tokenizer_path
from tests.llm.test_llm_near_copies import groups_brute
from tests.llm.test_llm_small import counts_brute, hits_brute, windows_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def kept_brute(rules, text):
    n = dict(zip(quality.COUNTS, quality.text_counts((text or "").encode()), strict=True))
    base = counts_brute(text)
    if base[0] < 50 or 100 * base[4] > 50 * base[0]:
        return False
    value = {
        "words": n["n_words"], "word_length": n["word_chars"] / max(n["n_words"], 1), "symbol_share": n["n_symbols"] / max(n["word_chars"], 1), "dup_line_share": n["n_dup_lines"] / max(n["n_lines"], 1),
        "repeat_share": n["n_repeat_words"] / max(n["n_words"], 1), "upper_share": n["n_upper"] / max(n["word_chars"], 1), "digit_share": n["n_digits"] / max(n["word_chars"], 1),
        "mark_share": n["n_marks"] / max(n["n_words"], 1), "distinct_share": n["n_distinct"] / max(n["n_words"], 1), "line_words": n["n_words"] / max(n["n_lines"], 1),
    }
    return not any(all((value[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)


@pytest.fixture(scope="module")
def docs(spark):
    d = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None), (None, d.head().text), (10**6, None), (10**6 + 1, ""), (10**6 + 2, d.head().text), (10**6 + 2, d.head().text)], "doc_id long, text string")
    extra = {"lang": F.lit(None).cast("string"), "source": F.lit("x"), "n_chars": F.length("text").cast("long")}
    return d.unionByName(odd.withColumns(extra)).withColumns({"n_words": F.lit("mine"), "kept": F.lit(7), "spans": F.lit(1), "fp": F.lit("f"), "n_hit": F.lit(-1)}).cache()


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    now = docs
    rules = quality.fit(docs.select("doc_id", "text"), table(spark, SF, "labels"))
    got = stages["quality"](spark, now, SF).cache()
    want = [r for r in now.collect() if kept_brute(rules, r.text)]
    assert got.columns == columns and sorted(map(str, got.collect())) == sorted(map(str, want))

    now, rows = got, got.collect()
    got = stages["dedup"](spark, now, SF).cache()
    groups = defaultdict(list)
    for r, root in zip(rows, groups_brute([r.text for r in rows]), strict=True):
        groups[root].append(r)
    want = [min((r for r in g if r.doc_id is not None), key=lambda r: r.doc_id) if any(r.doc_id is not None for r in g) else g[0] for g in groups.values()]
    assert got.columns == columns and sorted(map(str, got.collect())) == sorted(map(str, want))

    now, rows = got, got.collect()
    got = stages["decontamination"](spark, now, SF).cache()
    wins = windows_brute([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    want = [r for r in rows if not hits_brute(r.text, wins)[1]]
    assert got.columns == columns and sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) < len(rows)

    now, rows = got, {r.doc_id: r for r in got.collect()}
    got = stages["secrets"](spark, now, SF).cache()
    assert got.columns == columns and got.count() == len(rows)
    for r in got.collect():
        spans = secrets.scan(rows[r.doc_id].text.encode())
        assert (r.text != rows[r.doc_id].text) == bool(spans) and r.n_chars == len(r.text) and r.n_words == "mine"
        for s in spans:
            assert rows[r.doc_id].text[s["start"] : s["end"]] not in r.text or f"[{s['kind']}]" in r.text

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    pieces = defaultdict(int)
    for p in stages["packing"](spark, got, SF).collect():
        pieces[p.doc_id] += p.length
    assert pieces == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in got.collect()}


def test_stages_on_no_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run_equals_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = lambda d: d.groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id").collect()
    ran = corpus_pipeline.run(spark, SF)
    assert set(key) <= set(ran.columns) and total(ran) == total(docs)
