"""Each registered query beside its SQL, or beside brute force over the whole table, at the smallest size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from fieldlight.llm import decontaminate, quality, queries, secrets, simhash, urls
from tests.llm.test_llm_small import base_brute, brute_components, counts_brute, docs_of
from tests.llm.test_llm_pipeline import kept_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def plain(rows, columns):
    return sorted(tuple(str(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    want = con.execute(queries.oracle_sql()[name]).to_arrow_table().to_pylist()
    got = queries.queries()[name](spark, SF)
    assert set(got.columns) >= set(want[0]) and plain([r.asDict() for r in got.collect()], want[0]) == plain(want, want[0])


def test_op2(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()}
    ids = sorted(texts)
    fps = [simhash.fingerprint((texts[i] or "").encode()) for i in ids]
    assert got == {i: (f"{f:016x}", ids[root]) for i, f, root in zip(ids, fps, brute_components(fps), strict=True)}


def test_op5(spark, texts):
    rules = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for r in queries.op5_quality(spark, SF).collect():
        n = counts_brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert (r.base_failed, r.kept) == (n[0] < 50 or 100 * n[4] > 50 * n[0], kept_brute(rules, texts[r.doc_id]))


def spans_brute(text):
    """All spans by patterns and pairwise distances of every two parts."""
    own = {k: [(m.start(), m.end()) for m in re.finditer(p, text, re.A | f) if ok(m)] for k, p, f, ok in (
        ("ident", r"""(?:access|client|account|tenant)[_-]?(?:key[_-]?)?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}""", re.I, lambda m: True),
        ("blob", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}", 0, lambda m: all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))),
        ("endpoint", r"""[a-z][a-z0-9+.-]*://[^ \t-\r"'<>]+""", 0, lambda m: True),
    )}
    base = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base_brute(text))]
    near = lambda a, many: any(s <= a[1] + 300 and e >= a[0] - 300 for s, e in many)
    ids = [*own["ident"], *((s, e) for k, s, e in base if k == "access")]
    keys = [*own["blob"], *((s, e) for k, s, e in base if k in ("assign", "hex"))]
    out = [*base, *(("ident", *x) for x in own["ident"] if near(x, keys)), *(("blob", *x) for x in own["blob"] if near(x, ids) or near(x, own["endpoint"]))]
    out += [("endpoint", *x) for x in own["endpoint"] if near(x, ids) and near(x, keys)]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2])))


def test_op6(spark):
    """On the next size, as the smallest one has no secret."""
    sf, found = SF.replace("0.001", "0.01"), 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_secrets(spark, sf).collect():
        text = texts[r.doc_id] or ""
        base = base_brute(text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and r.spans == spans_brute(text)
        found += len(base)
    assert found


def test_op8(spark, texts):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op8_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        ends = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == ends
            ends += r.length
        assert ends <= 1024 and ends & (ends - 1) == 0


def test_very_long_texts(spark):
    """Texts of several megabytes, beyond every batch size, through the operators that read texts row by row."""
    r = random.Random(1)
    words = [f"w{r.randrange(10**5)}" for _ in range(800_000)]
    item = words[500_000:500_012]
    own = [" ".join(words), "x" * 5_000_000, "a b\n" * 1_000_000, " ".join(words)]
    docs = docs_of(spark, own)
    bench = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    hit = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontaminate.decontaminate(docs, bench).collect()}
    assert hit == {0: (800_000, 12, ["i"]), 1: (1, 0, []), 2: (2_000_000, 0, []), 3: (800_000, 12, ["i"])}
    near = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()}
    assert near == {0: 0, 1: 1, 2: 2, 3: 0}
    counts = {x.doc_id: (x.n_words, x.n_dup_lines, x.n_repeat_words) for x in quality.with_counts(docs).collect()}
    assert counts[1] == (1, 0, 0) and counts[2] == (2_000_000, 999_999, 2_000_000) and counts[0][0] == 800_000
    pages = spark.createDataFrame([(1, "http://a.org/" + "p/" * 2_000_000), (2, "http://" + "a." * 2_000_000 + "org/x")], "page_id long, url string")
    rules = spark.createDataFrame([("block", "org", "/p/p/")], "action string, host string, path string")
    assert {x.page_id: x.verdict for x in urls.url_verdicts(pages, rules).collect()} == {1: "block", 2: "allow"}
