"""Small fixtures for the training-data operators: brute force, round trips and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlight.llm import chat, decontaminate, packing, quality, secrets, simhash, urls, warc
from fieldlight.llm.components import components

DOCS = "doc_id long, text string, lang string, n_words string, spans int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(texts)], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(n, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 90))) for _ in range(n)]
    return [*out, None, "", " \n ", out[0], out[0], out[1] + " end", "w1 " * 5000]


@pytest.fixture(scope="module")
def tok():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def windows_brute(items, n=10):
    out = defaultdict(set)
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        for i in range(max(1, len(w) - n + 1)):
            if w and item is not None:
                out[tuple(w[i : i + n])].add(str(item))
    return out


def hits_brute(text, wins):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit, items = set(), set()
    for n in {len(k) for k in wins}:
        for i in range(len(w) - n + 1):
            if s := wins.get(tuple(w[i : i + n])):
                hit |= set(range(i, i + n))
                items |= s
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_decontaminate(spark, block_bytes):
    r = random.Random(3)
    own = texts(40)
    items = [(1, own[2]), (2, "Short ITEM"), (3, None), (4, "..."), (None, own[3]), (5, "a"), (6, own[2]), (7, "É x é " * 6)]
    own += [f"so, {own[2]} ; SHORT...item a", "a-b.c a", "É x é É x é é x É x É x", *[r.choice(own[:5]) + "!" for _ in range(5)]]
    wins = windows_brute(items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs_of(spark, own), bench, block_bytes=block_bytes).collect()
    assert len(out) == len(own)
    for row in out:
        assert (row.n_words, row.n_hit, row["items"]) == hits_brute(row.text, wins)
    empty = decontaminate.decontaminate(docs_of(spark, own).limit(0), bench.limit(0))
    assert empty.count() == 0
    assert {x.n_hit for x in decontaminate.decontaminate(docs_of(spark, own), bench.limit(0)).collect()} == {0}


def test_simhash_fingerprint_matches_definition():
    import xxhash

    for text in [t for t in texts(30) if t]:
        w = [x.encode() for x in words_of(text.translate(LOW))]
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"") == 0 == simhash.fingerprint(b" \n")


def brute_components(fps, limit=4):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize(("bits", "limit", "block"), [(64, 4, 4096), (64, 4, 16), (128, 12, 4096), (128, 12, 16)])
def test_near_links_join_the_same_groups(spark, bits, limit, block):
    r = random.Random(5)
    centres = [r.getrandbits(bits) for _ in range(30)]
    fps = {0, *centres}
    for k, c in enumerate(centres[:4]):
        for _ in range(150):
            x = c
            for b in r.sample(range(bits - 10 * k), r.randint(1, limit + 2)):  # the last ones lie close together
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [[(f >> at & (1 << 64) - 1) - ((f >> at & 1 << 63) << 1) for at in range(0, bits, 64)] for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp array<long>, node long")
    links = simhash.near_links(df, bits=bits, limit=limit, recall=1 - 1e-9, block=block)
    roots = {x.node: x.root for x in components(links, "a", "b").collect()}
    want = brute_components(fps, limit)
    assert {i: roots.get(i, i) for i in range(len(fps))} == dict(enumerate(want))


def test_coordinates_of_close_fingerprints():
    """What the keys and the discarding stand on: coordinates and steps of the pivot table."""
    r = np.random.default_rng(3)
    index = simhash.pivots(1000, 64, 4, 0.95)
    x = r.integers(0, 2**64, (200, 1), np.uint64)
    y = x ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (200, 4)).astype(np.uint64), axis=1)[:, None]
    tx, ty = index.table(x), index.table(y)
    assert np.abs(tx - ty).max() <= 4 and len(index.references) == 1 + 64 + simhash.SPREAD
    assert (((tx[:, 1:65] - tx[:, :1]) != (ty[:, 1:65] - ty[:, :1])).sum(axis=1) <= 4).all()
    assert (index.keys(tx) == index.keys(ty)).any(axis=1).all()
    assert simhash.limit_of(1.0, 256) == 0 and simhash.limit_of(0.8, 256) == 39


def test_near_duplicates_rows(spark):
    own = texts(50)
    out = simhash.near_duplicates(docs_of(spark, own)).collect()
    assert sorted(x.doc_id for x in out) == list(range(len(own)))
    fps = [simhash.fingerprint((t or "").encode()) for t in own]
    want = brute_components(fps)
    for x in out:
        assert x.fingerprint == f"{fps[x.doc_id]:016x}" and x.component_id == want[x.doc_id]
    assert simhash.near_duplicates(docs_of(spark, own).limit(0)).count() == 0
    ids = spark.createDataFrame([(None, "a b"), (None, "x y"), ("k", "a b"), ("c", "p q"), ("c", "q p")], "doc_id string, text string")
    out = Counter((x.doc_id, x.component_id) for x in simhash.near_duplicates(ids).collect())
    assert out == {(None, "k"): 1, (None, None): 1, ("k", "k"): 1, ("c", "c"): 2} and len(ids.columns) == 2


def test_chat_round_trip(spark, tok):
    odd = ["### x: </turn>\n", "\\", "\\\\### </turn> \\###", "", None, "####", " </turn>\n### user: hi", "é ", "a" * 70000]
    rows = []
    for c in range(60):
        for t in range(c % 5 + 1):
            role = ["user", "assistant", "sys:tem\\c", None][(t + c // 50) % 4]
            rows.append((c, t, role, odd[t % 3] if c % 2 else odd[(c * 7 + t) % len(odd)]))
    rows += [(3, 0, "user", "again"), (None, 0, "user", "no id"), (7, None, "assistant", "no turn")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    trees = chat.chat_trees(df, tok, part_tokens=50)
    got = {x.conv_id: x for x in chat.read_back(trees, tok, in_order=True).collect()}
    again = {x.conv_id: x for x in chat.read_back(trees.repartition(5), tok).collect()}
    assert got == again
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha(said), len(loss), sha(loss))
    size = Counter()
    for row in sorted(trees.collect(), key=lambda x: (x.tree, x.part)):
        assert row.begin == size[row.tree]
        size[row.tree] += len(row.ids)
        for node in row.nodes:
            assert row.begin <= node.begin < node.end <= size[row.tree]
            assert node.position == sum(a.end - a.begin for a in node.attends)
            assert (node.parent is None) == (node.node == 0) and all(a.end <= node.begin for a in node.attends)
    assert chat.read_back(chat.chat_trees(df.limit(0), tok), tok).count() == 0


def test_chat_emits_a_long_shared_turn_once(spark, tok):
    first = "long words " * 9000
    rows = [(c, t, ("user", "assistant")[t], (first, f"answer {c % 50}")[t]) for c in range(300) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees = chat.chat_trees(df.coalesce(1), tok, part_tokens=1000).withColumn("at", F.spark_partition_id()).collect()
    roots = [n for x in trees for n in x.nodes if n.parent is None]
    assert len(roots) == len({x.at for x in trees}) and len(trees) > len(roots)
    own = sum(len(x.ids) for x in trees) - sum(n.end - n.begin for n in roots)
    assert own < 60 * 60  # each of 50 answers once a partition that has it
    assert sum(len(x.members) for x in trees) == 300


def counts_brute(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    cover = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_list(spark):
    own = [*texts(40), "a\nb\na\n \n \na b", "x|y <é> & é b \x85"]
    good = [" ".join(f"word{i}{j}" for j in range(80)) for i in range(60)]
    junk = [" ".join(f"wo###{i}{j}" for j in range(80)) for i in range(60)]
    every = own + good + junk
    first = len(own)
    labels = [(first + i, int(i < 60)) for i in range(0, 120, 1) if i % 6 < 4] + [(None, 1), (0, None)]
    df = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {x.doc_id: x for x in quality.quality_rules(docs_of(spark, every), df).collect()}
    for i, t in enumerate(every):
        x = out[i]
        want = counts_brute(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    held = [i for i in range(120) if i % 6 >= 4]
    assert all(out[first + i].kept == (i < 60) for i in held)
    assert all(x.kept != x.base_failed for x in quality.quality_rules(docs_of(spark, every), df.limit(0)).collect())
    assert quality.quality_rules(docs_of(spark, []), df).count() == 0


def base_brute(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        out += [(m.start(), 0, "assign", m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_secrets(spark):
    key = "AKIA" + "ABCD1234EFGH5678"
    blob = "Zx9" * 14
    own = [
        None, "", f"é PassWord = 'abcdef' api-key: x APIKEY:\"aaaaaaa\" {key}", "token: abc token=abcdefg token = = abcdef",
        "0123456789abcdef01234567 " * 3, f"account_id: team-9 {blob}", blob, "account_id: team-9", f"https://a.example/x {blob}",
        f"https://a.example/x account_id=team-9 {blob}", "account_id: team-9" + " w" * 400 + f" {blob}", "ſecret: abcdefg", "AKIAAKIA" + "A" * 15,
    ]
    out = {x.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in x.spans] for x in secrets.secret_spans(docs_of(spark, own)).collect()}
    for i, t in enumerate(own):
        assert [s for s in out[i] if s.split(":")[0] in secrets.BASE] == base_brute(t or "")
    kinds = {i: {s.split(":")[0] for s in v} for i, v in out.items()}
    assert kinds[5] == {"ident", "blob"} and kinds[6] == set() == kinds[7] and kinds[8] == {"blob", "endpoint"} - {"endpoint"}
    assert kinds[9] == {"ident", "blob", "endpoint"} and kinds[10] == set()
    clean = {x.doc_id: x.text for x in secrets.redacted(docs_of(spark, own)).collect()}
    assert clean[0] is None and clean[6] == blob and key not in clean[2] and "[assign]" in clean[2]


def test_endpoints_are_those_of_a_pattern():
    plain = re.compile(rb"[a-z][a-z0-9+.-]*://[^\s\"'<>]+")
    dice = random.Random(4)
    for _ in range(5000):
        text = "".join(dice.choice(["a", "b", "1", "+", ".", "-", ":", "/", "://", " ", '"', "é", "A"]) for _ in range(dice.randint(0, 25))).encode()
        assert secrets.endpoints(text) == [m.span() for m in plain.finditer(text)]


@pytest.mark.parametrize("bit", ["a", "0123456789abcdef", "a.b-c+", "://", "x://", "token ", "AKIA", "client_id", "Ab1/", "secret=" + "'", "é", " "])
def test_secrets_of_long_texts(bit):
    """Five million characters of one kind: anything but linear time would not end."""
    text = (bit * (5_000_000 // len(bit)) + " x://y/z token=abcdefg").encode()
    spans = secrets.scan(text)
    assert [(s["kind"], s["end"]) for s in spans if s["kind"] == "assign"][-1] == ("assign", len(text.decode()))


def test_url_trie_and_join_agree(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "com", "/de/")]
    hosts, paths = ["example.org", "a.EXAMPLE.org", "xexample.org", "b.com", "com", "org", "", "a..org", "org."], ["", "/", "/es/", "/es", "/en/1", "/en/12/3", "/fr/x?y", "/de/#z", "?q=/es/"]
    own = [None, "", "no scheme", *(f"http://{h}{p}" for h in hosts for p in paths)]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*own, own[5]])], "page_id long, url string, rule string")
    r = spark.createDataFrame([*rules, rules[0], (None, "x", "/"), ("block", None, None)], "action string, host string, path string")
    a = urls.url_verdicts(df, r).orderBy("page_id").collect()
    b = urls.url_verdicts(df, r, broadcast_chars=0).select(a[0].__fields__).orderBy("page_id").collect()
    assert a == b
    for x in a:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", x.url or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fit = [(len(h + p), act, h + p) for act, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = (max(fit)[2], max(fit)[1]) if fit else (None, "allow")
        assert (x.host, x.path, x.rule, x.verdict) == (host, path, *want)
    assert urls.url_verdicts(df.limit(0), r.limit(0)).count() == 0


def test_packing(spark, tok):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok)
    t.encode_special_tokens = True
    own = [*texts(60), "don't  stop \n\n 123 ½ ٣ 日本語 🙂 <|endoftext|>", "x" * 3000]
    out = packing.pack(docs_of(spark, own).repartition(3), tok, length=256, windows=4).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in out:
        pieces[x.doc_id].append(x)
        sequences[x.sequence_id].append(x)
    for i, text in enumerate(own):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(pieces[i], key=lambda x: x.start)
        assert [k for x in mine for k in x.ids] == ids and all(x.doc_tokens == len(ids) for x in mine)
        assert [x.start for x in mine] == list(np.cumsum([0, *(x.length for x in mine)])[:-1])
    for s in sequences.values():
        s.sort(key=lambda x: x.offset)
        total = sum(x.length for x in s)
        assert [x.offset for x in s] == list(np.cumsum([0, *(x.length for x in s)])[:-1]) and total <= 256 and total & (total - 1) == 0
    crc = packing.with_crc(packing.pack(docs_of(spark, own), tok, length=256)).collect()
    ids = {(x.doc_id, x.start, x.length): x.ids for x in packing.pack(docs_of(spark, own), tok, length=256).collect()}
    assert all(zlib.crc32(np.array(ids[x.doc_id, x.start, x.length], "<u4").tobytes()) == x.ids_crc32 for x in crc)
    assert packing.pack(docs_of(spark, []), tok).count() == 0


def test_warc(spark):
    rows = [(5, "http://a/%0d\r\n", "same"), (3, None, "same"), (9, "u", None), (2, "u", ""), (None, "u", "same"), (2**60 + 1, "é", "é" * 300000), (7, "x", "WARC/1.1\r\n\r\n"), (3, "again", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    bundles = warc.write_bundles(df, frame_bytes=100, bundle_bytes=1000)
    out = warc.read_bundles(bundles).collect()
    assert Counter(x.page_id for x in out) == Counter(r[0] for r in rows)
    for x in out:
        html = {(i, h or "") for i, _, h in rows if i == x.page_id}
        payload = html.pop()[1].encode()
        same = [i for i, _, h in rows if (h or "").encode() == payload and i is not None]
        first = min(same) if x.page_id is not None else None
        assert (x.payload_bytes, x.payload_digest) == (len(payload), warc.digest(payload))
        assert (x.record_type, x.refers_to) == (("response", None) if x.page_id in (first, None) else ("revisit", first))
        if x.record_type == "response":
            assert bytes(x.payload) == payload
    assert {x.url for x in out} == {r[1] or "" for r in rows}
    for b in bundles.collect():
        content = bytes(b.content)
        assert b.records == len(warc.index_of(content))
        for name, _, _ in warc.index_of(content):
            assert f"<urn:page:{name}>".encode() in warc.seek(content, name).split(b"\r\n\r\n")[0]
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


def test_components_of_a_path(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(500, 501), (7, 7)], "a long, b long")
    roots = {x.node: x.root for x in components(edges, "a", "b").collect()}
    assert roots == {**{i: 0 for i in range(n)}, 500: 500, 501: 500}
    assert components(edges.select(F.col("a"), F.col("b")).limit(0), "a", "b").count() == 0
