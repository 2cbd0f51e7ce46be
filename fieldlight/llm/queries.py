"""The registered queries of the thirteen operators: thin digests of their results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_trees, read_back
from .collocations import collocations
from .common import stored, table
from .decontaminate import decontaminate
from .exact_dedup import exact_duplicates
from .hard_negatives import hard_negatives
from .packing import pack, with_crc
from .quality import quality_rules
from .secrets import BASE, secret_spans, spans_text
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .urls import url_verdicts
from .warc import read_bundles, write_bundles

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), ngram=10)
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, limit=4)


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    path = tokenizer_path()
    return read_back(chat_trees(rows.unionByName(own), path), path, in_order=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = {k: (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE}
    return found.select(
        "doc_id", *count.values(), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    )


#: Fixed rules of the query: action, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), length=1024, special=True)
    return with_crc(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = stored(write_bundles(table(spark, sf_dir, "pages").select("page_id", "url", "html")), "warc")
    return read_bundles(bundles, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents"), longest=5, min_count=100, top=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS1 = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS1} AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i+9], ' ') AS win FROM bi),
d AS (SELECT doc_id, {_WORDS1} AS w FROM documents),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS win FROM di),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM h),
n AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


#: Runs of repeated windows of {n} units; units: h with so many, wide characters or list entries each.
_RUNS = """
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS m FROM k),
r AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {n} THEN 0 ELSE 1 END AS new FROM f WHERE m < doc_id),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
u AS (SELECT doc_id, min(p) AS a, max(p) + {n} AS b FROM g GROUP BY doc_id, run),
v AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM u)"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS p FROM d),
k AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM w),{_RUNS.format(n=50)},
x AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS z,
  string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM v JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) - 12))) AS p FROM d),
k AS (SELECT doc_id, p, array_to_string(h[p + 1:p + 13], ' ') AS s FROM w),{_RUNS.format(n=13)},
x AS (SELECT doc_id, sum(b - a) AS n_removed, max(b) AS z, flatten(list(h[z + 1:a] ORDER BY a)) AS kept FROM v JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_concat(coalesce(kept, []), h[coalesce(z, 0) + 1:]), ' ')) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)
"""

OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length('### ') + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\c'))
  + length(': ') + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + length(' </turn>_') AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP7_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (SELECT page_id, r.host || r.path AS rule, r.verdict FROM q JOIN r ON (q.host = r.host OR q.host LIKE '%.' || r.host) AND starts_with(q.path, r.path)),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN b USING (page_id)
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, unhex(sha1(body)) AS d FROM p),
x AS (SELECT page_id, payload_bytes, d, min(page_id) OVER (PARTITION BY d) AS first FROM h),
b AS (SELECT page_id, payload_bytes, first, list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || substr(bits, 5 * i + 1, 5)) AS INTEGER), 1) FOR i IN range(32)], lambda a, c: a || c) AS payload_digest
  FROM (SELECT *, CAST(CAST(d AS BIT) AS VARCHAR) AS bits FROM x))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""

OP11_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
k AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM k GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT lang, k, unnest([array_to_string(s[:-2], ' '), array_to_string(s[2:], ' ')]) AS phrase, a FROM (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k > 2)),
m AS (SELECT lang, phrase, max(a) AS wider FROM x GROUP BY lang, phrase),
c AS (SELECT f.*, string_split(phrase, ' ') AS s FROM f LEFT JOIN m USING (lang, phrase) WHERE k > 1 AND (wider IS NULL OR wider < a)),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
j AS (SELECT u.lang, u.phrase, u.a, u.cut, h.a AS l, e.a AS r, n, CAST(1000::HUGEINT * u.a * n // (h.a::HUGEINT * e.a) AS BIGINT) AS score
  FROM u JOIN f h ON h.lang = u.lang AND h.phrase = array_to_string(u.s[:u.cut], ' ') JOIN f e ON e.lang = u.lang AND e.phrase = array_to_string(u.s[u.cut + 1:], ' ') JOIN t ON t.lang = u.lang),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""

OP13_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
"""


def queries() -> dict[str, Query]:
    named = [
        op1_decontaminate, op2_simhash, op3_suffix_array, op4_chat, op5_quality, op6_secrets, op7_urls, op8_packing, op9_warc, op10_substring,
        op11_exact_dedup, op12_collocations, op13_hard_negatives,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_suffix_array": OP3_SQL, "op4_chat": OP4_SQL, "op7_urls": OP7_SQL, "op9_warc": OP9_SQL, "op10_substring": OP10_SQL,
            "op11_exact_dedup": OP11_SQL, "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
