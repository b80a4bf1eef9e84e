"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media, mixing, pair_counts, piece_bpe, prefix_trie, repeated_spans, secrets_ledger, simhash, toxicity, urlfilter, warc, weighted_sampling
from .common import crc_bucket, read, word_count

#: The tokenizer that op8 applies: a file of the ``public_tokenizers`` package.
TOKENIZER = "piece_bpe_32k.model"
#: The byte-level tokenizer that op11 aligns with it.
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = crc_bucket("doc_id", 5) == 0
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(read(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predict_column(model, F.col("text"), spark).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(read(spark, sf_dir, "pages"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(read(spark, sf_dir, "documents"), piece_bpe.model_bytes(tokenizer_path()))


def secret_digest(found: DataFrame) -> DataFrame:
    spans = F.col("found")
    text = secrets_ledger.span_text(spans)
    counts = [secrets_ledger.kind_count(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits, parted by the id: the second scan meets the ledger of the first and skips the blobs that it has."""
    docs = read(spark, sf_dir, "documents")
    late = crc_bucket("doc_id", 2) == 1
    found, _ = secrets_ledger.scan_commits([docs.where(~late), docs.where(late)])
    return secret_digest(found)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path(BYTE_TOKENIZER), encoding="utf-8") as file:
        byte_level = file.read()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pair_counts.align_documents(docs, byte_level, piece_bpe.model_bytes(tokenizer_path())).select("doc_id", "aligned.*")
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests are made before the join, so that texts stay where they are."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.col("text")
    told = docs.select("doc_id", repeated_spans.text_key(text).alias("key"), word_count(text).alias("n_words"), F.sha2(repeated_spans.plain(text), 256).alias("whole"))
    gone = repeated_spans.removals(docs).select("key", "n_removed", F.sha2("kept", 256).alias("kept"))
    return told.join(gone, "key", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(read(spark, sf_dir, "conversations"))
    opening = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(9))
    rebuilt, convs = prefix_trie.with_shared_openings(turns, opening, F.col("conv") - F.col("conv") % 5)
    return prefix_trie.trie(prefix_trie.hashed(rebuilt), convs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_fingerprints, op4_media, op5_language, op6_url_filter, op7_warc, op8_pieces, op9_secrets, op10_simhash, op11_alignment, op12_repeats, op13_prefix_trie)}


URL_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^#]*)', 1) AS tail FROM parts),
n AS (SELECT *, nullif(host || tail, '') AS node FROM p),
raw AS (
  SELECT node AS src, host, path, url, regexp_extract(tail, '^[^?]*([?].*)$', 1) AS query, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*(?:["''][^"''>]*\bcanonical\b|canonical\b)[^>]*>'), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS t FROM n),
said AS (
  SELECT *, regexp_extract(t, '^([^?#]*)', 1) AS own, regexp_extract(t, '^[^?#]*(.*)$', 1) AS more, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS folder
  FROM (SELECT src, host, path, query, regexp_replace(t, '(?i)&(amp|#0*38|#x0*26);', '&', 'g') AS t FROM raw WHERE t <> '')),
whole AS (SELECT *, CASE WHEN own LIKE '/%' THEN own ELSE folder || own END AS joined FROM said),
plain AS (
  SELECT *, list_reduce(list_concat([''], string_split(substr(joined, 2), '/')), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END) AS kept FROM whole),
goal AS (
  SELECT src, CASE WHEN t LIKE '//%' THEN substr(t, 3) WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(t, instr(t, '://') + 3) WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR host = '' THEN ''
    WHEN own = '' THEN host || path || CASE WHEN more LIKE '?%' THEN more ELSE query END
    ELSE host || CASE WHEN kept = '' THEN '/' WHEN regexp_matches(joined, '/[.]{1,2}$') THEN kept || '/' ELSE kept END || more END AS t FROM plain),
edge AS (
  SELECT DISTINCT src, nullif(translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '^[^/?#]*([^#]*)', 1), '') AS dst FROM goal),
both_ways AS (SELECT src, dst FROM edge WHERE src <> dst UNION SELECT dst, src FROM edge WHERE src <> dst),
reach(a, b) AS (SELECT src, src FROM both_ways UNION SELECT r.a, e.dst FROM reach r JOIN both_ways e ON r.b = e.src),
rules(h, q, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
member AS (SELECT DISTINCT b AS node, regexp_extract(b, '^([^/?#]*)', 1) AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
ruled AS (
  SELECT m.node, arg_max(r.verdict, length(r.h || r.q)) AS verdict FROM member m JOIN rules r
  ON (m.host = r.h OR ends_with(m.host, '.' || r.h)) AND starts_with(m.path, r.q) GROUP BY m.node),
method AS (SELECT r.a AS node, min(u.verdict) AS verdict FROM reach r JOIN ruled u ON r.b = u.node GROUP BY r.a),
own AS (
  SELECT n.host, n.path, arg_max(r.h || r.q, length(r.h || r.q)) AS rule, arg_max(r.verdict, length(r.h || r.q)) AS verdict
  FROM (SELECT DISTINCT host, path FROM n) n JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.q) GROUP BY n.host, n.path)
SELECT n.page_id, n.host, n.path, o.rule, coalesce(o.verdict, m.verdict, 'allow') AS verdict
FROM n LEFT JOIN own o ON n.host = o.host AND n.path = o.path LEFT JOIN method m ON n.node = m.node
"""

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, sha256(coalesce(html, '')) AS k FROM pages),
m AS (SELECT k, max(page_id) AS newest FROM p GROUP BY k)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM p JOIN m USING (k)
"""


def _kind_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    q = lambda n: f"regexp_extract_all(text, '(?s)(.*?)(?:({pattern})|\\z)', {n})"
    return f"""
  SELECT doc_id, {order} AS o, '{kind}' AS kind, unnest(list_zip({q(1)}, {q(2)}, {q(2 + group)}, range(1, len({q(1)}) + 1))) AS z,
    list_transform({q(1)}, lambda x: length(x)) AS g, list_transform({q(2)}, lambda x: length(x)) AS h, {least} AS least FROM d"""


_LETTERS = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""}

SECRET_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_kind_sql("assign", 0, _LETTERS["assign"], 2, 8)} UNION ALL {_kind_sql("access", 1, "AKIA[A-Z0-9]+", 0, 16)} UNION ALL {_kind_sql("hex", 2, "[0-9a-f]+", 0, 32)}),
s AS (SELECT doc_id, o, kind, list_sum(g[1:CAST(z[4] AS BIGINT)]) + coalesce(list_sum(h[1:CAST(z[4] AS BIGINT) - 1]), 0) AS a, length(z[2]) AS n FROM m WHERE length(z[2]) > 0 AND length(z[3]) >= least),
f AS (SELECT doc_id, count_if(kind = 'assign') AS na, count_if(kind = 'access') AS nc, count_if(kind = 'hex') AS nh,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, o) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(na, 0) AS BIGINT) AS n_assign, CAST(coalesce(nc, 0) AS BIGINT) AS n_access, CAST(coalesce(nh, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f ON d.doc_id = f.doc_id
"""


REPEAT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, w, unnest(range(1, CAST(len(w) AS BIGINT) - 33)) AS p FROM d WHERE len(w) >= 35),
h AS (SELECT rid, p, md5_number(array_to_string(w[p:p + 34], ' ')) AS k FROM s),
m AS (SELECT rid, p FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS i FROM m),
u AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN g USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""


TRIE_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) - 1 AS pos,
  md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
o AS (SELECT c.c, 0 AS part, pos, k, bytes FROM c JOIN t ON t.c = c.base AND pos < h UNION ALL SELECT t.c, 1, pos, k, bytes FROM c JOIN t ON t.c = c.c AND pos >= h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, k, bytes FROM o),
p AS (SELECT c, d, bytes, string_agg(k, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM c),
n AS (SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY path),
e AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(path, d) AS path FROM p GROUP BY c) GROUP BY path),
u AS (SELECT path, left(path, length(path) - 32) AS parent FROM n WHERE depth > 0),
q AS (SELECT parent AS path, count(*) AS kids FROM u GROUP BY parent),
s AS (SELECT a.path, sum((b.n_convs - 1) * b.bytes) AS saved, count_if(q.kids IS NULL) AS leaves FROM n a JOIN n b ON left(b.path, 32 * a.depth) = a.path LEFT JOIN q ON q.path = b.path GROUP BY a.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN u ON u.path = n.path LEFT JOIN n m ON m.path = u.parent LEFT JOIN q ON q.path = n.path JOIN s ON s.path = n.path LEFT JOIN e ON e.path = n.path
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": URL_SQL, "op7_warc": WARC_SQL, "op9_secrets": SECRET_SQL, "op12_repeats": REPEAT_SQL, "op13_prefix_trie": TRIE_SQL}
