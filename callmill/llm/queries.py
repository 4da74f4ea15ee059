"""The queries of this package, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, line_dedup, media, minhash, mixing, negatives, pii, quality, spelling, toxicity, url_filter, warc
from .common import read

#: A key for tests; callers bring their own.
PII_KEY = b"callmill test key"
#: The rules that the URL query judges by.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def _remainder(doc_id: Column, divisor: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(divisor))


def toxicity_network(docs: DataFrame, labels: DataFrame) -> toxicity.Network:
    """Trained on the labelled documents that are not held out."""
    return toxicity.train(docs, labels.where(_remainder(F.col("doc_id"), 4) != 2), label="toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, None if docs.isEmpty() else toxicity_network(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.text_media(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_packages(warc.write_packages(read(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), lambda i: _remainder(i, 3) != 1)
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_decontaminate, op4_mix_sources, op5_minhash_dedup, op6_media_columns, op7_url_filter, op8_warc_zip, op9_pii, op10_quality, op11_hard_negatives, op12_spelling, op13_html_extract)}

_ALPHABETS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)

ORACLE_SQL = {
    "op4_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), ranked AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS budget,
    (coalesce(sum(3 * source_size) OVER before, 0))::BIGINT AS spent, (sum(weight) OVER ())::BIGINT - (coalesce(sum(weight) OVER before, 0))::BIGINT AS open_weight
  FROM sources WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT coalesce(max((budget - spent)::DOUBLE / open_weight), 0) AS v FROM ranked
), targets AS (
  SELECT source, source_size, weight, least(3.0::DOUBLE * source_size, weight * v) AS target FROM sources, cut
), placed AS (
  SELECT doc_id, size, source_size, target,
    (sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS fin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (
  (fin - size / 2.0::DOUBLE <= target)::BIGINT + (source_size + fin - size / 2.0::DOUBLE <= target)::BIGINT + (2 * source_size + fin - size / 2.0::DOUBLE <= target)::BIGINT) AS taken
FROM placed""",
    "op7_url_filter": f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}), rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_ALPHABETS}) AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rests
), judged AS (
  SELECT n, page_id, host, path, max_by({{'rule': r_host || r_path, 'verdict': r_verdict}}, length(r_host || r_path) * 1000 + length(r_host)) AS best
  FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY n, page_id, host, path
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged""",
}

ORACLE_SQL["op2_line_dedup"] = rf"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_ALPHABETS}) AS key FROM lines
), firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id > first) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR doc_id = first), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id"""

# equal sets meet as one; of these, all pairs that share a shingle are counted
ORACLE_SQL["op5_minhash_dedup"] = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ALPHABETS}), '[^\x20\x09-\x0D]+') AS w FROM documents), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM docs WHERE len(w) > 0)
), sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS h FROM shingles GROUP BY doc_id), classes AS (SELECT h, min(doc_id) AS rep, min(n) AS n FROM sets GROUP BY h),
own AS (SELECT rep, n, sh FROM shingles JOIN classes ON doc_id = rep), pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM own a JOIN own b ON a.sh = b.sh AND a.rep <> b.rep GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))
), reached AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT reached.x, pairs.y FROM reached JOIN pairs ON reached.y = pairs.x),
roots AS (SELECT x AS rep, min(y) AS root FROM reached GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id)::BIGINT AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN (SELECT doc_id, sets.n, root FROM sets JOIN classes USING (h) JOIN roots USING (rep)) USING (doc_id)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_ALPHABETS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op3_decontaminate"] = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark), windows AS (
  SELECT item_id, len(w[i + 1 : i + 13]) AS n, array_to_string(w[i + 1 : i + 13], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), lengths AS (SELECT DISTINCT n FROM windows), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, lengths WHERE len(w) >= n)
), matches AS (
  SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, win)
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM matches)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM matches) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

# base 32 of a SHA-1: every five bits of the hexadecimal digits, read as a number
_BITS = "".join(f"WHEN '{d:x}' THEN '{d:04b}' " for d in range(16))
ORACLE_SQL["op8_warc_zip"] = f"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digests AS (
  SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, (i * 5 + j + 1)::BIGINT, 1) = '1' THEN (16 >> j::INT) ELSE 0 END))::BIGINT + 1, 1)), '') AS payload_digest
  FROM (SELECT DISTINCT hex, array_to_string(list_transform(string_split(hex, ''), lambda d: CASE d {_BITS}END), '') AS bits FROM payloads)
), holders AS (SELECT hex, max(page_id) AS holder FROM payloads GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = holder OR holder IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM payloads JOIN digests USING (hex) JOIN holders USING (hex)"""

# CRC-32 byte by byte from its table; letters are ASCII or two bytes long.  Words that share a pattern with one open place, or of which
# one is a deletion of the other, are near.
ORACLE_SQL["op12_spelling"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), {_ALPHABETS}) AS run FROM documents
), hashed AS (
  SELECT run, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM runs, crc
), found AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
), words AS (SELECT word, count(*) AS n FROM found WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2), cut AS (
  SELECT word, n, left(word, i::INT) AS head, substr(word, i::INT + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT cut.word, cut.n, words.word, words.n FROM cut JOIN words ON words.word = head || tail
  UNION SELECT words.word, words.n, cut.word, cut.n FROM cut JOIN words ON words.word = head || tail
), best AS (
  SELECT word, n, count(*) AS n_near, arg_min(other, {{'a': -other_n, 'b': other}}) AS form, max(other_n) AS form_n FROM near GROUP BY word, n
), forms AS (SELECT word, form, form_n FROM best WHERE form_n >= 10 * n),
reached AS (SELECT word, form AS root, 1 AS step FROM forms UNION ALL SELECT r.word, f.form, step + 1 FROM reached r JOIN forms f ON f.word = r.root),
roots AS (SELECT word, arg_max(root, step) AS root FROM reached GROUP BY word)
SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, forms.form, forms.form_n, coalesce(root, word) AS root
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)"""

ORACLE_SQL["op11_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""

# the pages of the tables keep their main text in headings and paragraphs of one article, and use a few character references
ORACLE_SQL["op13_html_extract"] = r"""
WITH articles AS (
  SELECT page_id, url, unnest(string_split(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h1)>', chr(1), 'g'), chr(1))) AS block,
    unnest(range(len(string_split(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h1)>', chr(1), 'g'), chr(1))))) AS pos FROM pages
), plain AS (
  SELECT page_id, url, pos, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(block, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g') AS block FROM articles
)
SELECT page_id, url, coalesce(string_agg(trim(block), chr(10) ORDER BY pos) FILTER (WHERE trim(block) <> ''), '') AS text,
  length(coalesce(string_agg(trim(block), chr(10) ORDER BY pos) FILTER (WHERE trim(block) <> ''), ''))::BIGINT AS n_chars
FROM plain GROUP BY page_id, url"""
