"""The registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    bpe,
    decontamination,
    exact_dedup,
    language_id,
    language_model,
    packing,
    quality_classifier,
    quality_rules,
    ranked_search,
    simhash,
    spelling,
    toxicity,
    url_filters,
)
from docloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


@query
def op2_packing(spark, sf_dir):
    # No other stage shares the workers here, so there is room for more words than in the pipeline.
    return packing.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 300_000)


@query
def op3_byte_bpe(spark, sf_dir):
    return bpe.report(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``.

    A host of every third first page is listed, delisted, and listed again; the
    first folder on a host of every fifth first page is listed for good.
    """
    first = pages.select("page_id", url_filters.host_of(F.col("url")).alias("host"),
                         F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]+)/", 1).alias("folder"))
    hosts = first.where("host <> ''").groupBy("host").agg(F.min("page_id").alias("n"))
    folders = first.where("host <> '' and folder <> ''").groupBy("host", "folder").agg(F.min("page_id").alias("n"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    n = F.col("n")
    spells = F.array(
        F.struct(F.lit(True).alias("listed"), day(n % 60).alias("at")),
        F.struct(F.lit(False).alias("listed"), day(n % 60 + 10 + n % 7).alias("at")),
        F.struct(F.lit(True).alias("listed"), day(n % 60 + 25).alias("at")),
    )
    by_host = hosts.where("n % 3 = 0").select(F.col("host").alias("key"), F.explode(spells).alias("e"))
    by_folder = folders.where("n % 5 = 1").select(
        F.concat("host", F.lit("/"), "folder", F.lit("/")).alias("key"), F.lit(True).alias("listed"), day(n % 80).alias("at")
    )
    return by_host.select("key", "e.listed", "e.at").unionByName(by_folder)


@query
def op4_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn(
        "fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int"))
    )
    return url_filters.filter_captures(captures, list_events(pages))


@query
def op5_language_id(spark, sf_dir):
    return language_id.report(table(spark, sf_dir, "documents"))


@query
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.report(table(spark, sf_dir, "documents"))


@query
def op7_quality_classifier(spark, sf_dir):
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


@query
def op9_katz_model(spark, sf_dir):
    return language_model.report(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_ranked_search(spark, sf_dir):
    return ranked_search.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_decontamination(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_spelling(spark, sf_dir):
    return spelling.report(table(spark, sf_dir, "documents"))


ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, g.p AS p, array_to_string(w[g.p:g.p + 7], ' ') AS gram
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS p) g WHERE len(w) >= 8),
twice AS (
  SELECT doc_id, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
hit AS (
  SELECT doc_id, count(DISTINCT i) AS n
  FROM (SELECT doc_id, unnest(range(p, p + 8)) AS i FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, body, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(hit.n, 0) AS n_repeat_words,
         length(regexp_replace(body, '\P{L}', '', 'g')) AS letters,
         length(regexp_replace(body, '\P{Lu}', '', 'g')) AS capitals,
         length(regexp_replace(body, '[^0-9]', '', 'g')) AS digits,
         length(regexp_replace(body, '[^!]', '', 'g')) AS exclaims,
         length(regexp_replace(body, '[^\n]', '', 'g')) AS breaks
  FROM d LEFT JOIN hit USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words
            OR 10 * letters < 6 * word_chars OR 2 * capitals > letters OR 5 * digits > word_chars
            OR 4 * exclaims > n_words OR 10 * n_dup_lines > 5 * (1 + breaks)) AS kept
FROM b
"""

ORACLES["op4_url_filters"] = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 90 AS INTEGER) AS fetched_at,
         rtrim(lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''),
           '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '.') AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)/', 1) AS folder,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT host, min(page_id) AS n FROM p WHERE host <> '' GROUP BY host),
folders AS (SELECT host, folder, min(page_id) AS n FROM p WHERE host <> '' AND folder <> '' GROUP BY ALL),
spells AS (
  SELECT host AS key, CAST(n % 60 AS INTEGER) AS a, CAST(n % 60 + 10 + n % 7 AS INTEGER) AS b FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT host, CAST(n % 60 + 25 AS INTEGER), NULL FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT host || '/' || folder || '/', CAST(n % 80 AS INTEGER), NULL FROM folders WHERE n % 5 = 1),
hit AS (
  SELECT page_id, s.key, DATE '2024-01-01' + s.a AS since
  FROM p JOIN spells s
    ON CASE WHEN contains(s.key, '/')
            THEN (host = split_part(s.key, '/', 1) OR ends_with(host, '.' || split_part(s.key, '/', 1)))
                 AND starts_with(path, '/' || split_part(s.key, '/', 2) || '/')
            ELSE host = s.key OR ends_with(host, '.' || s.key) END
   AND CAST(page_id % 90 AS INTEGER) >= s.a AND (s.b IS NULL OR CAST(page_id % 90 AS INTEGER) < s.b)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(s.key) DESC, s.key DESC) = 1)
SELECT p.page_id, url, fetched_at, hit.key IS NOT NULL AS blocked, hit.key AS matched_key, hit.since AS listed_since
FROM p LEFT JOIN hit USING (page_id)
"""

ORACLES["op6_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_ranked_search"] = rf"""
WITH it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM it) GROUP BY r, doc_id, n, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scored AS (
  SELECT item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM tf JOIN w USING (term) JOIN it USING (term), total GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER best <= 10
"""

ORACLES["op12_decontamination"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[g.i:g.i + 9], ' ') AS passage
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) g WHERE len(w) > 0),
grams AS (
  SELECT r, g.i AS i, k, array_to_string(w[g.i:g.i + k - 1], ' ') AS passage
  FROM d, (SELECT DISTINCT k FROM wins), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) g),
hits AS (SELECT DISTINCT r, i, k, item FROM grams JOIN wins USING (k, passage)),
n_hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN found USING (r)
"""

# One step of the checksum's table for each of the eight bits of a byte.
_STEPS = "n"
for _ in range(8):
    _STEPS = f"list_transform([{_STEPS}], lambda x: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)[1]"

ORACLES["op13_spelling"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda n: {_STEPS}) AS t),
runs AS (
  SELECT doc_id, word, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS word FROM documents)
  GROUP BY doc_id, word),
coded AS (
  SELECT doc_id, word, n, list_reduce(list_concat([4294967295], flatten(list_transform(
           string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))),
         lambda s, v: xor(s // 256, t[xor(s % 256, v) + 1])) AS s
  FROM runs, crc WHERE length(word) >= 5),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN xor(s, 4294967295) % 97 = 0
                    THEN left(word, xor(s, 4294967295) % length(word)) || substr(word, xor(s, 4294967295) % length(word) + 2)
                    ELSE word END AS word, n FROM coded)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS p FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (p, rest) WHERE a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = cut.rest
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = cut.rest),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word),
told AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form,
         CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM told
  UNION ALL SELECT walk.word, told.form FROM walk JOIN told ON told.word = walk.at WHERE told.form IS NOT NULL)
SELECT told.word, told.n, told.n_near, told.form, told.form_n, walk.at AS root
FROM walk JOIN told AS last ON last.word = walk.at AND last.form IS NULL JOIN told ON told.word = walk.word
"""
