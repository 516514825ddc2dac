"""ANSI SQL that gives the same rows as the queries of ``catalog``."""

ORACLES: dict[str, str] = {}

# ---- shared pieces --------------------------------------------------------

PAGE_PARTS = r"""
parts AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://', ''), '/$', '/index') AS bare
  FROM pages
),
rel AS (
  SELECT *, CASE WHEN ends_with(bare, '.html') THEN bare ELSE bare || '.html' END AS rel_path FROM parts
),
located AS (
  SELECT *, regexp_replace(regexp_replace(rel_path, '\.html$', '') || '.md', '[^a-zA-Z0-9._/-]', '_', 'g') AS doc_path,
         scheme || '://' || regexp_replace(rel_path, '\.html$', '') AS source_url
  FROM rel
)"""

HREFS = PAGE_PARTS + r""",
hrefs AS (
  SELECT page_id, url, ord - 1 AS ord, scheme || '://' || host || found[ord] AS resolved
  FROM (SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM parts) p,
       LATERAL (SELECT unnest(generate_series(1, len(found))) AS ord) o
)"""

PROSE = r"""
prose AS (
  SELECT doc_id, source AS bundle, lang, source || '/' || doc_id || '.md' AS doc_path,
         'https://' || source || '.example.org/' || doc_id AS source_url, text AS body
  FROM documents
)"""

SIZED = PROSE + r""",
sized AS (
  SELECT *, strlen('---' || chr(10) || 'title: "Document ' || doc_id || '"' || chr(10)
                   || 'source_url: "' || source_url || '"' || chr(10) || '---' || chr(10) || chr(10) || body) AS md_bytes
  FROM prose
)"""

LINKED = PROSE + r""",
linked AS (
  SELECT doc_id, source_url,
         'See [a' || doc_id || '](/x/' || doc_id
         || ') and ![i](img.png) [![b](c.png)](page) [e](#t) []() [m](mailto:x@y.z) [h](https://k.org/q)' || chr(10)
         || body || chr(10) || '[up](../up?q=1#f) [p](/p "T") [c](d/./e/../f.html)' AS body
  FROM prose
),
found AS (
  SELECT doc_id, ord - 1 AS ord, texts[ord] AS text, hrefs[ord] AS href
  FROM (SELECT doc_id, regexp_extract_all(body, '\[([^\]]*)\]\(([^)]+)\)', 1) AS texts,
               regexp_extract_all(body, '\[([^\]]*)\]\(([^)]+)\)', 2) AS hrefs FROM linked) l,
       LATERAL (SELECT unnest(generate_series(1, len(texts))) AS ord) o
)"""

MATCHES = PROSE + r""",
counted AS (
  SELECT doc_id, bundle, doc_path, source_url, body,
         (strlen(low) - strlen(replace(low, 'that', ''))) // 4 + (strlen(low) - strlen(replace(low, 'with', ''))) // 4 AS matches
  FROM (SELECT *, lower(body) AS low FROM prose)
),
best AS (
  SELECT *, row_number() OVER (ORDER BY matches DESC, doc_id) AS rank FROM counted
  WHERE matches > 0 ORDER BY matches DESC, doc_id LIMIT 10
)"""


def islands(of: str) -> str:
    return rf"""
split AS (SELECT doc_id, string_split(body, chr(10)) AS lines FROM {of}),
hit AS (
  SELECT doc_id, n - 1 AS line_no
  FROM split, LATERAL (SELECT unnest(generate_series(1, len(lines))) AS n) g
  WHERE contains(lower(lines[n]), 'that') OR contains(lower(lines[n]), 'with')
),
marked AS (
  SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) <= 5 THEN 0 ELSE 1 END AS opens
  FROM hit
),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM marked
),
island AS (
  SELECT doc_id, island, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_hits
  FROM numbered GROUP BY ALL
)"""


CONTEXTS = "WITH " + MATCHES + "," + islands("best") + r""",
framed AS (
  SELECT i.doc_id, row_number() OVER (PARTITION BY i.doc_id ORDER BY first_line) - 1 AS ctx_no,
         greatest(first_line - 2, 0) AS start_line, least(last_line + 3, len(lines)) AS end_line, lines
  FROM island i JOIN split USING (doc_id)
),
shown AS (
  SELECT doc_id, ctx_no, start_line, end_line,
         string_agg(CASE WHEN contains(lower(lines[n]), 'that') OR contains(lower(lines[n]), 'with') THEN '> ' ELSE '  ' END
                    || lines[n], chr(10) ORDER BY n) AS snippet
  FROM framed, LATERAL (SELECT unnest(generate_series(start_line + 1, end_line)) AS n) g
  GROUP BY ALL
)"""

# ---- scans ----------------------------------------------------------------

ORACLES["scan_pages"] = "SELECT page_id, url, strlen(html) AS n_bytes FROM pages"

ORACLES["scan_file_tree"] = r"""
SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' || CASE WHEN page_id % 3 = 0 THEN '_saved' ELSE 'saved' END
         || '/' || page_id || '.html' AS rel_path,
       strlen(coalesce(html, '')) AS n_bytes, md5(coalesce(html, '')) AS content_md5
FROM pages
"""

ORACLES["scan_docs"] = f"WITH {PROSE} SELECT doc_id, doc_path, strlen(body) AS md_bytes FROM prose"

# ---- URLs and paths -------------------------------------------------------

ORACLES["valid_urls"] = r"""
WITH c AS (
  SELECT page_id, unnest([url, 'ftp://' || rest, 'HTTPS://' || rest, 'https:///' || rest, rest, '']) AS candidate
  FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages)
),
p AS (
  SELECT page_id, lower(regexp_extract(candidate, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
         regexp_extract(candidate, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS host
  FROM c
)
SELECT page_id, scheme, host, scheme IN ('http', 'https') AND host <> '' AS is_valid FROM p"""

ORACLES["crawl_scope"] = f"WITH {HREFS}," + r"""
seeds AS (
  SELECT host AS seed_host, regexp_extract(arg_min(path, page_id), '^(.*/)', 1) AS seed_directory
  FROM parts GROUP BY host
),
c AS (
  SELECT page_id, resolved FROM hrefs
  UNION ALL
  SELECT page_id, unnest([url, scheme || '://' || host || path || '.pdf', scheme || '://' || host || path || '/a.zip?x=1',
                          scheme || '://other.' || host || path, scheme || '://' || host]) FROM parts
),
q AS (
  SELECT page_id, resolved, regexp_extract(resolved, '^[a-z]+://([^/?#]*)', 1) AS host,
         regexp_extract(resolved, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path
  FROM c
)
SELECT page_id, resolved,
       coalesce(starts_with(CASE WHEN path = '' THEN '/' ELSE path END, seed_directory)
                AND regexp_extract(path, '\.([^./]*)$', 1) NOT IN
                    ('css', 'js', 'png', 'jpg', 'jpeg', 'gif', 'svg', 'ico', 'woff', 'woff2', 'ttf', 'eot',
                     'zip', 'tar', 'gz', 'pdf', 'xml', 'json', 'txt'), false) AS in_scope
FROM q LEFT JOIN seeds ON host = seed_host"""

ORACLES["crawl_depth"] = f"WITH RECURSIVE {HREFS}," + r"""
edges AS (
  SELECT url AS src, resolved AS dst FROM hrefs
  UNION
  SELECT a.url, b.url FROM pages a JOIN pages b ON b.page_id = a.page_id + 1
),
seeds AS (SELECT arg_min(url, page_id) AS url FROM parts GROUP BY host),
walk(url, depth) AS (
  SELECT url, 0 FROM seeds
  UNION
  SELECT dst, depth + 1 FROM walk JOIN edges ON src = walk.url WHERE depth < 5
)
SELECT url, min(depth) AS depth FROM walk GROUP BY url"""

ORACLES["crawl_depth_filtered"] = ORACLES["crawl_depth"]

ORACLES["path_guard"] = f"WITH {PAGE_PARTS}," + r"""
v AS (
  SELECT page_id, unnest([rel_path, '../' || rel_path, '/' || rel_path, replace(rel_path, '/', '/../'),
                          replace(rel_path, '/', '/..x/')]) AS rel_path
  FROM rel
)
SELECT page_id, rel_path, NOT starts_with(rel_path, '/') AND NOT list_contains(string_split(rel_path, '/'), '..') AS ok FROM v"""

ORACLES["source_urls"] = f"WITH {PAGE_PARTS} SELECT page_id, rel_path, source_url FROM located"

ORACLES["doc_paths"] = f"WITH {PAGE_PARTS} SELECT page_id, doc_path FROM located"

ORACLES["path_collisions"] = f"WITH {PAGE_PARTS}" + r"""
SELECT doc_path, max(page_id) * 2 + 1 AS winner_page_id, count(*) * 2 AS n FROM located GROUP BY doc_path"""

ORACLES["settled_paths"] = f"WITH {PAGE_PARTS}" + r"""
SELECT host AS bundle, doc_path, max(page_id) * 2 + 1 AS page_id FROM located GROUP BY ALL"""

ORACLES["saved_file_paths"] = f"WITH {PAGE_PARTS}" + r"""
, n AS (SELECT page_id, unnest([rel_path, stem || '#b.html', '_modules/' || stem || '/_x.html']) AS rel_path
        FROM (SELECT *, rel_path[:-6] AS stem FROM rel))
SELECT page_id, rel_path, regexp_replace(rel_path[:-6] || '.md', '[^a-zA-Z0-9._/-]', '_', 'g') AS doc_path,
       'https://' || rel_path[:-6] AS source_url
FROM n"""

ORACLES["index_pages"] = f"WITH {PAGE_PARTS}" + r"""
SELECT host AS bundle, count(*) FILTER (ends_with(doc_path, 'index.md')) AS n_index FROM located GROUP BY host"""

# ---- extraction -----------------------------------------------------------

def unescaped(text: str) -> str:
    """Entities of the pages; the last one of a cut title lacks its semicolon."""
    return f"""regexp_replace(regexp_replace({text}, '&quot;?', '"', 'g'), '&amp;?', '&', 'g')"""


TITLE = "trim(" + unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)") + ")"

ORACLES["page_titles"] = f"SELECT page_id, {TITLE} AS title FROM pages"

ORACLES["container_kinds"] = r"""
SELECT CASE WHEN contains(html, '<main') THEN 'main' WHEN contains(html, '<article') THEN 'article'
            WHEN regexp_matches(html, '<div class="[^"]*content') THEN 'div'
            WHEN contains(html, '<body') THEN 'body' END AS container,
       count(*) AS n_pages
FROM pages GROUP BY 1"""

ORACLES["extract_docs"] = f"WITH {PAGE_PARTS}," + rf"""
a AS (
  SELECT page_id, doc_path, source_url, {TITLE} AS title,
         regexp_extract(html, '<article>((?s:.*?))</article>', 1) AS art
  FROM located
),
escaped AS (
  SELECT *, replace(replace(art, '*', '\*'), '_', '\_') AS art2,
         len(regexp_extract_all(art, '<b>')) AS n_bold
  FROM a
),
marks AS (
  SELECT *, '# ' || regexp_extract(art2, '<h1>([^<]*)</h1>', 1) || chr(10) || chr(10)
         || replace(replace(regexp_replace(regexp_replace(art2, '^<h1>[^<]*</h1>', ''), '\s*</?p>\s*', chr(10) || chr(10), 'g'),
                    '<b>', '**'), '<br>', chr(10) || chr(10)) AS raw
  FROM escaped
),
spaced AS (
  SELECT *, regexp_replace(regexp_replace(raw, ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS tidy FROM marks
),
final AS (
  SELECT *, {unescaped("rtrim(tidy, ' ' || chr(10))")} || repeat('**', n_bold) AS body FROM spaced
)
SELECT page_id, doc_path, title, source_url, body,
       strlen('---' || chr(10) || 'title: "' || replace(replace(title, '\', '\\'), '"', '\"') || '"' || chr(10)
              || 'source_url: "' || source_url || '"' || chr(10)
              || 'fetched_at: "2024-01-01T00:00:00.000000+00:00"' || chr(10) || '---' || chr(10) || chr(10) || body) AS md_bytes
FROM final"""

ORACLES["rejects_by_stage"] = f"WITH {PAGE_PARTS}" + r"""
SELECT 'extract' AS stage, 'no content container' AS reason, count(*) AS n FROM pages
UNION ALL SELECT 'title', 'title element without a single text', count(*) FROM pages
UNION ALL SELECT 'url', 'invalid scheme', count(*) FROM pages
UNION ALL SELECT 'collision', 'path taken by page', 2 * count(*) - count(DISTINCT (host, doc_path)) FROM located"""

ORACLES["clean_text"] = r"""
WITH b AS (
  SELECT doc_id, regexp_replace(replace(text, chr(10), ' ' || chr(9) || ' ' || repeat(chr(10), 4) || ' ' || chr(10)) || ' ' || chr(10),
                                '\n{3,}', chr(10) || chr(10), 'g') AS blanks
  FROM documents
)
SELECT doc_id, array_to_string(list_transform(string_split(blanks[:-2], chr(10)), lambda l: rtrim(l, ' ' || chr(9))), chr(10)) AS cleaned
FROM b"""

# ---- frontmatter ----------------------------------------------------------

HEADED = PROSE + r""",
headed AS (
  SELECT doc_id, body,
         '---' || chr(10) || 'title: "Say \"' || bundle || '\" ' || doc_id || '"' || chr(10)
         || 'source_url: "' || source_url || '"' || chr(10)
         || 'fetched_at: "2024-01-01T00:00:00+00:00"' || chr(10) || '---' || chr(10) || chr(10) AS frontmatter
  FROM prose
)"""

ORACLES["render_frontmatter"] = f"WITH {HEADED} SELECT doc_id, frontmatter FROM headed"

ORACLES["parse_frontmatter"] = f"WITH {HEADED}," + r"""
l AS (
  SELECT doc_id, length(regexp_replace(body, '^(\s*\n)?', '')) AS body_length, unnest(string_split(frontmatter, chr(10))) AS line
  FROM headed
)
SELECT doc_id, body_length, trim(line[:strpos(line, ':') - 1]) AS key, trim(line[strpos(line, ':') + 1:]) AS value
FROM l WHERE strpos(line, ':') > 0"""

# ---- links ----------------------------------------------------------------

ORACLES["md_links"] = f"WITH {LINKED} SELECT doc_id, ord, text, href FROM found"

ORACLES["link_kinds"] = f"WITH {LINKED}," + HREFS + r""",
k AS (
  SELECT CASE WHEN regexp_matches(href, '^(http:|https:|mailto:)') THEN 'absolute' WHEN starts_with(href, '#') THEN 'anchor'
              ELSE 'resolved' END AS kind
  FROM found
  UNION ALL SELECT 'resolved' FROM hrefs
)
SELECT kind, count(*) AS n FROM k GROUP BY kind"""

ORACLES["resolve_root_links"] = f"WITH {HREFS} SELECT page_id, ord, resolved FROM hrefs"

ORACLES["normalize_links"] = f"WITH {LINKED}," + r"""
based AS (SELECT *, regexp_extract(source_url, '^https://[^/]*', 0) AS root FROM linked)
SELECT doc_id,
       replace(replace(replace(replace(replace(replace(body, '](/x/', '](' || root || '/x/'), '](img.png', '](' || root || '/img.png'),
               '](c.png', '](' || root || '/c.png'), '](../up', '](' || root || '/up'), '](/p ', '](' || root || '/p '),
               '](d/./e/../f.html', '](' || root || '/d/f.html') AS body
FROM based"""

ORACLES["href_spellings"] = r"""
WITH h AS (SELECT page_id, string_split(html, '<a href="') AS bits FROM pages),
l AS (SELECT page_id, k - 2 AS n, string_split(bits[k], '"')[1] AS href
      FROM h, LATERAL (SELECT unnest(generate_series(2, len(bits))) AS k) g)
SELECT page_id * 1000 + n AS page_id, unnest(generate_series(0, 6)) AS ord, replace(href, '&amp;', '&') AS href FROM l"""

ORACLES["crawl_reachable"] = f"WITH {PAGE_PARTS}," + r"""
sites AS (SELECT host, count(*) AS n FROM parts GROUP BY host)
SELECT 'https://' || host || '/s/p' || d AS url, CAST(d AS INTEGER) AS depth
FROM sites, LATERAL (SELECT unnest(generate_series(0, least(n, 5))) AS d) g"""

ORACLES["link_targets"] = f"WITH {HREFS}," + r"""
targets AS (
  SELECT resolved FROM hrefs
  UNION
  SELECT b.source_url || '.html#x' FROM pages a JOIN located b ON b.page_id = a.page_id + 1
),
fetched AS (
  SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://', ''), '(/index)?(\.html)?/?$', '') AS key
  FROM pages
)
SELECT resolved, f.key IS NOT NULL AS is_internal
FROM targets LEFT JOIN fetched f
  ON f.key = regexp_replace(regexp_replace(regexp_replace(resolved, '#.*$', ''), '^[a-z]+://', ''), '(/index)?(\.html)?/?$', '')"""

ORACLES["link_status"] = f"WITH {HREFS}," + r"""
targets AS (
  SELECT resolved, min(part) AS linked FROM (
    SELECT resolved, page_id % 3 AS part FROM hrefs
    UNION ALL
    SELECT b.source_url || '.html#x', a.page_id % 3 FROM pages a JOIN located b ON b.page_id = a.page_id + 1)
  GROUP BY resolved
),
fetched AS (
  SELECT regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://', ''), '(/index)?(\.html)?/?$', '') AS key,
         min(page_id % 3) AS arrived
  FROM pages GROUP BY key
)
SELECT resolved, arrived IS NOT NULL AS is_internal, greatest(linked, coalesce(arrived, linked)) AS since
FROM targets LEFT JOIN fetched f
  ON f.key = regexp_replace(regexp_replace(regexp_replace(resolved, '#.*$', ''), '^[a-z]+://', ''), '(/index)?(\.html)?/?$', '')"""

# ---- search ---------------------------------------------------------------

ORACLES["search_filter"] = (
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'that') OR contains(lower(text), 'with')"
)

ORACLES["search_counts"] = f"WITH {MATCHES} SELECT doc_id, matches FROM counted WHERE matches > 0"

ORACLES["search_topk"] = f"WITH {MATCHES} SELECT doc_id, matches FROM best"

ORACLES["search_indexed"] = r"""
WITH words AS (SELECT unnest(['that with', 'that with', 'ciónrr tschä', 'ciónrr tschä']) AS query,
                      unnest(['that', 'with', 'ciónrr', 'tschä']) AS word),
counted AS (
  SELECT query, doc_id, CAST(sum((length(lower(text)) - length(replace(lower(text), word, ''))) // length(word)) AS BIGINT) AS matches
  FROM documents, words GROUP BY query, doc_id)
SELECT query, doc_id, matches FROM counted WHERE matches > 0
QUALIFY row_number() OVER (PARTITION BY query ORDER BY matches DESC, doc_id) <= 10"""

ORACLES["search_category"] = f"WITH {MATCHES}" + r"""
SELECT doc_id, doc_path, matches FROM counted
WHERE matches > 0 AND list_contains(string_split(doc_path, '/'), 'src1')
ORDER BY matches DESC, doc_path LIMIT 10"""


def many_queries(queries: str) -> str:
    return rf"""
keywords AS (
  SELECT query_id, keyword, count(*) AS weight
  FROM (SELECT query_id, unnest(string_split_regex(lower(query), '\s+')) AS keyword FROM {queries})
  WHERE keyword <> '' GROUP BY ALL
),
low AS MATERIALIZED (SELECT doc_id, lower(text) AS body FROM documents),
per_keyword AS MATERIALIZED (
  SELECT doc_id, keyword, (strlen(body) - strlen(replace(body, keyword, ''))) // strlen(keyword) AS n
  FROM low CROSS JOIN (SELECT DISTINCT keyword FROM keywords) WHERE contains(body, keyword)
),
scored AS (
  SELECT query_id, doc_id, CAST(sum(n * weight) AS BIGINT) AS matches
  FROM per_keyword JOIN keywords USING (keyword) GROUP BY ALL
)"""


ORACLES["multi_query_search"] = (
    "WITH queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)," + many_queries("queries") + r"""
SELECT query_id, doc_id, matches, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, doc_id) AS rank
FROM scored QUALIFY rank <= 10"""
)

ORACLES["multi_query_sliced"] = ORACLES["multi_query_search"]

ORACLES["hits_of_twin_bundles"] = f"WITH {MATCHES}" + r"""
SELECT row_number() OVER (ORDER BY matches + extra DESC, bundle, name) AS rank, bundle, name AS doc_path,
       matches + extra AS matches, source_url
FROM (SELECT unnest(['a', 'b']) AS bundle, unnest([0, 1]) AS extra, doc_id || '.md' AS name, matches, source_url FROM counted)
WHERE matches + extra > 0 QUALIFY rank <= 10"""

ORACLES["multi_query_counts"] = (
    "WITH queries AS (SELECT DISTINCT lang AS query_id, concat_ws(' ', lang, lang, 'the') AS query FROM documents),"
    + many_queries("queries") + "SELECT query_id, doc_id, matches FROM scored"
)

ORACLES["doc_lines"] = "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents"

ORACLES["hit_lines"] = f"WITH {PROSE},{islands('prose')} SELECT doc_id, line_no FROM hit"

ORACLES["match_islands"] = (
    f"WITH {PROSE},{islands('prose')} SELECT doc_id, first_line, last_line, n_hits FROM island"
)

ORACLES["window_islands"] = ORACLES["match_islands"]

ORACLES["search_contexts"] = CONTEXTS + " SELECT doc_id, ctx_no, start_line, end_line, snippet FROM shown"

ORACLES["hits_display"] = CONTEXTS + r"""
SELECT rank, doc_id, matches, source_url, 'Unknown' AS fetched_at, least(n, 3) AS n_contexts_shown
FROM best JOIN (SELECT doc_id, count(*) AS n FROM shown GROUP BY doc_id) USING (doc_id)"""

ORACLES["hits_json"] = CONTEXTS + r""",
listed AS (SELECT doc_id, list(snippet ORDER BY ctx_no) AS contexts FROM shown GROUP BY doc_id)
SELECT doc_id,
       CAST(json_object('file', CAST(doc_id AS VARCHAR), 'matches', matches, 'contexts', contexts, 'source_url', source_url,
                        'fetched_at', 'Unknown') AS VARCHAR) AS json
FROM best JOIN listed USING (doc_id)"""

# ---- bundles --------------------------------------------------------------

ORACLES["upsert_docs"] = r"""
SELECT source || '/' || doc_id || '.md' AS doc_path, doc_id, CASE WHEN lang IN ('fr', 'en') THEN 2 ELSE 1 END AS version
FROM documents"""

ORACLES["delta_upserts"] = r"""
WITH replaced AS (SELECT DISTINCT source FROM documents WHERE source IN ('src0', 'src1') AND doc_id % 3 = 0)
SELECT source || '/' || doc_id || '.md' AS doc_path, doc_id,
       CASE WHEN source IN (FROM replaced) THEN 4 WHEN doc_id % 11 = 0 THEN 3 WHEN doc_id % 3 <> 1 THEN 2 ELSE 1 END AS version,
       octet_length(encode(text)) AS n_bytes
FROM documents WHERE source IS NULL OR source NOT IN (FROM replaced) OR doc_id % 3 = 0"""

ORACLES["bundle_report"] = f"WITH {SIZED}" + r"""
SELECT bundle, count(*) AS n_files, count(*) FILTER (ends_with(doc_path, '.md')) AS n_md,
       CAST(sum(md_bytes) AS BIGINT) AS total_bytes, round(sum(md_bytes) / 1048576.0::DOUBLE, 2) AS total_mb,
       sum(md_bytes) > 8388608 AS over_limit, true AS valid,
       CASE WHEN sum(md_bytes) > 8388608 THEN 1 ELSE 0 END AS n_warnings,
       first(doc_path ORDER BY md_bytes DESC, doc_path) AS largest
FROM sized GROUP BY bundle"""

ORACLES["bundle_views"] = f"WITH {SIZED}" + r""",
replaced AS (SELECT DISTINCT source FROM documents WHERE source IN ('src0', 'src1') AND doc_id % 3 = 0),
current AS (
  SELECT bundle, doc_path,
         CASE WHEN doc_id % 3 <> 1 AND doc_id % 5 = 0 AND (bundle IS NULL OR bundle NOT IN (FROM replaced))
              THEN md_bytes - strlen(body) + 5 ELSE md_bytes END AS size
  FROM sized WHERE bundle IS NULL OR bundle NOT IN (FROM replaced) OR doc_id % 3 = 0
)
SELECT bundle, row_number() OVER (PARTITION BY bundle ORDER BY size DESC, doc_path) AS rank, doc_path, round(size / 1024.0::DOUBLE, 1) AS kb,
       count(*) OVER (PARTITION BY bundle) AS n_files,
       count(*) FILTER (ends_with(doc_path, '.md')) OVER (PARTITION BY bundle) AS n_md,
       CAST(sum(size) OVER (PARTITION BY bundle) AS BIGINT) AS total_bytes
FROM current QUALIFY rank <= 10"""

ORACLES["bundle_validation"] = r"""
WITH every AS (
  SELECT source || '-' || kind AS bundle, kind, n
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source),
       (SELECT unnest(['good', 'bare', 'nomd', 'nofm', 'open', 'noname', 'big', 'edge', 'empty', 'absent']) AS kind)),
stored AS (
  SELECT bundle, kind NOT IN ('bare', 'absent') AS described, kind NOT IN ('empty', 'absent') AS filled,
         CASE WHEN kind IN ('empty', 'absent') THEN 0 ELSE 2 END AS n_files,
         CASE WHEN kind IN ('empty', 'absent', 'nomd') THEN 0 ELSE 2 END AS n_md,
         CASE kind WHEN 'empty' THEN 0 WHEN 'absent' THEN 0 WHEN 'big' THEN 8388609 WHEN 'edge' THEN 8388608 ELSE n + 1 END AS total_bytes,
         kind
  FROM every)
SELECT bundle, n_files, n_md, total_bytes, total_bytes > 8 * 1024 * 1024 AS over_limit, described AND filled AS valid,
       CASE WHEN described AND filled THEN '' WHEN filled THEN 'descriptor not found'
            WHEN described THEN 'documents not found' ELSE 'bundle not found' END AS errors,
       concat_ws('; ', CASE WHEN kind = 'noname' THEN 'descriptor lacks name' END,
                 CASE WHEN kind = 'nofm' THEN 'descriptor has no frontmatter' END,
                 CASE WHEN kind = 'open' THEN 'descriptor frontmatter is incomplete' END,
                 CASE WHEN filled AND n_md = 0 THEN 'no Markdown documents' END,
                 CASE WHEN total_bytes > 8 * 1024 * 1024 THEN 'size limit exceeded' END) AS warnings
FROM stored"""

ORACLES["largest_docs"] = f"WITH {SIZED}" + r"""
SELECT bundle, row_number() OVER (PARTITION BY bundle ORDER BY md_bytes DESC, doc_path) AS rank, doc_path,
       round(md_bytes / 1024.0::DOUBLE, 1) AS kb
FROM sized QUALIFY rank <= 10"""

ORACLES["bundle_manifest"] = f"WITH {SIZED}" + r"""
SELECT bundle, upper(bundle) || ' documentation assistant' AS description, count(*) AS n_docs,
       CAST(sum(md_bytes) AS BIGINT) AS total_bytes,
       bit_xor(CAST('0x' || md5(doc_path || chr(10) || body)[:15] AS BIGINT)) AS content_hash
FROM sized GROUP BY bundle"""

# ---- crawl log ------------------------------------------------------------

LOG = PAGE_PARTS + r""",
log AS (
  SELECT host AS run_id, page_id * 4 + j AS seq, ts, line FROM (
    SELECT host, page_id, make_timestamp((page_id + 1704067200) * 1000000) AS ts, unnest([0, 1, 2, 3]) AS j,
           unnest(['--' || strftime(make_timestamp((page_id + 1704067200) * 1000000), '%Y-%m-%d %H:%M:%S') || '--  ' || url,
                   'HTTP request sent, awaiting response... 200 OK',
                   CASE WHEN NOT contains(url, '#') THEN 'Saving to: ''page.html''' END,
                   CASE WHEN NOT contains(url, '#') THEN '''page.html'' SAVED [10/10]' END]) AS line
    FROM parts)
  WHERE line IS NOT NULL
  UNION ALL
  SELECT host, min(page_id) * 4 - 1, make_timestamp((min(page_id) + 1704067200 - 5) * 1000000), '''robots.txt'' saved [1/1]'
  FROM parts GROUP BY host
),
carried AS (
  SELECT *, last_value(CASE WHEN found <> '' THEN found END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq) AS current_url
  FROM (SELECT *, regexp_extract(line, '--\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}--\s+(\S+)', 1) AS found FROM log)
),
per_run AS (
  SELECT run_id,
         count(DISTINCT coalesce(current_url, ''))
           FILTER (contains(lower(line), 'saved') OR contains(line, 'Saving to:')) AS n_urls,
         CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS elapsed_s
  FROM carried GROUP BY run_id
)"""

ORACLES["export_results"] = r"""
WITH counted AS (
  SELECT source AS bundle, count(*) AS n1, count(*) FILTER (doc_id % 5 <> 2) AS n2,
         count(*) FILTER (doc_id % 5 <> 2 AND doc_id % 149 = 0) AS leaving, count(*) FILTER (text IS NULL) AS silent1,
         count(*) FILTER (doc_id % 5 <> 2 AND text IS NULL) AS silent2
  FROM documents GROUP BY source),
told AS (
  SELECT *, CASE WHEN silent1 > 0 THEN 'a document has no text' ELSE 'exported' END AS first_one,
         CASE WHEN leaving > 0 THEN 'a document path leaves the bundle' WHEN silent2 > 0 THEN 'a document has no text'
              ELSE 'exported' END AS second_one
  FROM counted)
SELECT 1 AS version, bundle, first_one AS outcome, n1 AS n_docs FROM told
UNION ALL SELECT 2, bundle, second_one, n2 FROM told WHERE n2 > 0
UNION ALL SELECT unnest([1, 2]), bundle || '-absent', 'bundle not found', 0 FROM told
UNION ALL SELECT 0, bundle, 'current', CASE WHEN second_one = 'exported' AND n2 > 0 THEN n2 ELSE n1 END
FROM told WHERE first_one = 'exported' OR (second_one = 'exported' AND n2 > 0)"""

ORACLES["crawl_progress"] = f"WITH {LOG}" + r"""
SELECT run_id, n_urls, elapsed_s, CASE WHEN elapsed_s > 0 THEN round(n_urls / elapsed_s::DOUBLE, 6) ELSE 0.0 END AS rate
FROM per_run"""

ORACLES["stream_crawl_progress"] = ORACLES["crawl_progress"]

ORACLES["stream_run_parts"] = f"WITH {LOG}," + r"""
cut AS (
  SELECT *, sum(CASE WHEN ts - before <= INTERVAL 2 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY seq) AS part
  FROM (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM log)),
in_part AS (
  SELECT *, last_value(CASE WHEN found <> '' THEN found END IGNORE NULLS) OVER (PARTITION BY run_id, part ORDER BY seq) AS current_url
  FROM (SELECT *, regexp_extract(line, '--\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}--\s+(\S+)', 1) AS found FROM cut)),
per_part AS (
  SELECT run_id, CAST(epoch(min(ts)) AS BIGINT) AS started_s, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS elapsed_s,
         count(DISTINCT coalesce(current_url, ''))
           FILTER (contains(lower(line), 'saved') OR contains(line, 'Saving to:')) AS n_urls
  FROM in_part GROUP BY run_id, part)
SELECT run_id, started_s, n_urls, elapsed_s, CASE WHEN elapsed_s > 0 THEN round(n_urls / elapsed_s::DOUBLE, 6) ELSE 0.0 END AS rate,
       CAST(0 AS BIGINT) AS late
FROM per_part"""

ORACLES["stream_url_sketches"] = f"WITH {LOG}" + r"""
SELECT run_id, n_urls, elapsed_s, true AS within_bound FROM per_run"""

ORACLES["crawl_outcomes"] = r"""
SELECT CASE length(html) % 10 WHEN 0 THEN 'complete' WHEN 4 THEN 'network failure' WHEN 6 THEN 'authentication failure'
                              WHEN 8 THEN 'server error' ELSE 'incomplete' END AS outcome,
       count(*) AS n
FROM pages GROUP BY 1"""

# ---- streams --------------------------------------------------------------

ORACLES["stream_rate"] = r"""
SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) / 1.0::DOUBLE AS per_hour FROM events GROUP BY 1"""

ORACLES["stream_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"

ORACLES["stream_ingest_docs"] = f"WITH {PAGE_PARTS}" + r"""
SELECT doc_path, arg_max(page_id, (page_id % 3) * 1000000000 + page_id) AS page_id, 'current' AS state
FROM located GROUP BY host, doc_path
UNION ALL SELECT NULL, page_id, 'url: invalid scheme' FROM pages"""
