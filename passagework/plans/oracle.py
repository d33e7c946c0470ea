"""The registered queries in DuckDB SQL, over the same tables, built from shared fragments."""

from __future__ import annotations

from passagework.config import (
    CHUNK_OVERLAP, CHUNK_SIZE, MIN_SCORE, PAGE_OVERLAP, PAGE_SIZE, REFERENCE_LIMIT, VECTOR_DIM,
)
from passagework.operators.vector_search import BITS, INDEX_BITS, RECALL

# fixed value: code points that strip() removes
WHITESPACE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_BLANKS = "||".join(f"chr({c})" for c in WHITESPACE)


def stable_id(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(1), {', '.join(parts)})), 1, 32)"


def split_ctes(prefix: str, source: str, key: str, text: str, size: int, overlap: int) -> str:
    """CTEs that split ``text`` of relation ``source`` by lines, and lines of ``size`` or more by
    words; ends in ``{prefix}(key, no, part)``. Words are shorter than ``size`` in the tables."""
    return f"""
{prefix}_line AS (
  SELECT key, i, CASE WHEN i > 1 THEN chr(10) ELSE '' END || x AS piece
  FROM (SELECT {key} AS key, unnest(string_split({text}, chr(10))) AS x,
               generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM {source})
),
{prefix}_flag AS (
  SELECT key, i, piece, length(piece) >= {size} AS long,
         coalesce(lag(length(piece) >= {size}) OVER (PARTITION BY key ORDER BY i), false) AS after_long
  FROM {prefix}_line WHERE piece <> ''
),
{prefix}_run AS (
  SELECT *, sum(CASE WHEN long OR after_long THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS run
  FROM {prefix}_flag
),
{prefix}_group AS (
  SELECT key, run, bool_or(long) AS long, list(piece ORDER BY i) AS lines FROM {prefix}_run GROUP BY key, run
),
{prefix}_piece AS (
  SELECT key, run, CASE WHEN long THEN ' ' ELSE chr(10) END AS sep,
         CASE WHEN long THEN list_filter(list_transform(string_split(lines[1], ' '),
                lambda x, j: CASE WHEN j > 1 THEN ' ' || x ELSE x END), lambda x: x <> '')
              ELSE lines END AS pieces
  FROM {prefix}_group
),
{prefix}_fold AS (
  SELECT key, run, list_reduce(
    list_transform(pieces, lambda p: {{'done': []::VARCHAR[], 'cur': p}}),
    lambda a, b: CASE WHEN length(a.cur) + length(b.cur) > {size} AND a.cur <> ''
      THEN {{'done': list_append(a.done, a.cur), 'cur':
        CASE WHEN length(a.cur) <= least({overlap}, {size} - length(b.cur)) THEN a.cur
             WHEN least({overlap}, {size} - length(b.cur)) <= 0 THEN ''
             WHEN strpos(right(a.cur, least({overlap}, {size} - length(b.cur))), sep) = 0 THEN ''
             ELSE substr(right(a.cur, least({overlap}, {size} - length(b.cur))),
                         strpos(right(a.cur, least({overlap}, {size} - length(b.cur))), sep)) END || b.cur}}
      ELSE {{'done': a.done, 'cur': a.cur || b.cur}} END,
    {{'done': []::VARCHAR[], 'cur': ''}}) AS f
  FROM {prefix}_piece
),
{prefix}_all AS (
  SELECT key, run, unnest(list_append(f.done, f.cur)) AS raw,
         generate_subscripts(list_append(f.done, f.cur), 1) AS j FROM {prefix}_fold
),
{prefix} AS (
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY run, j) - 1 AS no, trim(raw, {_BLANKS}) AS part
  FROM {prefix}_all WHERE trim(raw, {_BLANKS}) <> ''
)"""


def chunk_ctes(prefix: str, source: str, key: str, text: str) -> str:
    return split_ctes(prefix, source, key, text, CHUNK_SIZE, CHUNK_OVERLAP)


def page_ctes(prefix: str, source: str, key: str, text: str) -> str:
    return split_ctes(prefix, source, key, text, PAGE_SIZE, PAGE_OVERLAP)


COLLECTION = "corpus"
DATE = "1700000000000"
SOURCES_HEADING = "Responding based on the following sources:"
NO_SOURCES = (
    "No sources were found matching your query. Please refine your request to closer match "
    "the data in the database or ingest more data."
)
_NL2 = "chr(10)||chr(10)"

# text files as documents, one page each
_CORPUS = f"""
doc AS (
  SELECT {stable_id("'corpus'", "'plaintext'", "path", DATE)} AS doc_id, 'plaintext' AS type, path AS source,
         {DATE}::BIGINT AS ingest_date, n::VARCHAR || '.txt' AS filename, NULL::VARCHAR AS media_type,
         '.txt' AS extension, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content,
         text AS raw, n, lang
  FROM (SELECT '/corpus/' || source || '/' || doc_id || '.txt' AS path, doc_id AS n, text, lang FROM documents)
)"""

# stored pages as web documents, long ones in parts
_WEB = f"""
site AS (
  SELECT {stable_id("'corpus'", "'web'", "url", DATE)} AS doc_id, url, html,
    nullif(replace(replace(replace(replace(replace(replace(replace(
      regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '') AS title,
    nullif(regexp_extract(html, '(?is)<html[^>]*?\\slang\\s*=\\s*["'']?([^"''\\s>]+)', 1), '') AS language
  FROM pages
),
{page_ctes("part", "site", "doc_id", "html").lstrip()},
web_page AS (
  SELECT p.key || '/' || p.no AS page_id, p.key AS doc_id, 'web' AS type, p.no AS page_no, NULL::BIGINT AS page,
         s.title, s.language, s.url AS source, p.part AS content
  FROM part p JOIN site s ON s.doc_id = p.key
)"""

_TEXT_PAGE = """
text_page AS (
  SELECT doc_id || '/0' AS page_id, doc_id, type, 0::BIGINT AS page_no, NULL::BIGINT AS page, NULL::VARCHAR AS title,
         NULL::VARCHAR AS language, NULL::VARCHAR AS source, content FROM doc
)"""

_ALL_PAGE = "all_page AS (SELECT * FROM text_page UNION ALL SELECT * FROM web_page)"

_ALL_DOC = f"""
all_doc AS (
  SELECT doc_id, type, source, ingest_date, filename, media_type, extension FROM doc
  UNION ALL SELECT doc_id, 'web', url, {DATE}, NULL, NULL, NULL FROM site
)"""

_TEXT_CHUNK = chunk_ctes("chunk", "doc", "doc_id", "content")
_WEB_CHUNK = chunk_ctes("web_chunk", "web_page", "page_id", "content")

_CORPUS_BASE = f"{_CORPUS}, {_TEXT_PAGE}"
_ALL_BASE = f"{_CORPUS}, {_WEB}, {_TEXT_PAGE}, {_ALL_PAGE}, {_ALL_DOC}"


def _bins(name: str, source: str, keys: str, text: str) -> str:
    """Token counts per bin of a relation's texts."""
    return f"""
{name} AS (
  SELECT {keys}, ('0x' || substr(md5(lower(tok)), 1, 8))::UBIGINT % {VECTOR_DIM} AS bin, count(*) AS n
  FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+')) AS tok FROM {source})
  GROUP BY ALL
)"""


def _hits(query: str) -> str:
    """CTEs that end in ``hit(query_id, rank, score, doc_id, chunk_no, text)`` over the text chunks."""
    return f"""
{_CORPUS_BASE}, {_TEXT_CHUNK.lstrip()},
query AS ({query}),
{_bins("qbin", "query", "query_id", "user_input").lstrip()},
{_bins("cbin", "chunk", "key, no", "part").lstrip()},
qnorm AS (SELECT query_id, sum(n * n) AS q2 FROM qbin GROUP BY query_id),
cnorm AS (SELECT key, no, sum(n * n) AS c2 FROM cbin GROUP BY key, no),
dot AS (SELECT query_id, key, no, sum(q.n * c.n) AS d FROM qbin q JOIN cbin c USING (bin) GROUP BY ALL),
scored AS (
  SELECT query_id, key AS doc_id, no AS chunk_no,
         round((1 + d::DOUBLE / sqrt((c2 * q2)::DOUBLE)) / 2, 9) AS score
  FROM dot JOIN qnorm USING (query_id) JOIN cnorm USING (key, no)
),
hit AS (
  SELECT r.*, c.part AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS rank
    FROM scored WHERE score >= {MIN_SCORE}
  ) r JOIN chunk c ON c.key = r.doc_id AND c.no = r.chunk_no WHERE rank <= {REFERENCE_LIMIT}
)"""


_INPUTS = "SELECT item_id AS query_id, text AS user_input FROM benchmark"
_TURNS = "SELECT conv_id || '-' || turn AS query_id, text AS user_input FROM conversations WHERE role = 'user'"
_HITS = _hits(_INPUTS)

_DOC_LINK = """extension || ' file [' || filename || '](</files/corpus/' || type || '/' || doc_id || '>){target="_blank"}'"""
_ANSWER = f"""
answer AS (
  SELECT query_id, user_input, coalesce(n, 0) AS source_count, coalesce(context, '') AS context,
         CASE WHEN n > 0 THEN '{SOURCES_HEADING}' || {_NL2} || links ELSE '{NO_SOURCES}' END AS answer
  FROM query LEFT JOIN (
    SELECT query_id, count(*) AS n, string_agg(text, chr(10) ORDER BY rank) AS context,
           string_agg({_DOC_LINK} || {_NL2}, '' ORDER BY rank) AS links
    FROM hit JOIN doc USING (doc_id) GROUP BY query_id
  ) USING (query_id)
)"""

_REQUEST = """
request AS (
  SELECT item_id AS query_id, text AS user_input,
    CASE item_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'digest' ELSE 'locate' END AS task,
    CASE item_id % 3 WHEN 0 THEN 'State the requested fact with the passage that proves it.'
                     WHEN 1 THEN 'Condense the passages in three lines.' END AS task_prompt,
    CASE WHEN item_id % 2 = 0 THEN 'write as an archivist would.' || chr(10) || chr(10) ELSE '' END AS persona,
    CASE item_id % 4 WHEN 0 THEN chr(10) || chr(10) || 'List every date that is mentioned.'
      WHEN 1 THEN chr(10) || chr(10) || 'List every date that is mentioned.' || chr(10) || chr(10) || 'Say what the passages leave open.'
      WHEN 2 THEN chr(10) || chr(10) || 'Say what the passages leave open.' || chr(10) || chr(10) || 'List every date that is mentioned.'
      ELSE '' END AS enhancers,
    CASE WHEN item_id % 5 = 0 THEN chr(10) || chr(10) || 'Source file: About: ' || upper(text) ELSE '' END AS file
  FROM benchmark
)"""


def _prompt(context: str, task: str) -> str:
    return (f"persona || {task} || enhancers || {_NL2} || 'Context: ' || {context} || {_NL2} || 'User input: ' "
            "|| r.user_input || file")


def _keys(label: str) -> str:
    return f"SELECT doc_id FROM doc WHERE n IN (SELECT doc_id FROM labels WHERE {label} = 1)"


_USED_BINS = f"""len(list_distinct(list_transform(regexp_extract_all(part, '[\\p{{L}}\\p{{N}}]+'),
  lambda t: ('0x' || substr(md5(lower(t)), 1, 8))::UBIGINT % {VECTOR_DIM}))) AS used_bins"""

_DOC_COLUMNS = "doc_id, type, source, ingest_date, filename, media_type, extension"

_LISTED = """
counted AS (
  SELECT d.*, 'corpus.' || d.type AS index, coalesce(p.n, 0) AS page_count, coalesce(v.n, 0) AS vector_count
  FROM all_doc d
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM all_page GROUP BY 1) p USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM (
      SELECT key AS doc_id FROM chunk UNION ALL SELECT split_part(key, '/', 1) FROM web_chunk) GROUP BY 1) v USING (doc_id)
)"""
_LISTING_BASE = f"{_ALL_BASE}, {_TEXT_CHUNK.lstrip()}, {_WEB_CHUNK.lstrip()}, {_LISTED}"

def _all_hits(hashed: bool) -> str:
    """CTEs that end in ``hit`` over the chunks of files and web pages; hashed: in the buckets a query probes."""
    probing = f"""
sign AS (SELECT d AS bin, b, CASE WHEN substr(md5(d || ':' || b), 1, 1) < '8' THEN 1 ELSE -1 END AS s
         FROM range({VECTOR_DIM}) t(d), range({INDEX_BITS}) u(b)),
ccode AS (
  SELECT doc_id, page_no, chunk_no, sum(CASE WHEN side > 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM (
    SELECT doc_id, page_no, chunk_no, b, sum(n * s) AS side FROM cbin JOIN sign USING (bin) GROUP BY ALL) GROUP BY ALL
),
qside AS (SELECT query_id, b, sum(n * s) AS side FROM qbin JOIN sign USING (bin) GROUP BY ALL),
qcode AS (SELECT query_id, sum(CASE WHEN side > 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM qside GROUP BY ALL),
odds AS (SELECT query_id, b, 1.702::DOUBLE * abs(side) / sqrt(q2::DOUBLE) * cosine / sqrt(1 - cosine * cosine) AS o
         FROM qside JOIN qnorm USING (query_id), (SELECT 2 * {MIN_SCORE}::DOUBLE - 1 AS cosine)),
chance AS (
  SELECT query_id, f, round(exp(sum(-ln(1 + exp(-o)) - CASE WHEN (f >> b) & 1 = 1 THEN o ELSE 0 END)), 12) AS p
  FROM odds, range({1 << INDEX_BITS}) t(f) GROUP BY query_id, f
),
probe AS (
  SELECT query_id, xor(code, f) AS code FROM (
    SELECT query_id, f, coalesce(sum(p) OVER (PARTITION BY query_id ORDER BY p DESC, f
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chance
  ) JOIN qcode USING (query_id) WHERE round(before, 9) < {RECALL}
),""" if hashed else ""
    within = "JOIN ccode USING (doc_id, page_no, chunk_no) JOIN probe USING (query_id, code)" if hashed else ""
    return f"""
{_ALL_BASE}, {_TEXT_CHUNK.lstrip()}, {_WEB_CHUNK.lstrip()},
every_chunk AS (
  SELECT 'plaintext' AS type, key AS doc_id, 0 AS page_no, no AS chunk_no, part FROM chunk
  UNION ALL SELECT 'web', split_part(key, '/', 1), split_part(key, '/', 2)::BIGINT, no, part FROM web_chunk
),
query AS ({_INPUTS}),
{_bins("qbin", "query", "query_id", "user_input").lstrip()},
{_bins("cbin", "every_chunk", "doc_id, page_no, chunk_no", "part").lstrip()},
qnorm AS (SELECT query_id, sum(n * n) AS q2 FROM qbin GROUP BY query_id),
cnorm AS (SELECT doc_id, page_no, chunk_no, sum(n * n) AS c2 FROM cbin GROUP BY ALL),
dot AS (SELECT query_id, doc_id, page_no, chunk_no, sum(q.n * c.n) AS d FROM qbin q JOIN cbin c USING (bin) GROUP BY ALL),
{probing}
scored AS (
  SELECT query_id, doc_id, page_no, chunk_no, round((1 + d::DOUBLE / sqrt((c2 * q2)::DOUBLE)) / 2, 9) AS score
  FROM dot JOIN qnorm USING (query_id) JOIN cnorm USING (doc_id, page_no, chunk_no) {within}
),
hit AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, type, doc_id, page_no, chunk_no) AS rank
    FROM scored JOIN all_doc USING (doc_id) WHERE score >= {MIN_SCORE}
  ) WHERE rank <= {REFERENCE_LIMIT}
)"""


_CITED = f"""
cited AS (
  SELECT query_id, count(*) AS n, string_agg(CASE WHEN hit.type = 'web' THEN 'Web page: <' || hit.source
      || '>{{target="_blank"}} scraped {DATE} from parent URL <' || hit.source || '>{{target="_blank"}}'
      ELSE '.txt file [' || filename || '](</files/corpus/plaintext/' || doc_id || '>){{target="_blank"}}' END || {_NL2}, ''
      ORDER BY rank) AS links FROM hit GROUP BY query_id
)
SELECT query_id, coalesce(n, 0) AS source_count,
  CASE WHEN n > 0 THEN '{SOURCES_HEADING}' || {_NL2} || links ELSE '{NO_SOURCES}' END AS answer
FROM query LEFT JOIN cited USING (query_id)"""

_PAGED = f"""
WITH file AS (
  SELECT *, lang = 'fr' AND contains(text, chr(10)) AS paged,
    '/corpus/' || source || '/' || doc_id || CASE WHEN lang = 'fr' THEN '.pdf' ELSE '.txt' END AS path FROM documents
),
french AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM file WHERE paged),
keyed AS (SELECT doc_id || ':' || line_no AS k, x FROM french),
{page_ctes("part", "keyed", "k", "x").lstrip()},
placed AS (
  SELECT split_part(key, ':', 1)::BIGINT AS doc_id, split_part(key, ':', 2)::BIGINT AS page, part,
         row_number() OVER (PARTITION BY split_part(key, ':', 1) ORDER BY split_part(key, ':', 2)::BIGINT, no) - 1 AS page_no
  FROM part),
paged_row AS (
  SELECT path, 'pdf' AS type, page_no, page, part AS content FROM file LEFT JOIN placed USING (doc_id) WHERE paged
  UNION ALL
  SELECT path, 'plaintext', 0, NULL, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) FROM file WHERE NOT paged
)"""

ORACLES = {
    "collection_listing": f"""WITH {_LISTING_BASE}
SELECT doc_id, index, source, page_count, vector_count FROM counted WHERE doc_id NOT IN ({_keys('toxic')})""",
    "stored_search": f"WITH {_all_hits(False)}, {_CITED}",
    "stored_search_hashed": f"WITH {_all_hits(True)}, {_CITED}",
    "list_documents_page": f"""WITH {_LISTING_BASE}
SELECT doc_id, source, page_count, vector_count FROM counted ORDER BY source, doc_id LIMIT 100 OFFSET 100""",
    "ingest_duplicates": f"""WITH {_CORPUS}, {_WEB}, {_WEB_CHUNK.lstrip()},
doubled AS (SELECT 'a' || n AS k, source, content FROM doc
  UNION ALL SELECT 'b' || n, source, CASE WHEN lang = 'de' THEN 'again' || chr(10) ELSE '' END || content FROM doc),
{chunk_ctes("twin", "doubled", "k", "content").lstrip()}
SELECT 'plaintext' AS type, source, 2 AS documents, 2 AS pages, count(twin.key) AS vectors
FROM doubled LEFT JOIN twin ON twin.key = doubled.k GROUP BY source
UNION ALL
SELECT 'web', url, 2, 2 * p.n, 2 * c.n FROM site
JOIN (SELECT doc_id, count(*) AS n FROM web_page GROUP BY 1) p USING (doc_id)
JOIN (SELECT split_part(key, '/', 1) AS doc_id, count(*) AS n FROM web_chunk GROUP BY 1) c USING (doc_id)""",
    "scan_folder": """
SELECT CASE doc_id % 7 WHEN 1 THEN '.' WHEN 2 THEN '_' ELSE '' END || doc_id || '.txt' AS name,
  CASE WHEN doc_id % 10 = 0 THEN 0 ELSE octet_length(encode(text)) END AS bytes,
  sha256(CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END) AS content_sha256 FROM documents""",
    "paged_scan": f"""{_PAGED}
SELECT path AS source, type, page_no, page, content FROM paged_row""",
    "page_citations": f"""{_PAGED},
known AS (SELECT *, {stable_id("'corpus'", "type", "path", DATE)} AS id, regexp_extract(path, '([^/]+)$', 1) AS fname,
            length(path) % 5 = 0 AS feed FROM paged_row WHERE page_no IS NOT NULL)
SELECT path AS source, page_no,
  CASE WHEN feed THEN 'feed type document from ' || path
    WHEN type = 'pdf' THEN 'PDF File: [page ' || page || ' of ' || fname || '](</files/corpus/pdf/' || id || '#page=' || page || '>){{target="_blank"}}'
    ELSE regexp_extract(fname, '([.][a-z]+)$', 1) || ' file [' || fname || '](</files/corpus/plaintext/' || id || '>){{target="_blank"}}' END AS link,
  CASE WHEN feed THEN 'feed type document from ' || path
    WHEN type = 'pdf' THEN 'PDF File: [' || fname || '](</files/corpus/pdf/' || id || '>){{target="_blank"}}'
    ELSE regexp_extract(fname, '([.][a-z]+)$', 1) || ' file [' || fname || '](</files/corpus/plaintext/' || id || '>){{target="_blank"}}' END AS document,
  CASE WHEN type = 'pdf' AND NOT feed THEN '   PDF File: page ' || page || ' of ' || path END AS plain
FROM known""",
    "zero_page_documents": """
SELECT '/corpus/' || source || '/' || doc_id || '.scan' AS source, 0::BIGINT AS page_count, 0::BIGINT AS vector_count
FROM documents WHERE lang = 'es'""",
    "display_names": """
SELECT '/corpus/' || source || '/' || doc_id || '.txt' AS source,
  CASE WHEN doc_id % 2 = 0 THEN 'Upload ' || doc_id ELSE doc_id || '.txt' END AS filename FROM documents""",
    "template_files": """
SELECT CASE WHEN item_id % 2 = 0 THEN 'task' ELSE 'persona' END AS kind, 'item-' || item_id AS name,
  'Item ' || item_id AS greeting, CASE WHEN item_id % 3 > 0 THEN text END AS prompt FROM benchmark""",
    "source_files": """
SELECT conv_id || '-' || turn AS query_id, CASE WHEN turn % 3 > 0 THEN text END AS source_file
FROM conversations WHERE role = 'user'""",
    "stream_progress": f"""WITH {_CORPUS}, {_TEXT_CHUNK}
SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) AS pages, count(key) AS chunks, 0 AS rejected
FROM doc LEFT JOIN chunk ON key = doc_id GROUP BY n % 4""",
    "strip_html": """
WITH t AS (SELECT url, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
  '<[^>]*>', '', 'g') AS t FROM pages)
SELECT url, regexp_replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS text
FROM t""",
    "rag_answers_resumed": f"""WITH {_HITS}, {_ANSWER}, {_REQUEST},
asked AS (SELECT query_id, CASE WHEN source_count > 0 THEN {_prompt("context", "task_prompt")} END AS prompt
          FROM answer a JOIN request r USING (query_id)),
early AS (SELECT DISTINCT prompt FROM asked WHERE query_id % 2 = 0)
SELECT query_id, CASE WHEN prompt IS NOT NULL THEN 200 END AS status,
  length(prompt) || ' characters in job ' || CASE WHEN prompt IN (SELECT prompt FROM early WHERE prompt IS NOT NULL) THEN 1 ELSE 2 END AS response
FROM asked""",
    "drop_collection": f"""
SELECT 'kept' AS collection, 'document_vector' AS vector_column, {VECTOR_DIM} AS dim, count(*) AS documents FROM pages""",
    "list_collections": f"""
SELECT 'texts' AS collection, 'document_vector' AS vector_column, {VECTOR_DIM} AS dim, count(*) AS documents FROM documents
UNION ALL SELECT 'sites', 'document_vector', {VECTOR_DIM}, count(*) FROM pages""",
    "batch_replace": f"""WITH {_LISTING_BASE}
SELECT doc_id, source, page_count, vector_count FROM counted WHERE type = 'plaintext'""",
    "rejected_files": """
SELECT '/corpus/' || source || '/' || doc_id || '.txt' AS source, 'no loader takes such a file' AS reason
FROM documents WHERE lang = 'de'""",
    "stream_ingest": f"""WITH {_LISTING_BASE}
SELECT doc_id, source, page_count, vector_count FROM counted WHERE type = 'plaintext'""",
    "stream_prompts": f"""WITH {_HITS}, {_ANSWER}, {_REQUEST}
SELECT query_id, source_count, CASE WHEN source_count > 0 THEN {_prompt("context", "task_prompt")} END AS prompt
FROM answer a JOIN request r USING (query_id)""",
    "rag_answers": f"""WITH {_HITS}, {_ANSWER}, {_REQUEST},
asked AS (SELECT query_id, answer, CASE WHEN source_count > 0 THEN length({_prompt("context", "task_prompt")}) END AS n
          FROM answer a JOIN request r USING (query_id))
SELECT query_id, CASE WHEN n < 1500 THEN 200 WHEN n >= 1500 THEN 413 END AS status,
  answer || CASE WHEN n < 1500 THEN n || ' characters' WHEN n >= 1500 THEN 'ollama status: 413' ELSE '' END AS answer
FROM asked""",
    "loader_dispatch": f"""
WITH file AS (
  SELECT *, lang = 'fr' AND contains(text, chr(10)) AS paged,
    '/corpus/' || source || '/' || doc_id || CASE WHEN lang = 'fr' THEN '.pdf' ELSE '.txt' END AS path FROM documents
),
french AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM file WHERE paged),
keyed AS (SELECT doc_id || ':' || line_no AS k, x FROM french),
{page_ctes("part", "keyed", "k", "x").lstrip()},
counted AS (SELECT split_part(key, ':', 1)::BIGINT AS doc_id, count(*) AS pages FROM part GROUP BY 1)
SELECT {stable_id("'corpus'", "CASE WHEN paged THEN 'pdf' ELSE 'plaintext' END", "path", DATE)} AS doc_id,
  CASE WHEN paged THEN 'pdf' ELSE 'plaintext' END AS type, path AS source,
  regexp_extract(path, '([^/]+)$', 1) AS filename, CASE WHEN paged THEN 'application/pdf' END AS media_type,
  CASE WHEN NOT paged THEN regexp_extract(path, '([.][a-z]+)$', 1) END AS extension,
  CASE WHEN paged THEN coalesce(pages, 0) ELSE 1 END AS pages
FROM file LEFT JOIN counted USING (doc_id)""",
    "load_plaintext": f"WITH {_CORPUS} SELECT {_DOC_COLUMNS}, content FROM doc",
    "load_web_pages": f"""WITH {_WEB}
SELECT doc_id, type, source AS doc_source, {DATE}::BIGINT AS ingest_date, page_no, title, language, source, content
FROM web_page""",
    "ingest_url_list": f"""SELECT {stable_id("'corpus'", "'web'", "url", DATE)} AS doc_id, 'web' AS type, url AS source,
  {DATE}::BIGINT AS ingest_date, NULL::VARCHAR AS filename, NULL::VARCHAR AS media_type, NULL::VARCHAR AS extension
FROM pages WHERE url <> ''""",
    "extract_links": """
WITH w AS (SELECT DISTINCT url, regexp_replace(unnest(regexp_extract_all(html,
    '(?i)\\bhref\\s*=\\s*(?:"[^"]*|''[^'']*|[^"''\\s>]+)')), '(?i)^href\\s*=\\s*["'']?\\s*', '') AS link FROM pages),
l AS (SELECT DISTINCT url, rtrim(split_part(replace(link, '&amp;', '&'), '#', 1)) AS link FROM w)
SELECT DISTINCT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
  WHEN starts_with(link, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || link
  WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link
  ELSE regexp_extract(url, '^([^?#]*/)', 1) || link END AS target
FROM l WHERE link <> '' AND (regexp_matches(link, '(?i)^https?:') OR NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:'))
  AND NOT regexp_matches(link, '[.](css|js|ico|png|jpg|jpeg|gif|svg|csv|bz2|zip|epub)$')""",
    "crawl_reachable": """
WITH RECURSIVE site AS (SELECT page_id FROM pages),
reach AS (
  SELECT 0::BIGINT AS n, 1 AS depth FROM site WHERE page_id = 0
  UNION ALL
  SELECT t.page_id, depth + 1 FROM reach JOIN site t ON t.page_id IN (2 * n + 1, 2 * n + 2)
)
SELECT 'http://site.example/p/' AS root, 'http://site.example/p/' AS url, 0 AS depth
UNION ALL SELECT 'http://site.example/p/', 'http://site.example/p/' || n, depth FROM reach""",
    "ingest_documents": f"WITH {_CORPUS} SELECT {_DOC_COLUMNS} FROM doc",
    "ingest_binaries": f"""WITH {_CORPUS}
SELECT doc_id, type, lower(hex(encode(raw))) AS data_hex, 'text/plain' AS media_type FROM doc WHERE raw <> ''""",
    "ingest_pages": f"WITH {_ALL_BASE} SELECT * FROM all_page",
    "ingest_chunks": f"""WITH {_CORPUS}, {_TEXT_CHUNK}
SELECT key || '/0' AS page_id, key AS doc_id, 0::BIGINT AS page_no, no AS chunk_no, part AS text,
  {VECTOR_DIM} AS dim, {_USED_BINS} FROM chunk""",
    "ingest_web_chunks": f"""WITH {_WEB}, {_WEB_CHUNK.lstrip()}
SELECT key AS page_id, split_part(key, '/', 1) AS doc_id, split_part(key, '/', 2)::BIGINT AS page_no, no AS chunk_no,
  part AS text, {VECTOR_DIM} AS dim, {_USED_BINS} FROM web_chunk""",
    "ingest_progress": f"""WITH {_ALL_BASE}
SELECT doc_id, page_no + 1 AS done, count(*) OVER (PARTITION BY doc_id) AS total FROM all_page""",
    "chunk_text": f"WITH {chunk_ctes('chunk', 'documents', 'doc_id', 'text')} "
                  "SELECT key AS doc_id, no AS chunk_no, part AS chunk FROM chunk",
    "split_pages": f"WITH {page_ctes('part', 'documents', 'doc_id', 'text')} "
                   "SELECT key AS doc_id, no AS part_no, part FROM part",
    "embed_hash": f"WITH {_bins('b', 'documents', 'doc_id', 'text')} SELECT doc_id, bin, n AS weight FROM b",
    "path_parts": """
WITH p AS (SELECT regexp_extract(url, '^([^?#]*)', 1) AS path FROM pages
           UNION ALL SELECT '/corpus/' || source || '/' || doc_id || '.txt' FROM documents)
SELECT path, regexp_extract(path, '([^/]+)/*$', 1) AS name,
  regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^[.]*[^.].*([.][^.]*)$', 1) AS extension FROM p""",
    "is_text_content": "SELECT doc_id, lang NOT IN ('de', 'es', 'fr') AS is_text FROM documents",
    "valid_names": """
WITH n AS (SELECT c_name AS name FROM customer UNION SELECT source FROM documents
           UNION SELECT '_' || lang FROM documents UNION SELECT '-' || role FROM conversations
           UNION SELECT lower(url) FROM pages)
SELECT name, name = lower(name) AND name <> '' AND left(name, 1) NOT IN ('_', '-', '+', '.')
  AND NOT regexp_matches(name, '[\\s/\\\\*?"<>|,#:@\\[\\]{}=]') AS valid FROM n""",
    "doc_links": f"""WITH {_CORPUS}
SELECT doc_id, '/files/corpus/plaintext/' || doc_id AS url, {_DOC_LINK} AS link FROM doc
UNION ALL SELECT id, '/files/corpus/web/' || id, 'Web page: <' || url || '>{{target="_blank"}}'
FROM (SELECT {stable_id("'corpus'", "'web'", "url", DATE)} AS id, url FROM pages)""",
    "page_links": f"""WITH {_ALL_BASE}
SELECT doc_id, page_no, CASE WHEN type = 'web' THEN 'Web page: <' || p.source || '>{{target="_blank"}} scraped {DATE} from parent URL <'
    || d.source || '>{{target="_blank"}}' ELSE {_DOC_LINK} END AS link,
  CASE WHEN type = 'web' THEN '   Web page: ' || p.source || ' scraped {DATE}, top level URL: ' || d.source END AS plain
FROM all_page p JOIN all_doc d USING (type, doc_id)""",
    "semantic_search": f"""WITH {_hits(_TURNS)}
SELECT query_id, rank, score, doc_id, 0::BIGINT AS page_no, chunk_no, text FROM hit""",
    "knn_dense": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, list_inner_product(e, e) AS s FROM v),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, round((1 + list_inner_product(q.e, c.e) / sqrt(c.s * q.s)) / 2, 9) AS score
  FROM n q, n c
)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
               FROM scored WHERE score >= 0.65) WHERE rank <= 5""",
    "knn_lsh": f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, list_inner_product(e, e) AS s FROM v),
entry AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS d FROM v),
side AS (
  SELECT vec_id, b, sum(CASE WHEN substr(md5(d || ':' || b), 1, 1) < '8' THEN x ELSE -x END) AS side
  FROM entry, range({BITS}) t(b) GROUP BY vec_id, b
),
bucket AS (SELECT vec_id, sum(CASE WHEN side > 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM side GROUP BY vec_id),
odds AS (SELECT vec_id, b, 1.702::DOUBLE * abs(side) / sqrt(s) * cosine / sqrt(1 - cosine * cosine) AS o
         FROM side JOIN n USING (vec_id), (SELECT 2 * 0.65::DOUBLE - 1 AS cosine)),
chance AS (
  SELECT vec_id, f, round(exp(sum(-ln(1 + exp(-o)) - CASE WHEN (f >> b) & 1 = 1 THEN o ELSE 0 END)), 12) AS p
  FROM odds, range({1 << BITS}) t(f) GROUP BY vec_id, f
),
probe AS (
  SELECT query_id, xor(home.code, f) AS code FROM (
    SELECT vec_id AS query_id, f, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, f
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chance
  ) JOIN bucket home ON home.vec_id = query_id WHERE round(before, 9) < {RECALL}
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, round((1 + list_inner_product(q.e, c.e) / sqrt(c.s * q.s)) / 2, 9) AS score
  FROM probe JOIN bucket b USING (code) JOIN n c ON c.vec_id = b.vec_id JOIN n q ON q.vec_id = query_id
)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
               FROM scored WHERE score >= 0.65) WHERE rank <= 5""",
    "hits_with_pages": f"""WITH {_HITS}
SELECT query_id, rank, doc_id || '/0' AS page_id, chunk_no, p.doc_id AS page_doc_id FROM hit JOIN text_page p USING (doc_id)""",
    "hits_with_documents": f"""WITH {_HITS}
SELECT query_id, rank, doc_id, chunk_no, source, filename FROM hit JOIN doc USING (doc_id)""",
    "retrieval_sources": f"""WITH {_HITS}
SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context, count(*) AS sources,
  string_agg(source, chr(10) ORDER BY rank) AS source_list FROM hit JOIN doc USING (doc_id) GROUP BY query_id""",
    "build_context": f"""WITH {_HITS}
SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context, count(*) AS hits FROM hit GROUP BY query_id""",
    "distinct_hit_pages": f"WITH {_HITS} SELECT DISTINCT 'plaintext' AS type, doc_id || '/0' AS page_id FROM hit",
    "orphan_chunks": f"""WITH {_CORPUS}, {_TEXT_CHUNK}
SELECT 'plaintext' AS type, key || '/0' AS page_id, count(*) AS chunks FROM chunk
WHERE key IN ({_keys('toxic')}) GROUP BY key""",
    "prepare_prompts": f"""WITH {_REQUEST}
SELECT query_id, task, {_prompt("'Text number ' || query_id", "coalesce(task_prompt, 'Find this.')")} AS prompt FROM request r""",
    "rag_search_task": f"WITH {_HITS}, {_ANSWER} SELECT query_id, user_input, source_count, context, answer FROM answer",
    "rag_prompts": f"""WITH {_HITS}, {_ANSWER}, {_REQUEST}
SELECT query_id, source_count, CASE WHEN source_count > 0 THEN {_prompt("context", "task_prompt")} END AS prompt
FROM answer a JOIN request r USING (query_id)""",
    "no_source_queries": f"""WITH {_HITS}
SELECT query_id, '{NO_SOURCES}' AS answer FROM query WHERE query_id NOT IN (SELECT query_id FROM hit)""",
    "list_documents": f"""WITH {_LISTING_BASE}
SELECT doc_id, index, page_count, vector_count, 'id: ' || doc_id || ', source: ' || source || ', type: ' || type
  || ', pages: ' || page_count || ', vectors: ' || vector_count AS line FROM counted""",
    "page_counts": f"WITH {_ALL_BASE} SELECT type, doc_id, count(*) AS page_count FROM all_page GROUP BY ALL",
    "vector_counts": f"""WITH {_ALL_BASE}, {_TEXT_CHUNK.lstrip()}, {_WEB_CHUNK.lstrip()}
SELECT type, doc_id, count(*) AS vector_count FROM (SELECT 'plaintext' AS type, key AS doc_id FROM chunk
  UNION ALL SELECT 'web', split_part(key, '/', 1) FROM web_chunk) GROUP BY ALL""",
    "all_documents": f"WITH {_ALL_BASE} SELECT * FROM all_doc",
    "collection_sizes": "SELECT source AS collection, count(*) AS documents FROM documents GROUP BY source",
    "collection_rows": f"""WITH {_CORPUS_BASE}, {_TEXT_CHUNK}
SELECT doc_id, type, source, ingest_date, filename, NULL::VARCHAR AS page_id, NULL::BIGINT AS page_no, NULL::BIGINT AS chunk_no,
  NULL::VARCHAR AS text, NULL::INTEGER AS data_bytes, 'none' AS media_type FROM doc
UNION ALL SELECT doc_id, type, NULL, NULL, NULL, page_id, page_no, NULL, NULL, NULL, 'none' FROM text_page
UNION ALL SELECT key, 'plaintext', NULL, NULL, NULL, key || '/0', 0, no, part, NULL, 'none' FROM chunk
UNION ALL SELECT doc_id, type, NULL, NULL, NULL, NULL, NULL, NULL, NULL, octet_length(encode(raw)), 'text/plain'
FROM doc WHERE raw <> ''""",
    "exists_split": f"""WITH {_CORPUS_BASE}, {_TEXT_CHUNK}
SELECT 'plaintext' AS type, count(*) AS rows, 'chunk' AS kind FROM chunk
UNION ALL SELECT 'plaintext', count(*), 'page' FROM text_page""",
    "filter_terms": f"""WITH {_CORPUS}, {_TEXT_CHUNK}
SELECT key AS doc_id, 'plaintext' AS type, no AS chunk_no, part AS text FROM chunk
WHERE key = {stable_id("'corpus'", "'plaintext'", "'/corpus/src0/0.txt'", DATE)}""",
    "fetch_binary": f"""WITH {_CORPUS}
SELECT doc_id, type, lower(hex(encode(raw))) AS data_hex, 'text/plain' AS media_type FROM doc
WHERE raw <> '' AND doc_id IN ({_keys('quality')})""",
    "delete_documents": f"""WITH {_CORPUS}, {_TEXT_CHUNK}
SELECT key AS doc_id, no AS chunk_no, part AS text FROM chunk WHERE key NOT IN ({_keys('toxic')})""",
    "delete_count": f"""WITH {_CORPUS}, {_TEXT_CHUNK}
SELECT 'plaintext' AS type, doc_id, 1 + 1 + (raw <> '')::BIGINT + coalesce(n_chunks, 0) AS removed FROM doc
LEFT JOIN (SELECT key AS doc_id, count(*) AS n_chunks FROM chunk GROUP BY 1) USING (doc_id)
WHERE doc_id IN ({_keys('toxic')})""",
}
