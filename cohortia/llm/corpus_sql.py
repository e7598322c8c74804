"""SQL for the operators whose contracts are exact: what DuckDB must answer on the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM payloads
), bits AS (
  SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(hex, CAST(1 + 5 * g AS INT), 5) AS BIGINT)) AS v,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc
  FROM firsts
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: abc[1 + (x >> 15)] || abc[1 + ((x >> 10) & 31)] || abc[1 + ((x >> 5) & 31)] || abc[1 + (x & 31)]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""


def _near(shingle: int, percent: int, kept: str) -> str:
    words = [chr(ord("a") + d) for d in range(shingle)]
    led = ", ".join(f"lead(word, {d}) OVER o AS {w}" for d, w in enumerate(words) if d)
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs
), led AS (
  SELECT doc_id, i, word AS a, {led} FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), shingles AS (
  SELECT DISTINCT doc_id, concat_ws(' ', {', '.join(words)}) AS s FROM led WHERE {words[-1]} IS NOT NULL OR i = 1
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= {percent} * (x.n + y.n - shared.n)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), named AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{kept}
FROM docs LEFT JOIN sizes USING (doc_id) JOIN named USING (doc_id)
"""


OP5 = _near(3, 85, ", doc_id = component_id AS kept")
OP13 = _near(4, 85, "")

OP6 = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), strings AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM docs WHERE n >= 100)
), firsts AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM strings
), later AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM firsts WHERE r > 1
), numbered AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY ALL
), pieces AS (
  SELECT r.doc_id, r.a, r.b, substr(h, 2 * coalesce(lag(r.b) OVER o, 0) + 1, 2 * (r.a - coalesce(lag(r.b) OVER o, 0))) AS before, h
  FROM runs r JOIN docs USING (doc_id) WINDOW o AS (PARTITION BY r.doc_id ORDER BY r.a)
), cut AS (
  SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(before, '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM pieces GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""

def _gram(size: int) -> str:
    return f"SELECT k, i, {size} AS size, concat_ws(' ', {', '.join(f'w{d}' for d in range(size))}) AS s FROM led WHERE w{size - 1} IS NOT NULL AND {size} IN (SELECT size FROM windows)"


OP8 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, {_ALNUM} AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS name, {_ALNUM} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT name, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT name, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), words AS (
  SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs
), led AS (
  SELECT k, i, word AS w0, {", ".join(f"lead(word, {d}) OVER o AS w{d}" for d in range(1, 10))} FROM words WINDOW o AS (PARTITION BY k ORDER BY i)
), grams AS (
  {" UNION ALL ".join(map(_gram, range(1, 11)))}
), hits AS (
  SELECT k, i, size, name FROM grams JOIN windows USING (size, s)
), covered AS (
  SELECT k, count(*) AS n FROM (SELECT DISTINCT k, unnest(range(i, i + size)) AS p FROM hits) GROUP BY k
), named AS (
  SELECT k, list_sort(list(DISTINCT name)) AS names FROM hits GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(names), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (k) LEFT JOIN named USING (k)
"""

#: CRC-32 byte by byte: a common table ``crc`` of its table ``t``, and the checksum of an ASCII string beside it.
CRC_TABLE = """crc AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"""


def crc32_sql(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: xor(crc.t[(xor(a, b) & 255) + 1], a >> 8), 4294967295))"
