"""SQL for whole results of operators whose contracts fix them, written from the contracts and not from the operators.

These are brute force: all pairs inside a label, shared shingles, every 50-byte window, every word window. They are meant
for small tables.
"""

# Components of the links ``pairs`` (a, b; both ways) by closure.
_CLOSURE = """
reach AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least_id AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""

OP1_SQL = f"""WITH RECURSIVE
sound AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
{_CLOSURE},
linked AS (SELECT a, count(*) AS links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(links, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
  coalesce(low, e.vec_id) >= e.vec_id AS kept
FROM embeddings e LEFT JOIN linked ON e.vec_id = linked.a LEFT JOIN least_id ON e.vec_id = least_id.a"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""WITH RECURSIVE
words AS (SELECT doc_id, {_WORDS.format(text=_LOWERED)} AS w FROM documents WHERE text IS NOT NULL),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sized AS (SELECT doc_id, s, n FROM shingles JOIN sizes USING (doc_id)),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS common
  FROM sized x JOIN sized y ON x.s = y.s AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
pairs AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (n + m - common)),
{_CLOSURE}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  coalesce(low, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id ON d.doc_id = least_id.a"""

# Positions count from 0; a window is 100 digits of the text in hex, cut from pieces of 500 windows.
OP4_SQL = """WITH
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, start, substr(h, 2 * start + 1, 1098) AS piece
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 500)) AS start FROM bytes)),
windows AS (SELECT doc_id, start + i AS i, substr(piece, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, start, piece, unnest(range(0, len(piece) // 2 - 49)) AS i FROM pieces)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i, lag(i) OVER w AS past, lead(i) OVER w AS next
  FROM windows JOIN firsts USING (s) WHERE first < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, sum(least(50, coalesce(next - i, 50))) AS removed,
  count(*) FILTER (past IS NULL OR past + 50 < i) AS n, max(i) + 50 AS last,
  list({'from': coalesce(past + 50, 0), 'to': i} ORDER BY i) FILTER (past IS NULL OR past + 50 < i) AS between
  FROM hits GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(from_hex(coalesce(
    array_to_string(list_transform(between, lambda g: substr(h, 2 * g['from'] + 1, 2 * (g['to'] - g['from']))), '')
    || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM bytes LEFT JOIN spans USING (doc_id)"""


def _repeated(width: int) -> str:
    """Words that stand in windows of ``width`` words found twice or more in their text."""
    return f"""
all{width} AS (SELECT doc_id, i, w[i : i + {width - 1}] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM words)),
twice{width} AS (SELECT doc_id, i, s FROM all{width} QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
inside{width} AS (SELECT doc_id, CAST(sum(least({width}, ahead)) AS BIGINT) AS n FROM (
  SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {width}) AS ahead FROM twice{width}) GROUP BY doc_id)"""


# A repeat of 6 words or more is a run of equal 6-word windows at one distance, 5 words longer than the run.
OP8_SQL = f"""WITH
words AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
{_repeated(8)},
{_repeated(6)},
equal_at AS (SELECT x.doc_id, y.i - x.i AS apart, x.i FROM twice6 x JOIN twice6 y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
runs AS (SELECT doc_id, apart, i - row_number() OVER (PARTITION BY doc_id, apart ORDER BY i) AS run FROM equal_at),
longest AS (SELECT doc_id, max(n) + 5 AS n FROM (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id, apart, run) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
again AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n FROM (
  SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY doc_id),
measured AS (SELECT words.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(again.n, 0) AS n_dup_lines,
  coalesce(inside8.n, 0) AS n_repeat_words, coalesce(inside6.n, 0) AS covered_words, coalesce(longest.n, 0) AS longest_repeat
  FROM words LEFT JOIN again USING (doc_id) LEFT JOIN inside8 USING (doc_id) LEFT JOIN inside6 USING (doc_id) LEFT JOIN longest USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND 100 * covered_words <= 30 * n_words AND longest_repeat <= 100 AS kept FROM based"""
