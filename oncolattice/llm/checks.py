"""DuckDB SQL for the results of those queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"list_filter(string_split_regex({text}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
ALNUM = r"regexp_extract_all({text}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {SPACED.format(text="coalesce(text, '')")} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws) - 4)) AS p, ws FROM d WHERE len(ws) >= 6),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[p + 1:p + 5], ' ')) AS n FROM w),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM g, range(5) AS t(k) WHERE g.n > 1 GROUP BY doc_id),
f AS (SELECT d.doc_id, d.text, ws, ls, len(ws)::BIGINT AS n_words, length(translate(d.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > len(ls) OR word_chars < 2 * n_words
            OR (word_chars > 15 * n_words AND 3 * (length(text) - length(regexp_replace(text, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}\p{{Tibetan}}]', '', 'g'))) < word_chars)
            OR 10 * (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g'))) > 4 * word_chars
            OR 2 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) < n_words 
            OR 20 * coalesce(list_sum(list_transform(range(0, len(ws), 200), lambda i: len(list_distinct(ws[i + 1:i + 200])))), 0) < n_words) AS kept
FROM b"""

OP6 = rf"""
WITH dl AS (SELECT doc_id, {ALNUM.format(text=_lower("text"))} AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM dl),
bl AS (SELECT item_id, {ALNUM.format(text=_lower("text"))} AS ws FROM benchmark),
win AS (SELECT item_id, k, ws[k + 1:k + least(10, len(ws))] AS ws, least(10, len(ws)) AS n
        FROM (SELECT item_id, ws, unnest(range(greatest(1, len(ws) - 9))) AS k FROM bl WHERE len(ws) > 0)),
gram AS (SELECT doc_id, p, n, array_to_string(ws[p + 1:p + n], ' ') AS g
         FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS p FROM dl, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, p, gram.n, item_id FROM gram JOIN win ON g = array_to_string(ws, ' ') AND gram.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM hit, range(10) AS t(k) WHERE k < hit.n GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM hit GROUP BY doc_id),
freq AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
term AS (SELECT item_id, k, n, unnest(ws) AS w, unnest(range(n)) AS o FROM win),
rare AS (SELECT item_id, k, any_value(n) AS n, arg_min(w, (f, o)) AS w, arg_min(o, (f, o)) AS o
         FROM (SELECT term.*, coalesce(freq.n, 0) AS f FROM term LEFT JOIN freq USING (w)) GROUP BY item_id, k HAVING min(f) > 0),
anchor AS (SELECT item_id, k, n, o, doc_id, pos FROM rare JOIN dw USING (w)),
need AS (SELECT a.item_id, a.k, a.doc_id, a.pos, t.o, t.w FROM anchor a JOIN term t ON t.item_id = a.item_id AND t.k = a.k AND t.o <> a.o),
met AS (SELECT n.item_id, n.k, n.doc_id, n.pos, count(DISTINCT n.o) AS m FROM need n
        JOIN dw d ON d.doc_id = n.doc_id AND d.w = n.w AND d.pos BETWEEN n.pos - 20 AND n.pos + 20 GROUP BY ALL),
close AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM (SELECT a.* FROM anchor a LEFT JOIN met m ON m.item_id = a.item_id AND m.k = a.k
          AND m.doc_id = a.doc_id AND m.pos = a.pos WHERE coalesce(m.m, 0) = a.n - 1) GROUP BY doc_id)
SELECT dl.doc_id, len(dl.ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items.l, ','), '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated,
       coalesce(close.n, 0)::BIGINT AS n_near_items
FROM dl LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN close USING (doc_id)"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED.format(text=_lower("text"))} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(greatest(1, len(ws) - 2)), lambda i: array_to_string(ws[i + 1:i + 3], ' '))) AS ss FROM d WHERE len(ws) > 0),
g AS (SELECT doc_id, unnest(ss) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.ss) + len(y.ss) - n)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM u UNION SELECT reach.doc_id, u.b FROM reach JOIN u ON u.a = reach.r),
c AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(s.ss), 0)::BIGINT AS n_shingles, coalesce(c.r, d.doc_id) AS component_id, coalesce(c.r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)"""

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
x AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
n AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS first FROM x),
k AS (SELECT doc_id, i, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY doc_id, k),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
piece AS (SELECT doc_id, before AS a, t.a AS b FROM t
          UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), any_value(length(h) // 2) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256 FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM d LEFT JOIN c USING (doc_id) JOIN kept USING (doc_id)"""

def _assigned(k: int) -> str:
    """Nearest entry of codebook b{k} for every part: distance and index in one number, so that ties go to the lower index."""
    return f"""
a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, best // 1000 AS err, CAST(best % 1000 AS INT) AS entry FROM (
    SELECT p.vec_id, p.label, p.part, p.x, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.c[i]) * (p.x[i] - b.c[i])))::BIGINT * 1000 + b.entry) AS best
    FROM parts p JOIN b{k} b USING (part) GROUP BY ALL))"""


def _replaced(k: int) -> str:
    """Codebook b{k + 1}: floored means of the parts of an entry; unused entries stay."""
    return f"""
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS c FROM (
        SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS mean 
        FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY part, entry, i)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""


OP12 = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts
    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_assigned(0)}, {_replaced(0)}, {_assigned(1)}, {_replaced(1)}, {_assigned(2)},
rows_of AS (SELECT vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(err)::BIGINT AS error FROM a2 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows_of, books"""

ORACLE = {"op3_quality_rules": OP3, "op6_benchmark_decontamination": OP6, "op7_minhash_near_dedup": OP7, "op10_suffix_array_dedup": OP10,
          "op12_vector_codes": OP12}
