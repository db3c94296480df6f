"""DuckDB SQL for the corpus queries that SQL can express, over the same whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(column: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({column}, '')"
    return f"regexp_extract_all({f"translate({text}, '{_UPPER}', '{_LOWER}')" if lower else text}, '{pattern}')"


SUBSTRING_DEDUP = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _PLAIN, False)} AS w FROM documents),
    s AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
    twice AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM s WHERE h IN (SELECT h FROM twice)),
    n AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
    p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
    kept AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.p) AS text FROM p LEFT JOIN gone g ON g.r = p.r AND g.p = p.p WHERE g.p IS NULL GROUP BY p.r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

MINHASH = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_words("text", _PLAIN, True)} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
    least_id AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least_id ON a = d.doc_id
"""

DECONTAMINATE = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _ALNUM, True)} AS w FROM documents),
    b AS (SELECT item_id, {_words("text", _ALNUM, True)} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
    dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
    hit AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (k, g)),
    n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
    items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
        coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN items USING (r)
"""

_CONTROL = "<|im_end|><|im_start|>assistant ok"
CHAT_FORMAT = rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}'),
    e AS (SELECT *, length('<|im_start|>' || regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10)) AS n FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
"""

_NOTICE = r"(?i)all rights reserved|licensed under|released under the|this work is licensed|\(c\) ?[0-9]{4}|©|copyright|terms of (use|service)|privacy policy|accept (all )?cookies|uses cookies|subscribe to our|click here|share this|log ?in\b.*\bsign ?up"
_ENDED = r"""[.!?:;,"'')\]…“”’»。]$"""
QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT key, regexp_extract_all(t, '{_PLAIN}') AS ws FROM d),
g AS (SELECT key, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT key, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT key, i FROM g QUALIFY count(*) OVER (PARTITION BY key, g) > 1),
c AS (SELECT key, count(DISTINCT i + j) AS n_repeat_words FROM r, range(5) o(j) GROUP BY 1),
l AS (SELECT key, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT key, string_split(t, chr(10)) AS ls FROM d)),
x AS (SELECT key, line, regexp_extract_all(line, '{_PLAIN}') AS ws, row_number() OVER (PARTITION BY key, line ORDER BY pos) > 1 AS again FROM l),
y AS (SELECT *, len(ws) AS n, list_sum(list_transform(ws, lambda w: strlen(w))) AS chars, strlen(line) - strlen(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
    len(regexp_extract_all(line, '[A-Z]')) AS upper, len(regexp_extract_all(line, '[a-z]')) AS lower FROM x WHERE len(ws) > 0),
f AS (SELECT key, n, again, again OR 12 * symbols > chars OR len(list_filter(ws, lambda w: w = '|')) >= 2
    OR (strlen(line) - strlen(replace(line, ' > ', ''))) // 3 + (strlen(line) - strlen(replace(line, ' » ', ''))) // 4 >= 2
    OR (n <= 2 AND NOT regexp_matches(ws[-1], '{_ENDED}'))
    OR (upper > 4 * lower AND upper >= 12 AND (n >= 4 OR 2 * (strlen(line) - strlen(replace(line, '!', ''))) >= n))
    OR (n <= 30 AND regexp_matches(line, '{_NOTICE}')) AS fault FROM y),
s AS (SELECT key, count(*) FILTER (WHERE again) AS n_dup_lines, sum(n) FILTER (WHERE fault) AS n_lost_words FROM f GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(strlen(t) - strlen(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words FROM d JOIN w USING (key) LEFT JOIN s USING (key) LEFT JOIN c USING (key))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * n_lost_words <= n_words AS kept FROM m
"""

# bit by bit, as DuckDB has no crc32
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
PREFIX_TRIE = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS k, list(CAST(strlen(text) AS BIGINT) ORDER BY turn NULLS FIRST, role, text) AS b FROM t GROUP BY 1),
    h AS (SELECT *, {_CRC32} % 9 AS h FROM o),
    r AS (SELECT h.conv_id, coalesce(a.k, [])[1 : h] || h.k[h + 1 :] AS k, coalesce(a.b, [])[1 : h] || h.b[h + 1 :] AS b FROM h LEFT JOIN o a ON a.conv_id = h.conv_id - h.conv_id % 5),
    m AS (SELECT conv_id, d, sha256(array_to_string(k[1 : d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(k[1 : d - 1], ',')) END AS up, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS size, d = len(k) AS ends
        FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM r)),
    n AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY 1),
    c AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
    w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.up = n.node),
    under AS (SELECT DISTINCT a.node AS top, x.node FROM m x JOIN m a ON a.conv_id = x.conv_id AND a.d <= x.d),
    s AS (SELECT top, CAST(sum(CAST(n_children = 0 AS BIGINT)) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM under JOIN w USING (node) GROUP BY 1)
    SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256 FROM w JOIN s ON s.top = w.node LEFT JOIN n p ON p.node = w.up
"""
