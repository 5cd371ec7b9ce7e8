"""The operators that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WHITE = "[^\\x20\\x09-\\x0D]+"

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0),
tests AS (
    SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
    FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
),
windows AS (
    SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
    FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM tests)
    )
),
hits AS (SELECT doc_id, i, size, item_id FROM windows JOIN tests USING (size, win)),
hit AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
),
found AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
    sha256(coalesce(found.items, '')) AS items_sha256,
    coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WHITE}') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_hold AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM both_hold o JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * o.n >= 85 * (x.n + y.n - o.n)
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, least(doc_id, coalesce(least_reached, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS least_reached FROM reach GROUP BY a) USING (doc_id)
"""

REPEATS = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WHITE}') AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)
),
owners AS (SELECT win, min(doc_id) AS owner FROM windows GROUP BY win),
gone AS (
    SELECT doc_id, list(DISTINCT p) AS gone
    FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN owners USING (win) WHERE owner < doc_id)
    GROUP BY doc_id
),
flat AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs
),
kept AS (
    SELECT f.doc_id, string_agg(word, ' ' ORDER BY f.p) AS kept
    FROM flat f LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM gone) g ON f.doc_id = g.doc_id AND f.p = g.p
    WHERE g.p IS NULL GROUP BY f.doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# crc32 of the decimal id, bit by bit.
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda c, step: xor(c >> 1, 3988292384 * (c & 1)))
), 4294967295::BIGINT)"""

CONVERSATIONS = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (
    SELECT conv_id, r, x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(r), ':', r, x))) AS p
    FROM turns
),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
    SELECT i.conv_id, 0 AS part, p, r, x FROM ids i JOIN placed t ON t.conv_id = i.base WHERE p <= h
    UNION ALL SELECT i.conv_id, 1, p, r, x FROM ids i JOIN placed t ON t.conv_id = i.conv_id WHERE p > h
),
whole AS (
    SELECT conv_id, coalesce(seq, []) AS seq, len(coalesce(seq, [])) AS n
    FROM ids LEFT JOIN (
        SELECT conv_id, list(sha256(concat(length(r), ':', r, x)) ORDER BY part, p) AS seq FROM rebuilt GROUP BY conv_id
    ) USING (conv_id)
),
steps AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth,
        len(regexp_extract_all(x, '{_WHITE}')) AS words
    FROM rebuilt
),
prefixes AS (
    SELECT w.conv_id, w.depth, w.depth = n AS ends, coalesce(words, 0) AS words,
        sha256(array_to_string(list_slice(seq, 1, w.depth), ' ')) AS node,
        CASE WHEN w.depth > 0 THEN sha256(array_to_string(list_slice(seq, 1, w.depth - 1), ' ')) END AS parent
    FROM (SELECT conv_id, seq, n, unnest(range(0, n + 1)) AS depth FROM whole) w LEFT JOIN steps USING (conv_id, depth)
),
nodes AS (
    SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
        (count(*) - 1) * any_value(words) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM prefixes GROUP BY node
),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
    SELECT a.node, sum(v.saved) AS saved_tokens, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves
    FROM nodes v JOIN prefixes a ON a.conv_id = v.conv_id AND a.depth <= v.depth LEFT JOIN children c ON c.node = v.node
    GROUP BY a.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
    saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""

DIVERGENCE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
own AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
every AS (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, v
    FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN own USING (lang, source, term)
),
shares AS (
    SELECT lang, source, term, n,
        1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p,
        1 + 1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)::HUGEINT
            // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
    FROM every
),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
    SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
    LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = o.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""
