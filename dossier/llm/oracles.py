"""The same results as SQL, for the operators that SQL can express on whole tables."""

from __future__ import annotations

from dossier.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

OP2 = f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
items AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS varchar) AS item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
 FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0)),
hits AS MATERIALIZED (SELECT doc_id, p, n, item FROM (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)) JOIN items USING (n, s)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS i FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP10 = """WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, first_value(doc_id) OVER (PARTITION BY s ORDER BY doc_id, p) AS fd, first_value(p) OVER (PARTITION BY s ORDER BY doc_id, p) AS fp FROM windows) WHERE doc_id <> fd OR p <> fp),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(len(w) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP3 = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)),
flagged AS (SELECT doc_id, p FROM windows SEMI JOIN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1) USING (s)),
steps AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 1 ELSE 0 END AS step FROM flagged),
runs AS MATERIALIZED (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT doc_id, p, sum(step) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM steps) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs UNION ALL SELECT doc_id, max(b), max(n) FROM runs JOIN d USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(b - a) AS bigint) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS bigint) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP8 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(3, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS p FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS MATERIALIZED (SELECT x AS a, y AS b FROM (SELECT g1.doc_id AS x, g2.doc_id AS y, count(*) AS i FROM g g1 JOIN g g2 USING (s) WHERE g1.doc_id <> g2.doc_id GROUP BY ALL)
 JOIN sizes s1 ON s1.doc_id = x JOIN sizes s2 ON s2.doc_id = y WHERE 100 * i >= 90 * (s1.n + s2.n - i)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)"""


#: Checksums byte by byte (the table from its rule), and the shards from prefix sums over the whole table.
OP5 = """WITH t AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS bigint), list_transform(range(8), lambda q: CAST(0 AS bigint))), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS bigint)) ELSE a >> 1 END) AS x FROM range(256) r(i))),
h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g') AS h FROM documents),
b AS MATERIALIZED (SELECT doc_id, n, list_transform(string_split(h, ',')[1 : n], lambda x: CAST('0x' || x AS bigint)) AS b FROM h),
sized AS MATERIALIZED (SELECT doc_id, CAST(n + 16 AS bigint) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), b), lambda a, x: xor(t[xor(a & 255, x) + 1], a >> 8)), CAST(4294967295 AS bigint)) AS text_crc32 FROM b, t),
run AS (SELECT *, sum(size) OVER o AS upto, row_number() OVER o AS nth, sum(size) OVER () AS total FROM sized WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
dealt AS (SELECT *, CAST(least(39, (2 * upto - size) * 40 // (2 * total)) AS int) AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, CAST(NULL AS int) AS grown_shard FROM dealt"""

OP11 = """WITH e AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS double)) AS bigint)) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, a.label AS al, b.id AS b, b.label AS bl, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS bigint) AS s FROM e a, e b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT a, al, b AS p, s AS ps FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p AS positive_id, CAST(row_number() OVER w AS int) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s ON s.a = p.a AND bl <> p.al AND 80 * ps <= 100 * s AND 100 * s <= 100 * ps WINDOW w AS (PARTITION BY p.a, p ORDER BY s DESC, b) QUALIFY row_number() OVER w <= 5"""

OP12 = f"""WITH pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(w[p : p + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM pieces, range(1, 6) r(k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c longer ON longer.lang = c.lang AND longer.k > c.k AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * longer.a >= 100 * c.a),
cut AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, i, CAST(n AS bigint) AS n, CAST(1000 * CAST(c.a AS hugeint) * n // (CAST(x.a AS hugeint) * y.a) AS bigint) AS score
 FROM (SELECT *, unnest(range(1, k)) AS i FROM c ANTI JOIN gone USING (lang, phrase)) c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[i + 1 : len(w)], ' ')),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM worst WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000"""


def _canonical(text: str) -> str:
    c = f"lower(coalesce({text}, ''))"
    for pattern, other in [(licenses.COPYRIGHT_LINE, "$1"), *licenses.SPELLINGS]:
        p, o = pattern.replace("'", "''"), other.replace("$1", "\\1").replace("$2", "\\2")
        c = f"regexp_replace({c}, '{p}', '{o}', 'g')"
    return f"trim(regexp_replace({c}, '{licenses.PUNCTUATION}', ' ', 'g'))"


def op9() -> str:
    known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.known_texts())
    return f"""WITH known AS (SELECT sha256({_canonical('body')}) AS canonical_sha256, min(license_id) AS license_id FROM (VALUES {known}) v(license_id, body) GROUP BY ALL),
c AS (SELECT doc_id, {_canonical('text')} AS c FROM documents)
SELECT doc_id, CAST(length(c) AS int) AS canonical_chars, sha256(c) AS canonical_sha256, license_id, license_id IS NOT NULL AS is_license FROM c LEFT JOIN known ON sha256(c) = canonical_sha256"""


ORACLE_SQL = {"op2_decontaminate": OP2, "op3_suffix_array_dedup": OP3, "op5_shard": OP5, "op8_ngram_jaccard_join": OP8, "op9_license_scan": op9(), "op10_substring_dedup": OP10, "op11_hard_negatives": OP11, "op12_collocations": OP12}
