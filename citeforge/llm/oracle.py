"""SQL of the queries that SQL can express, by plainer means than the operators."""

#: Every window as a string; a word goes if a repeated window starts at it or up to 49 words before.
OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, count(*) OVER f AS c, string_agg(x, ' ') OVER f AS s FROM words
        WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT s, min(doc_id) AS m FROM win WHERE c = 50 GROUP BY s),
dup AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (s) WHERE win.c = 50 AND win.doc_id > m),
marked AS (SELECT words.doc_id, words.i, x, max(CASE WHEN dup.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
           FROM words LEFT JOIN dup ON dup.doc_id = words.doc_id AND dup.i = words.i)
SELECT d.doc_id, count(x) AS n_words, count(x) FILTER (gone = 1) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id
"""

#: Every 100-byte string by its digest; runs of removed bytes as gaps and islands.
OP4 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, octet_length(b) AS n FROM d),
pos AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i FROM n),
win AS (SELECT pos.doc_id, i, sha256(b[i : i + 99]) AS s FROM pos JOIN d USING (doc_id) WHERE i <= n - 99),
rnk AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win),
flag AS (SELECT pos.doc_id, pos.i, max(CASE WHEN r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pos.doc_id ORDER BY pos.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM pos LEFT JOIN rnk USING (doc_id, i)),
edge AS (SELECT *, lag(gone, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM flag),
run AS (SELECT doc_id, i, gone, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM edge WHERE gone <> prev),
part AS (SELECT run.doc_id, run.i, gone, coalesce(nxt, n + 1) AS nxt FROM run JOIN n USING (doc_id))
SELECT d.doc_id, any_value(octet_length(b)) AS n_bytes, coalesce(sum(nxt - i) FILTER (gone = 1), 0)::BIGINT AS n_removed, count(*) FILTER (gone = 1) AS n_spans,
  sha256(unhex(coalesce(string_agg(hex(b[i : nxt - 1]), '' ORDER BY i) FILTER (gone = 0), ''))) AS kept_sha256
FROM d LEFT JOIN part USING (doc_id) GROUP BY d.doc_id
"""

#: Leaves, constant tokens and templates without hashes.
OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, t, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
ln AS (SELECT doc_id, t, i, list_transform(string_split(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' '),
              lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS k FROM raw WHERE length(line) > 4),
leaves AS (SELECT *, len(k) AS c, k[1] AS a1, k[2] AS a2, k[3] AS a3 FROM ln WHERE len(k) >= 3),
often AS (SELECT c, a1, a2, a3, count(*) AS n FROM leaves GROUP BY ALL HAVING count(DISTINCT t) >= 10),
held AS (SELECT leaves.*, n FROM leaves JOIN often USING (c, a1, a2, a3)),
tok AS (SELECT doc_id, t, i, c, a1, a2, a3, n, unnest(k) AS x, generate_subscripts(k, 1) AS j FROM held),
share AS (SELECT *, count(*) OVER (PARTITION BY c, a1, a2, a3, j, x) AS m FROM tok),
shaped AS (SELECT doc_id, t, i, c, a1, a2, a3, list(CASE WHEN m >= 0.3 * n THEN x ELSE '<*>' END ORDER BY j) AS shape,
                  count(*) FILTER (m >= 0.3 * n AND x <> '<*>') AS fixed FROM share GROUP BY ALL),
common AS (SELECT c, a1, a2, a3, shape FROM shaped WHERE fixed >= 3 GROUP BY ALL HAVING count(DISTINCT t) >= 10),
gone AS (SELECT DISTINCT doc_id, t, i FROM shaped JOIN common USING (c, a1, a2, a3, shape))
SELECT raw.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY raw.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.t = raw.t AND gone.i = raw.i GROUP BY raw.doc_id
"""

#: Groups by the text itself.
OP8 = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every pair of an item and a document that share a term.
OP13 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
dn AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM dn),
it AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM df, s),
sc AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))))::BIGINT AS score
       FROM it JOIN wt USING (t) JOIN tf USING (t) JOIN dn USING (doc_id), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY rank <= 10
"""

#: Every phrase of up to five words; every part of a longer candidate.
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
pieces AS (SELECT d, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM d),
ws AS (SELECT d, p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT d, p, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM ws),
suffix AS (SELECT lang, x AS w1, lead(x, 1) OVER o AS w2, lead(x, 2) OVER o AS w3, lead(x, 3) OVER o AS w4, lead(x, 4) OVER o AS w5 FROM words WINDOW o AS (PARTITION BY d, p ORDER BY i)),
f AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM suffix GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM suffix WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM suffix WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM suffix WHERE w4 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) FROM suffix WHERE w5 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
inner_ AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS longer FROM cand, range(1, 5) a(i), range(2, 5) b(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
cut AS (SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cand c JOIN range(1, 5) js(j) ON j < c.k JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1 : c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
"""
