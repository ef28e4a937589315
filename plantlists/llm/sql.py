"""DuckDB SQL that gives the rows of registered queries by plain means."""

#: Words of a text as a list: runs of characters other than 0x20 and 0x09-0x0D.
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {}

SQL["op2_minhash"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
    ELSE list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_in JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT a AS doc_id, a AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(coalesce(l.component_id, d.doc_id), d.doc_id)::BIGINT AS component_id,
  (d.doc_id = least(coalesce(l.component_id, d.doc_id), d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""

SQL["op7_substrings"] = rf"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
v AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20)),
d AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM v) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM d),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS k
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

SQL["op9_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<&#124;') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS position FROM t),
v AS (SELECT DISTINCT conv_id, role AS view FROM t WHERE role <> 'system'),
h AS (SELECT conv_id, view, position, turn, role, text, CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = view THEN '<|assistant|>' || chr(10)
  ELSE '<|user name=' || replace(replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') || '|>' || chr(10) END AS head FROM r JOIN v USING (conv_id)),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
b AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, view ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT conv_id, view, position, turn, segment, start AS "begin", CASE WHEN role = view THEN start + length(head) END AS mask_begin,
  CASE WHEN role = view THEN start + length(head) + length(text) + 7 END AS mask_end FROM b
"""

SQL["op10_embeddings"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
reach AS (SELECT a AS vec_id, a AS other FROM link UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least_id AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(l.low, m.vec_id), m.vec_id)::BIGINT AS component_id, (m.vec_id = coalesce(least(l.low, m.vec_id), m.vec_id)) AS kept
FROM embeddings m LEFT JOIN n ON n.vec_id = m.vec_id LEFT JOIN least_id l ON l.vec_id = m.vec_id
"""

SQL["op13_spelling"] = r"""
WITH RECURSIVE t AS (  -- the table of crc32, eight shifts of each byte
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b)
), r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY 1, 2),
c AS (SELECT doc_id, run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS bytes FROM d),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda s, b: xor(t.crc[(xor(s, b) % 256) + 1], s >> 8))) AS h FROM c, t),
x AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM x WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
v AS (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT x.word AS a, y.word AS b FROM v x JOIN v y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
  UNION SELECT v.word, w.word FROM v JOIN w ON w.word = v.cut UNION SELECT w.word, v.word FROM v JOIN w ON w.word = v.cut
), b AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM near JOIN w ON w.word = near.b GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM w LEFT JOIN b USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n FROM f JOIN last USING (word)
"""

SQL["op12_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
a AS (SELECT g.lang, g.source, kept.term, kept.n AS in_lang, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT lang, source, sum(n) AS total FROM a GROUP BY 1, 2),
p AS (SELECT a.lang, a.source, a.term, a.n, (1 + 1000000000::HUGEINT * (a.n + 1) // (s.total + l.v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (a.in_lang + 1) // (l.total + l.v))::HUGEINT AS q
  FROM a JOIN s ON s.lang = a.lang AND s.source = a.source JOIN l ON l.lang = a.lang),
pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3),
part AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM part) WHERE part = 'pair' OR rank <= 200
"""

SQL["op11_suffixes"] = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT k, doc_id, length(h) // 2 AS n, q, substring(h, 200 * q + 1, 400) AS x FROM (SELECT *, unnest(range(0, length(h) // 200 + 1)) AS q FROM t WHERE length(h) >= 200 AND doc_id IS NOT NULL)),  -- pieces of 200 bytes
w AS (SELECT k, doc_id, 100 * q + o AS s, md5(substring(x, 2 * o + 1, 200)) AS c FROM (SELECT *, unnest(range(0, least(100, n - 99 - 100 * q))) AS o FROM p WHERE n - 99 - 100 * q > 0)),
d AS (SELECT k, s FROM w JOIN (SELECT c, min((doc_id, s)) AS low FROM w GROUP BY 1 HAVING count(*) > 1) USING (c) WHERE low < (doc_id, s)),
g AS (SELECT k, s, s + 100 AS e, sum(CASE WHEN s > prior + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s) AS run
  FROM (SELECT k, s, lag(s) OVER (PARTITION BY k ORDER BY s) AS prior FROM d)),
r AS (SELECT k, run, min(s) AS b, max(e) AS e FROM g GROUP BY 1, 2),
n AS (SELECT k, count(*) AS spans, sum(e - b) AS removed, max(e) AS last FROM r GROUP BY 1),
piece AS (SELECT r.k, b, substring(h, 2 * coalesce(lag(e) OVER (PARTITION BY r.k ORDER BY b), 0) + 1, 2 * (b - coalesce(lag(e) OVER (PARTITION BY r.k ORDER BY b), 0))) AS x FROM r JOIN t USING (k)),
kept AS (SELECT k, string_agg(x, '' ORDER BY b) AS x FROM piece GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(x, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN n USING (k) LEFT JOIN kept USING (k)
"""
