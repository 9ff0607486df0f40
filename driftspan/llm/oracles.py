"""SQL for DuckDB over whole tables, for the queries that it can express."""

from string import ascii_lowercase, ascii_uppercase

from driftspan.llm.quality import COMMON_WORDS, Limits
from driftspan.llm.urls import Rule

WORD = r"[^\x20\x09-\x0D]+"


def near_duplicates(size: int, percent: int) -> str:
    """doc_id, n_shingles, component_id"""
    return f"""WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS ws FROM documents),
steps AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i FROM l WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS s FROM steps),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
lk AS (SELECT x, y FROM pr JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
reach(d, r) AS (SELECT doc_id, doc_id FROM l UNION SELECT d, y FROM reach JOIN both_ways ON r = x)
SELECT l.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.r AS component_id FROM l LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(r) AS r FROM reach GROUP BY d) m ON m.d = l.doc_id"""


def removal(window: int) -> str:
    """doc_id, n_words, n_removed, kept_sha256"""
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM w WHERE len(ws) >= {window})),
least_id AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM win JOIN least_id USING (k) WHERE m < doc_id),
each_word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)"""


def quality(limits: Limits = Limits()) -> str:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"""
    only = ["a-z", "A-Z", "0-9", None, r"\x20\x09-\x0D", ".,;:''\"()\\-", "#*$%&|<>"]
    counts = [f"length(regexp_replace(t, '[^{c}]', '', 'g'))" if c else r"length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))" for c in only]
    classes = ", ".join(f"{c} AS c{i}" for i, c in enumerate(counts))
    listed = ", ".join(f"('{lang}', '{w}')" for lang, words in COMMON_WORDS.items() for w in dict.fromkeys(words))
    distance = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
c0 AS (SELECT doc_id, lang, length(t) AS len, {classes} FROM d),
cl AS (SELECT doc_id, lang, bin, x FROM (SELECT doc_id, lang, unnest(range(8)) AS bin, unnest([c0, c1, c2, c3, c4, c5, c6, len - c0 - c1 - c2 - c3 - c4 - c5 - c6]) AS x FROM c0)),
voc(ref, word) AS (VALUES {listed}),
ew AS (SELECT doc_id, lang, unnest(ws) AS word FROM d),
wc AS (SELECT doc_id, any_value(lang) AS lang, ref, ew.word, count(*) AS x FROM ew JOIN voc ON voc.word = ew.word GROUP BY doc_id, ref, ew.word),
refs AS (SELECT DISTINCT ref FROM voc WHERE ref IN (SELECT lang FROM d)),
total AS (SELECT doc_id, lang, len(ws) AS n FROM d),
wl AS (SELECT t.doc_id, t.lang, v.ref, v.word, coalesce(wc.x, 0) AS x, t.n FROM total t CROSS JOIN voc v LEFT JOIN wc ON wc.doc_id = t.doc_id AND wc.ref = v.ref AND wc.word = v.word WHERE v.ref IN (SELECT ref FROM refs)),
wb AS (SELECT doc_id, lang, ref, word, x, n FROM wl UNION ALL SELECT doc_id, any_value(lang), ref, '', any_value(n) - sum(x), any_value(n) FROM wl GROUP BY doc_id, ref),
wr AS (SELECT ref, word, sum(x) / sum(sum(x)) OVER (PARTITION BY ref) AS q FROM wb WHERE lang = ref GROUP BY ref, word),
wd AS (SELECT doc_id, ref, {distance} AS far FROM (SELECT doc_id, wb.ref, x / greatest(n, 1) AS p, q FROM wb JOIN wr ON wr.ref = wb.ref AND wr.word = wb.word) GROUP BY doc_id, ref),
cr AS (SELECT lang AS ref, bin, sum(x) / sum(sum(x)) OVER (PARTITION BY lang) AS q FROM cl WHERE lang IN (SELECT ref FROM refs) GROUP BY lang, bin),
cd AS (SELECT doc_id, ref, {distance} AS near FROM (SELECT doc_id, cr.ref, x / greatest(sum(x) OVER (PARTITION BY doc_id, cr.ref), 1) AS p, q FROM cl JOIN cr USING (bin)) GROUP BY doc_id, ref),
best AS (SELECT doc_id, arg_min(near, greatest(near, far)) AS near, arg_min(far, greatest(near, far)) AS far FROM cd JOIN wd USING (doc_id, ref) GROUP BY doc_id),
tri AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM tri) WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}') GROUP BY doc_id),
f AS (SELECT d.doc_id, len(ws) AS n, c0.len - c4 AS wc, c6 AS sy, coalesce(dup, 0) AS dup, coalesce(r, 0) AS r, coalesce(near, 0) AS near, coalesce(far, 0) AS far FROM d JOIN c0 USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
g AS (SELECT *, n < 50 OR 100 * r > 50 * n AS failed FROM f)
SELECT doc_id, n::BIGINT AS n_words, wc::BIGINT AS word_chars, sy::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, r::BIGINT AS n_repeat_words, failed AS base_failed, NOT failed AND NOT (n >= {limits.min_words} AND (near > {limits.class_distance} OR far > {limits.word_distance})) AS kept FROM g"""


def _attribute(tag: str, name: str) -> str:
    value = f"""regexp_extract({tag}, '(?is)[\\s"''/]{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)"""
    return f"""trim(trim({value}, '"'''))"""


def url_verdicts(rules: list[Rule], default: str = "allow") -> str:
    """page_id, host, path, rule, verdict"""
    lower = lambda x: f"translate({x}, '{ascii_uppercase}', '{ascii_lowercase}')"
    host = lambda u: lower(f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1)")
    path = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    key = lambda u: f"CASE WHEN {host(u)} <> '' THEN concat({host(u)}, CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END, regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1)) END"
    longest = sorted(rules, key=lambda r: -len(r.text))
    pick = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in longest) + " END"
    return f"""WITH RECURSIVE tg AS (SELECT url, unnest(regexp_extract_all(html, '(?is)(<(?:link|meta)\\b[^>]*>)', 1)) AS tag FROM pages WHERE url IS NOT NULL),
to0 AS (SELECT url, replace(trim(CASE WHEN regexp_matches(lower({_attribute('tag', 'rel')}), '(^|\\s)canonical(\\s|$)') THEN {_attribute('tag', 'href')} WHEN lower({_attribute('tag', 'http-equiv')}) = 'refresh' THEN regexp_extract({_attribute('tag', 'content')}, '(?is)^\\s*[\\d.]*\\s*[;,]?\\s*url\\s*=\\s*["'']?([^"'']*)', 1) END), '&amp;', '&') AS t FROM tg),
to1 AS (SELECT url, CASE WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || t WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || t
 WHEN starts_with(t, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || t WHEN regexp_matches(t, '^(#|[a-zA-Z][a-zA-Z0-9+.-]*:)') THEN NULL ELSE coalesce(nullif(regexp_extract(url, '^(.*?://[^/?#]*/(?:[^?#]*/)?)', 1), ''), regexp_extract(url, '^(.*?://[^/?#]*)', 1) || '/') || t END AS t FROM to0 WHERE t <> ''),
lk AS (SELECT {key('url')} AS a, {key('t')} AS b FROM to1),
ed AS (SELECT a, b FROM lk WHERE a <> b UNION SELECT b, a FROM lk WHERE a <> b),
reach(n, r) AS (SELECT a, a FROM ed UNION SELECT n, b FROM reach JOIN ed ON r = a),
hp AS (SELECT r, {host("concat('x://', r)")} AS host, {path("concat('x://', r)")} AS path FROM (SELECT DISTINCT r FROM reach)),
ow AS (SELECT r, {pick('verdict')} AS v FROM hp),
sp AS (SELECT n, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM reach JOIN ow USING (r) GROUP BY n),
pg AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {key('url')} AS k FROM pages)
SELECT page_id, host, path, {pick('text')} AS rule, coalesce({pick('verdict')}, sp.v, '{default}') AS verdict FROM pg LEFT JOIN sp ON k = n"""


def codes(width: int = 64, parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """vec_id, code, error, label_error, codebooks_sha256, for vectors of `width` components and ids that differ"""
    d = width // parts
    far = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, d + 1))
    mean = ", ".join(f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, d + 1))
    steps = [f"a{r} AS (SELECT vec_id, label, p, x, min(({far}) * {entries} + e) AS m FROM pt JOIN e{r} USING (p) GROUP BY ALL)" for r in range(rounds + 1)]
    moves = [f"e{r + 1} AS (SELECT p, e, coalesce(w, c) AS c FROM e{r} LEFT JOIN (SELECT p, m % {entries} AS e, [{mean}]::BIGINT[] AS w FROM a{r} GROUP BY ALL) USING (p, e))" for r in range(rounds)]
    rest = ",\n".join(x for pair in zip(steps, [*moves, ""], strict=True) for x in pair if x)
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
pt AS (SELECT vec_id, label, p, v[p * {d} + 1:p * {d} + {d}] AS x FROM k, range({parts}) AS r(p)),
e0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM pt WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})),
{rest},
f AS (SELECT vec_id, label, string_agg(printf('%02x', (m % {entries})::INTEGER), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h"""


def collocations(least: int = 30, top: int = 2000, cover: int = 80, scale: int = 2_000_000) -> str:
    """lang, rank, phrase, a, l, r, n, score"""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})" for k in range(1, 5))
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
tot AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
inside AS (SELECT DISTINCT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, a FROM f, range(1, 5) AS s(i), range(2, 4) AS e(j) WHERE j < k AND i + j - 1 <= k),
covered AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN inside USING (lang, phrase) WHERE 100 * inside.a::HUGEINT >= {cover} * f.a),
cut AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, ({scale} * c.a::HUGEINT) // (x.a + y.a) AS score FROM f c, range(1, 4) AS s(j) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ') WHERE j < c.k),
best AS (SELECT * FROM cut ANTI JOIN covered USING (lang, phrase) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM best JOIN tot USING (lang) QUALIFY rank <= {top}"""
