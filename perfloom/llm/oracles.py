"""SQL for the corpus queries that SQL can express, by brute force."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, node) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node),
m AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
f AS (SELECT x, min((doc_id::HUGEINT << 31) + no) AS pos FROM l WHERE length(x) >= 10 GROUP BY 1),
g AS (SELECT x, pos, length(x) AS n FROM f WHERE length(x) >= 30),
near AS (SELECT DISTINCT a.x FROM g a JOIN g b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND b.pos < a.pos
  WHERE (left(a.x, a.n // 3) = left(b.x, a.n // 3) OR right(a.x, a.n // 3) = right(b.x, a.n // 3) OR contains(b.x, substr(a.x, a.n // 3 + 3, a.n // 3 - 4))) AND levenshtein(a.x, b.x) <= 2),
k AS (SELECT doc_id, no, l.x, length(l.x) >= 10 AND (near.x IS NOT NULL OR (doc_id::HUGEINT << 31) + no <> f.pos) AS gone FROM l LEFT JOIN f ON l.x = f.x LEFT JOIN near ON l.x = near.x)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS text_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(x, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, false)) AS t FROM k GROUP BY 1) USING (doc_id)
"""

SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
t AS (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN t USING (k)),
s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM s),
x AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
o AS (SELECT d.doc_id, length(h) // 2 AS n, h, coalesce(sum(b - a), 0) AS gone, count(a) AS spans, coalesce(max(b), 0) AS last,
  coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') AS kept FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id, h)
SELECT doc_id, n::BIGINT AS n_bytes, gone::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(kept || substr(h, 2 * last + 1))) AS kept_sha256 FROM o
"""

# Kinds of personal data: pattern, and what a match (v, its digits d) must fulfil.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(v,'.'), lambda x: length(ltrim(x,'0'))>3 OR coalesce(try_cast(ltrim(x,'0') AS INT),0)>255))=0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1,length(d)+1), lambda i: CASE WHEN (length(d)-i)%2=1 THEN CASE WHEN 2*d[i]::INT>9 THEN 2*d[i]::INT-9 ELSE 2*d[i]::INT END ELSE d[i]::INT END))%10=0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
}


def _matches(source: str, pattern: str) -> str:
    """id, i, v, s: the matches of a pattern in the texts t of `source`, with their starts."""
    return f"""SELECT id, i, v, (sum(length(g)+length(v)) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(v))::BIGINT AS s
      FROM (SELECT id, unnest(range(1,len(vs)+1)) AS i, unnest(vs) AS v, unnest(gs[:len(vs)]) AS g FROM (SELECT id, regexp_extract_all(t,'{pattern}') AS vs, string_split_regex(t,'{pattern}') AS gs FROM {source}) WHERE len(vs)>0)"""


def _found(source: str) -> str:
    """id, kind, k (the kind's place), v, s of the base spans."""
    return " UNION ALL ".join(f"SELECT id, '{kind}' AS kind, {k} AS k, v, s FROM (SELECT *, regexp_replace(v,'[^0-9]','','g') AS d FROM ({_matches(source, pattern)})) WHERE {valid}" for k, (kind, (pattern, valid)) in enumerate(_KINDS.items()))


PERSONAL_DATA = f"""
WITH e AS (SELECT doc_id AS id, coalesce(text,'') AS t FROM documents), b AS ({_found('e')}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT id FROM b)),
u AS (SELECT t, row_number() OVER () AS id FROM (SELECT DISTINCT t FROM l)), x AS ({_found('u')}),
en AS (SELECT DISTINCT id, kind || ':' || lower(v) AS entity FROM x),
tm AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(regexp_replace(t,'{_KINDS["email"][0]}',' ','g')),'\\p{{L}}{{3,}}')) AS term FROM u WHERE id IN (SELECT id FROM en)),
c AS (SELECT entity, count(*) AS dfc FROM en GROUP BY 1), ct AS (SELECT entity, term, count(*) AS dftc FROM en JOIN tm USING (id) GROUP BY 1,2),
every AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM every),
f AS (SELECT term, count(*) AS dft FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t),'\\p{{L}}{{3,}}'))) AS term FROM every) WHERE term IN (SELECT term FROM ct) GROUP BY 1),
w AS (SELECT entity, term, dfc, n, greatest(dft,dftc)::DOUBLE AS m, dftc/greatest(dft,dftc)::DOUBLE AS p FROM ct JOIN c USING (entity) JOIN f USING (term), n),
r AS (SELECT entity, term FROM w WHERE n>dfc AND 1 + log2((p + 1.645*1.645/(2*m) - 1.645*sqrt(p*(1-p)/m + 1.645*1.645/(4*m*m)))/(1 + 1.645*1.645/m))/log2(n/dfc) >= 0.8),
dt AS (SELECT DISTINCT doc_id AS id, r.term FROM l JOIN u USING (t) JOIN en ON en.id=u.id JOIN r USING (entity)),
h AS (SELECT id, t FROM e WHERE id IN (SELECT id FROM dt)), wd AS ({_matches('h', chr(92) + 'p{L}+')}),
a AS (SELECT * FROM b UNION ALL SELECT wd.id, 'term', 4, v, s FROM wd JOIN dt ON wd.id=dt.id AND lower(wd.v)=dt.term)
SELECT e.id AS doc_id, count(*) FILTER (kind='email') AS n_email, count(*) FILTER (kind='ip') AS n_ip, count(*) FILTER (kind='card') AS n_card, count(*) FILTER (kind='phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || (s+length(v)), ',' ORDER BY k, s) FILTER (k<4),'')) AS base_sha256, coalesce(string_agg(kind || ':' || s || ':' || (s+length(v)), ',' ORDER BY k, s),'') AS spans
FROM e LEFT JOIN a ON a.id=e.id GROUP BY e.id
"""

COLLOCATIONS = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), numbered as (
    select lang, row_number() over () as p, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), words as (
    select lang, p, unnest(w) as x, generate_subscripts(w, 1) as i from numbered
), heads as (
    select lang, x, lead(x) over s as y, lead(x, 2) over s as z from words window s as (partition by p order by i)
), grams as (
    select lang, 1 as size, x as phrase from heads
    union all select lang, 2, x || ' ' || y from heads where y is not null
    union all select lang, 3, x || ' ' || y || ' ' || z from heads where z is not null
), counts as (
    select lang, size, phrase, count(*) as f from grams group by all
), total as (
    select lang, sum(f)::bigint as n from counts where size = 1 group by lang
), phrases as (
    select lang, size, phrase, f as a, string_split(phrase, ' ') as w from counts where size > 1 and f >= 10
), cuts as (
    select lang, phrase, w, size, a, unnest(range(1, size)) as k from phrases
), scored as (
    select c.lang, c.phrase, c.size, c.a, c.k, x.f as l, y.f as r, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
    from cuts c
    join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ')
    join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
), best as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), longer as (
    select lang, phrase, max(a) as a
    from (select lang, a, array_to_string(w[i : i + 1], ' ') as phrase from (select lang, a, w, unnest([1, 2]) as i from phrases where size = 3))
    group by all
), ranked as (
    select b.lang, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank, b.phrase, b.a, b.l, b.r, t.n, b.score
    from best b join total t on t.lang = b.lang left join longer g on g.lang = b.lang and g.phrase = b.phrase
    where g.a is null or 100 * g.a < 50 * b.a
)
select * from ranked where rank <= 2000
"""

HARD_NEGATIVES = """
with vectors as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
    from vectors a join vectors b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5
"""
