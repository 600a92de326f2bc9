"""SQL for the oracle of the text queries that SQL can state."""

from __future__ import annotations

SPACED = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
#: Documents of equal words are one node; shingles are counted runs of five words, or a shorter text whole.
NEAR_DEDUP = rf"""WITH RECURSIVE d AS (SELECT doc_id, {SPACED} AS w FROM documents), n AS (SELECT doc_id, array_to_string(w,' ') AS node, w FROM d), head AS (SELECT node, min(doc_id) AS id, any_value(w) AS w FROM n GROUP BY node),
g AS (SELECT id, g, count(*) AS k FROM (SELECT id, unnest(CASE WHEN len(w)<5 THEN [array_to_string(w,' ')] ELSE list_transform(range(1, len(w)-3), lambda j: array_to_string(w[j:j+4],' ')) END) AS g FROM head WHERE len(w)>0) t GROUP BY id, g),
size AS (SELECT id, sum(k) AS s FROM g GROUP BY id), common AS (SELECT a.id AS a, b.id AS b, sum(least(a.k,b.k)) AS c FROM g a JOIN g b ON a.g=b.g AND a.id<>b.id GROUP BY a.id, b.id),
link AS (SELECT a, b FROM common JOIN size x ON x.id=a JOIN size y ON y.id=b WHERE c >= 8e-1*(x.s+y.s-c)-1e-9), reach AS (SELECT id AS a, id AS b FROM head UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b=l.a),
class AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a), member AS (SELECT n.doc_id, class_id FROM n JOIN head USING (node) JOIN class ON class.id=head.id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id=class_id AS is_first FROM member"""

MIX = rf"""WITH d AS (SELECT doc_id, source, CAST(len({SPACED}) AS BIGINT) AS size, md5(concat(doc_id,':mix-1')) AS key FROM documents), t AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST)-1)%3+1 AS weight, 3*ss AS most FROM t),
f AS (SELECT *, coalesce(sum(most) OVER o,0) AS filled, coalesce(sum(weight) OVER o,0) AS wf, sum(ss) OVER () AS alls, sum(weight) OVER () AS allw FROM w WINDOW o AS (ORDER BY most*1e0/weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CAST(alls-filled AS DOUBLE)/CAST(allw-wf AS DOUBLE) AS level FROM f), lv AS (SELECT min_by(level, filled) AS lv FROM g WHERE level*weight<=most),
p AS (SELECT source, ss, CASE WHEN level*weight<=most THEN lv*weight ELSE most*1e0 END AS target FROM g CROSS JOIN lv), b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM p), e AS (SELECT *, CASE WHEN ss>0 THEN budget//ss ELSE 0 END AS epochs FROM b),
r AS (SELECT d.doc_id, d.source, size, ss, target, epochs, budget-epochs*ss AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, ss AS source_size, target, CAST(epochs*size+least(size,greatest(0,rest-before)) AS BIGINT) AS taken, source FROM r"""

_LOW = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_LOW} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LOW} AS w FROM benchmark), ik AS (SELECT *, least(10,len(w)) AS k FROM i WHERE len(w)>0),
iw AS (SELECT DISTINCT item, k, unnest(list_transform(range(1, len(w)-k+2), lambda j: array_to_string(w[j:j+k-1],' '))) AS g FROM ik), ks AS (SELECT DISTINCT k FROM iw),
dg AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w)-k+2), lambda j: {{'j': j, 'g': array_to_string(w[j:j+k-1],' ')}})) AS x FROM d JOIN ks ON len(w)>=k), h AS (SELECT DISTINCT doc_id, dg.k, x.j AS j, item FROM dg JOIN iw ON iw.k=dg.k AND iw.g=x.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j,j+k)) AS p FROM h) t GROUP BY doc_id), it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text,'') AS text, {SPACED} AS w FROM documents), l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)-3), lambda j: {{'j': j, 'g': array_to_string(w[j:j+4],' ')}})) AS x FROM d WHERE len(w)>=5), again AS (SELECT doc_id, x.j AS j, count(*) OVER (PARTITION BY doc_id, x.g) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(j,j+5)) AS p FROM again WHERE n>1) t GROUP BY doc_id),
m AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w,'')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text,'[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines)-len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r,0) AS n_repeat_words, len(regexp_extract_all(text,'\p{{Lu}}')) AS up, len(regexp_extract_all(text,'\p{{L}}')) AS letters FROM l LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words<10 AS f0, 100*n_repeat_words>20*n_words AS f1, 20*n_symbols>word_chars AS f2, 10*n_dup_lines>3*n_lines AS f3, 10*up>3*letters AS f4, word_chars<2*n_words OR word_chars>25*n_words AS f5 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f4 OR f5) AS kept, CAST(f0::INT+2*f1::INT+4*f2::INT+8*f3::INT+16*f4::INT+32*f5::INT AS BIGINT) AS fail_bits FROM b"""

RULE_ABLATION = f"WITH q AS ({QUALITY_RULES}), u AS (SELECT fail_bits & 55 AS bits FROM q), r AS (SELECT * FROM (VALUES ('few_words',1),('repeated_words',2),('symbols',4),('capitals',16),('word_length',32)) r(rule, bit)) SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only FROM u CROSS JOIN r GROUP BY rule"

_PIECES = r"regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"
COLLOCATIONS = rf"""WITH d AS (SELECT coalesce(lang,'und') AS lang, unnest({_PIECES}) AS p FROM documents), w AS (SELECT lang, regexp_extract_all(p,'[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w)-k+2), lambda j: array_to_string(w[j:j+k-1],' '))) AS g FROM w CROSS JOIN (VALUES (1),(2),(3)) t(k) WHERE len(w)>=k), f AS MATERIALIZED (SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k=1 GROUP BY lang), c AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g,' ') AS p FROM f WHERE k>1 AND f>=10),
h AS MATERIALIZED (SELECT lang, k, g, a, j, array_to_string(p[1:j],' ') AS lp, array_to_string(p[j+1:k],' ') AS rp FROM (SELECT *, unnest(range(1,k)) AS j FROM c) t),
cut AS (SELECT h.lang, h.g, h.k, a, l.f AS l, r.f AS r, j, (1000000*a*a)//(l.f*r.f) AS score FROM h JOIN f l ON l.lang=h.lang AND l.g=h.lp JOIN f r ON r.lang=h.lang AND r.g=h.rp),
low AS (SELECT lang, g, k, any_value(a) AS a, min_by(l, score*10+j) AS l, min_by(r, score*10+j) AS r, min(score) AS score FROM cut GROUP BY lang, g, k),
o AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, array_to_string(p[1:2],' ') AS g, a FROM c WHERE k=3 UNION ALL SELECT lang, array_to_string(p[2:3],' ') AS g, a FROM c WHERE k=3) t GROUP BY lang, g),
x AS (SELECT low.*, low.g AS phrase FROM low LEFT JOIN o ON o.lang=low.lang AND o.g=low.g WHERE o.a IS NULL OR 100*o.a<50*low.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM x)
SELECT r.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN n ON n.lang=r.lang WHERE rank<=2000"""

WARC = """WITH p AS (SELECT page_id, url, encode(coalesce(html,'')) AS b FROM pages), d AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS head FROM p), t AS (SELECT *, n>=1000 AND head IS NOT NULL AND page_id IS DISTINCT FROM head AS again FROM d)
SELECT page_id, url AS target_uri, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN head END AS refers_to, true AS verified FROM t"""


def _centroids(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """A step per round: distances to all centroids, the nearest, floors of the means."""
    steps = [
        f"""WITH s AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE)*256) AS BIGINT)) AS v FROM embeddings WHERE len(embedding)={dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))={dim})""",
        f"e AS MATERIALIZED (SELECT i, unnest(range(1,{dim + 1})) AS d, unnest(v) AS x FROM s)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range(1,{dim + 1})) AS d, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('2:'||vec_id), v)-1 AS c, v FROM s) t WHERE c<{k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"n{r} AS MATERIALIZED (SELECT i, min_by(c, m*1000+c) AS c, min(m) AS m FROM (SELECT i, c, sum((e.x-k.x)*(e.x-k.x)) AS m FROM e JOIN c{r} k USING (d) GROUP BY i, c) t GROUP BY i)")
        if r < rounds:
            steps.append(f"u{r} AS (SELECT c, d, sum(x) AS s, count(*) AS q FROM e JOIN n{r} USING (i) GROUP BY c, d), c{r + 1} AS MATERIALIZED (SELECT k.c, k.d, CASE WHEN q IS NULL THEN k.x ELSE CAST((s-((s%q)+q)%q)//q AS BIGINT) END AS x FROM c{r} k LEFT JOIN u{r} USING (c, d))")
    last = f"SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(m AS BIGINT) AS distance, CAST(sum(m) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(m) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM n{rounds} JOIN s USING (i) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c) t USING (c)"
    return ", ".join(steps) + " " + last


CENTROIDS = _centroids()

ORACLES = {"op1_near_dedup": NEAR_DEDUP, "op2_mix": MIX, "op9_decontaminate": DECONTAMINATE, "op10_quality_rules": QUALITY_RULES, "quality_rule_ablation": RULE_ABLATION, "op11_collocations": COLLOCATIONS, "op12_warc": WARC, "op13_cluster": CENTROIDS}
