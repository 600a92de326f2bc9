"""SQL for the oracle of the vector queries."""

from __future__ import annotations

EMB = "emb AS (SELECT vec_id AS id, CAST(label%2 AS INT) AS cls, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _knn(test: str, k: int, name: str = "near", query: str = "q.id%2=1", database: str = "d.id%2=0") -> str:
    return f"""{name}_pairs AS (SELECT q.id AS qid, q.cls AS qcls, d.id AS did, list_dot_product(q.v, d.v) AS s FROM emb q JOIN emb d ON {query} AND {database} AND q.id<>d.id AND {test}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s,12) DESC, did) AS rnk FROM {name}_pairs QUALIFY rnk<={k})"""


PICK = "SELECT qid, did, round(s,6) AS similarity, CAST(rnk AS BIGINT) AS rnk FROM near"


def _features(query: str) -> str:
    return f"""{_knn('q.cls=d.cls', 10, 'own', query)}, {_knn('q.cls<>d.cls', 10, 'oth', query)},
a AS (SELECT qid, any_value(qcls) AS cls, avg(s) AS own_mean, max(s) AS own_max, min(sqrt(greatest(2-2*s,0))) AS nn_distance, avg(sqrt(greatest(2-2*s,0))) AS density FROM own GROUP BY qid),
b AS (SELECT qid, avg(s) AS other_mean, max(s) AS other_max FROM oth GROUP BY qid),
f AS (SELECT a.*, other_mean, other_max, coalesce(own_mean-other_mean,0) AS margin FROM a LEFT JOIN b USING (qid))"""


FEATURES = f"WITH {EMB}, {_features('q.id%2=1')}"
UNIT = """n AS (SELECT *, (own_mean-min(own_mean) OVER c)/(max(own_mean) OVER c-min(own_mean) OVER c) AS n1, (margin-min(margin) OVER c)/(max(margin) OVER c-min(margin) OVER c) AS n2, 1-(density-min(density) OVER c)/(max(density) OVER c-min(density) OVER c) AS n3, NOT (own_max>=0.42 OR margin<=0) AS ok, count(*) OVER c AS nc FROM f WINDOW c AS (PARTITION BY cls)),
s AS (SELECT *, n1*round(0.266667e0/0.733333e0,6)+n3*round(0.04e0/0.733333e0,6)+n2*round(0.333333e0/0.733333e0,6) AS raw FROM n)"""


def _lof(query: str, database: str) -> str:
    return f"""{_knn('q.cls=d.cls', 20, 'lk', query, database)}, ld AS (SELECT qid, did, sqrt(greatest(2-2*s,0)) AS d FROM lk), kd AS (SELECT qid, max(d) AS kd FROM ld GROUP BY qid), rd AS (SELECT l.qid, l.did, greatest(kd.kd, l.d) AS rd FROM ld l JOIN kd ON l.did=kd.qid),
lrd AS (SELECT qid, 1/(avg(rd)+1e-10) AS lrd FROM rd GROUP BY qid), lofs AS (SELECT r.qid, avg(o.lrd)/any_value(m.lrd) AS lof FROM rd r JOIN lrd o ON r.did=o.qid JOIN lrd m ON r.qid=m.qid GROUP BY r.qid)"""


LOF = _lof("q.id%2=1", "d.id%2=1")


def _walk(ordered: str) -> str:
    """Greedy walk over ``ordered`` (id, cls, i): ids kept so far, a row a step."""
    return f"""nb AS (SELECT b.id, list(a.id) AS better FROM {ordered} a JOIN {ordered} b ON a.cls=b.cls AND a.i<b.i JOIN emb x ON x.id=a.id JOIN emb y ON y.id=b.id WHERE round(list_dot_product(x.v,y.v),12)>0.33 GROUP BY b.id),
steps AS (SELECT o.id, o.i, coalesce(nb.better, []) AS better FROM {ordered} o LEFT JOIN nb USING (id)),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT walk.i+1, CASE WHEN list_has_any(walk.kept, s.better) THEN walk.kept ELSE list_append(walk.kept, s.id) END FROM walk JOIN steps s ON s.i=walk.i+1),
held AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1) t)"""


CELLS = "cells AS (SELECT id, cls, generate_subscripts(v,1) AS pos, unnest(v) AS x FROM emb)"


def _scored(train: str, eps: str = "0e0") -> str:
    return f"{CELLS}, ref AS (SELECT cls, pos, avg(x) AS c, greatest(var_pop(x),1e-8)+{eps} AS s FROM cells WHERE {train} GROUP BY cls, pos), dist AS (SELECT l.id, l.cls AS own, r.cls, sum((x-c)*(x-c)/s) AS d FROM cells l JOIN ref r USING (pos) GROUP BY l.id, l.cls, r.cls), ood AS (SELECT id, any_value(own) AS cls, min(d) AS ood_score, min_by(cls, d) AS nearest FROM dist GROUP BY id)"


BALLS = f"""{_knn('true', 3, 'rr', 'q.id%2=0', 'd.id%2=0')}, {_knn('true', 3, 'gg', 'q.id%2=1', 'd.id%2=1')}, r1 AS (SELECT qid, max(sqrt(greatest(2-2*s,0))) AS r FROM rr GROUP BY qid), r2 AS (SELECT qid, max(sqrt(greatest(2-2*s,0))) AS r FROM gg GROUP BY qid),
met AS (SELECT g.id AS g, d.id AS r, sqrt(greatest(2-2*list_dot_product(g.v,d.v),0)) AS d, r1.r AS rr, r2.r AS gr FROM emb g JOIN emb d ON g.id%2=1 AND d.id%2=0 JOIN r1 ON d.id=r1.qid JOIN r2 ON g.id=r2.qid),
pg AS (SELECT g, count(*) FILTER (d<=rr+1e-12) AS balls FROM met GROUP BY g), pr AS (SELECT r, count(*) FILTER (d<=gr+1e-12) AS balls, count(*) FILTER (d<=rr+1e-12) AS cov FROM met GROUP BY r)"""

CAND = "q.id IN (SELECT id FROM cand)"
SELECTION = f"""WITH RECURSIVE {EMB}, con AS (SELECT e.id, e.cls, d.text AS content FROM emb e LEFT JOIN documents d ON d.doc_id=CASE WHEN e.id%7=0 THEN e.id%14+14*e.cls ELSE e.id END),
fresh AS (SELECT c.* FROM con c WHERE id%2=1 AND NOT EXISTS (SELECT 1 FROM con r WHERE r.id%2=0 AND r.cls=c.cls AND r.content IS NOT DISTINCT FROM c.content)),
cand AS (SELECT id, cls FROM fresh QUALIFY row_number() OVER (PARTITION BY cls, content ORDER BY id)=1), {_features(CAND)}, {UNIT}, {_lof(CAND, CAND.replace('q.', 'd.'))},
sc AS (SELECT s.*, CASE WHEN lof>1.5 THEN 1e0 ELSE 0e0 END AS outlier, round(raw*(1-0.25e0*CASE WHEN lof>1.5 THEN 1 ELSE 0 END),6) AS score FROM s LEFT JOIN lofs USING (qid)),
ord AS (SELECT qid AS id, cls, row_number() OVER (ORDER BY cls, score DESC, qid) AS i FROM sc WHERE ok), {_walk('ord')},
real_n AS (SELECT cls, count(*) AS n_real FROM emb WHERE id%2=0 GROUP BY cls),
flagged AS (SELECT sc.*, NOT ok OR qid IN (SELECT id FROM held) AS kept, least(greatest(1,floor(nc*0.4)), greatest(1,floor(n_real*0.5))) AS most FROM sc JOIN real_n USING (cls)),
placed AS (SELECT *, ok AND kept AND row_number() OVER (PARTITION BY cls, ok AND kept ORDER BY score DESC, qid)<=most AS selected FROM flagged),
chosen AS (SELECT *, CASE WHEN ok AND NOT kept THEN 'near_duplicate' WHEN selected THEN 'top_quality' WHEN margin<=0 THEN 'cross_class_ambiguous' WHEN own_max>=0.42 THEN 'near_real_copy' ELSE 'below_quality_rank' END AS reason FROM placed)"""
ORACLES: dict[str, str] = {
    "diversity_filter": f"WITH RECURSIVE {EMB}, ord AS (SELECT id, 0 AS cls, row_number() OVER (ORDER BY id) AS i FROM emb), {_walk('ord')} SELECT id, CAST(id IN (SELECT id FROM held) AS INT) AS kept FROM emb",
    "selection_pipeline": f"{SELECTION} SELECT qid, cls, outlier, score, CAST(ok AS INT) AS eligible, CAST(kept AS INT) AS kept, CAST(selected AS INT) AS selected, reason FROM chosen",
    "selection_summary": f"""{SELECTION}, counts AS (SELECT cls, count(*) AS n_generated, count(*) FILTER (selected) AS n_selected, count(*) FILTER (reason='near_duplicate') AS near_duplicates_removed, count(*) FILTER (own_max>=0.42) AS near_copies_rejected,
 count(*) FILTER (margin<=0) AS ambiguous_rejected, CAST(sum(outlier) AS BIGINT) AS outliers, round(avg(own_mean),5) AS mean_own_mean, round(avg(margin),5) AS mean_margin, round(avg(score),5) AS mean_score FROM chosen GROUP BY cls),
 lost AS (SELECT c.cls, count(*)-count(f.id) AS copies_excluded, count(f.id)-count(k.id) AS duplicates_excluded FROM con c LEFT JOIN fresh f ON f.id=c.id LEFT JOIN cand k ON k.id=c.id WHERE c.id%2=1 GROUP BY c.cls)
 SELECT * FROM counts JOIN real_n USING (cls) JOIN lost USING (cls)""",
    "knn_join": f"WITH {EMB}, {_knn('q.cls=d.cls', 10)} {PICK}",
    "nearest_pair": f"WITH {EMB}, {_knn('q.cls=d.cls', 1)} {PICK}",
    "other_class_knn": f"WITH {EMB}, {_knn('q.cls<>d.cls', 10)} {PICK}",
    "retrieve_similar": f"WITH {EMB}, f AS (SELECT v FROM emb ORDER BY id LIMIT 1) SELECT e.id, round(list_dot_product(e.v, f.v)/sqrt(list_dot_product(f.v, f.v)),6) AS similarity FROM emb e CROSS JOIN f ORDER BY round(list_dot_product(e.v, f.v)/sqrt(list_dot_product(f.v, f.v)),12) DESC, e.id LIMIT 10",
    "l2_normalize": f"WITH {EMB} SELECT id, round(3*sqrt(list_dot_product(v,v)),6) AS norm, 1e0 AS unit, round(list_dot_product(v, list_reverse(v))/list_dot_product(v,v),6) AS turned FROM emb",
    "quality_features": f"{FEATURES} SELECT qid, cls, round(own_mean,6) AS own_mean, round(own_max,6) AS own_max, round(nn_distance,6) AS nn_distance, round(density,6) AS density, round(other_mean,6) AS other_mean, round(other_max,6) AS other_max, round(margin,6) AS margin FROM f",
    "composite_score": f"{FEATURES}, {UNIT}, {LOF} SELECT s.qid, s.cls, CASE WHEN lof>1.5 THEN 1e0 ELSE 0e0 END AS outlier, round(raw*(1-0.25e0*CASE WHEN lof>1.5 THEN 1 ELSE 0 END),6) AS score FROM s LEFT JOIN lofs USING (qid)",
    "selection_scores": f"""{FEATURES}, {UNIT}, real_n AS (SELECT cls, count(*) AS k FROM emb WHERE id%2=0 GROUP BY cls), r AS (SELECT s.*, round(raw,6) AS score, row_number() OVER (PARTITION BY s.cls, ok ORDER BY round(raw,6) DESC, qid) AS rn, least(greatest(1,floor(nc*0.4)), greatest(1,floor(k*0.5))) AS most FROM s JOIN real_n USING (cls))
SELECT qid, cls, score, CAST(ok AS INT) AS eligible, CAST(ok AND rn<=most AS INT) AS selected, CASE WHEN ok AND rn<=most THEN 'top_quality' WHEN margin<=0 THEN 'cross_class_ambiguous' WHEN own_max>=0.42 THEN 'near_real_copy' ELSE 'below_quality_rank' END AS reason FROM r""",
    "best_worst_n": f"{FEATURES}, {UNIT}, t AS (SELECT qid, cls, round(raw,6) AS score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, qid) AS b, row_number() OVER (PARTITION BY cls ORDER BY score, qid DESC) AS w FROM t) SELECT qid, cls, score, 'best' AS side, b AS place FROM k WHERE b<=50 UNION ALL SELECT qid, cls, score, 'worst', w FROM k WHERE w<=50",
    "class_prototypes": f"WITH {EMB}, {CELLS} SELECT cls, CAST(pos-1 AS BIGINT) AS pos, count(*) AS n, round(avg(x),6) AS centroid, round(greatest(var_pop(x),1e-8),6) AS variance FROM cells WHERE id%2=0 GROUP BY cls, pos",
    "mahalanobis_ood": f"WITH {EMB}, {_scored('id%2=0')} SELECT id, round(ood_score,4) AS ood_score, nearest FROM ood",
    "prototype_probability": f"WITH {EMB}, {_scored('id%2=0', '1e-8')}, e AS (SELECT id, cls, exp(min(d) OVER (PARTITION BY id)-d) AS e FROM dist) SELECT id, cls, round(e/sum(e) OVER (PARTITION BY id),5) AS probability FROM e",
    "ood_rate": f"WITH {EMB}, {_scored('id%2=0 AND id%3<>0')}, t AS (SELECT quantile_cont(ood_score,0.95) AS t FROM ood WHERE id%2=0 AND id%3=0) SELECT cls, round(avg(CASE WHEN ood_score>t THEN 1e0 ELSE 0e0 END),5) AS ood_rate, round(avg(CASE WHEN nearest=cls THEN 1e0 ELSE 0e0 END),5) AS prototype_agreement FROM ood CROSS JOIN t WHERE id%2=1 GROUP BY cls",
    "quantile_threshold": f"WITH {EMB}, {_scored('id%2=0')} SELECT cls, round(quantile_cont(ood_score,0.95),4) AS threshold FROM ood GROUP BY cls",
    "lof_flag": f"WITH {EMB}, {LOF} SELECT qid AS id, round(lof,5) AS lof, CASE WHEN lof>1.5 THEN 1e0 ELSE 0e0 END AS outlier FROM lofs",
    "mean_vector_moments": f"WITH {EMB}, {CELLS}, d AS (SELECT max(len(v)) AS d FROM emb) SELECT CAST(0 AS BIGINT) AS pos, round(count(*)*1e0,4) AS total FROM emb UNION ALL SELECT pos, round(sum(x),4) FROM cells GROUP BY pos UNION ALL SELECT any_value(d.d)+(a.pos-1)*any_value(d.d)+b.pos, round(sum(a.x*b.x),4) FROM cells a JOIN cells b USING (id) CROSS JOIN d GROUP BY a.pos, b.pos",
    "kernel_distance_biased": f"WITH {EMB}, m AS (SELECT least(1000, count(*) FILTER (id%2=0), count(*) FILTER (id%2=1)) AS n FROM emb), z AS (SELECT id, v, row_number() OVER (PARTITION BY id%2 ORDER BY CAST(('0x'||substr(sha256('0:'||id),1,8)) AS BIGINT), id) AS rn FROM emb), smp AS (SELECT id, v FROM z CROSS JOIN m WHERE rn<=n), kk AS (SELECT p.id%2 AS a, q.id%2 AS b, avg(pow(list_dot_product(p.v,q.v)/64+1,3)) AS k FROM smp p CROSS JOIN smp q GROUP BY p.id%2, q.id%2) SELECT n, round(greatest(0,(SELECT k FROM kk WHERE a=0 AND b=0)+(SELECT k FROM kk WHERE a=1 AND b=1)-2*(SELECT k FROM kk WHERE a=0 AND b=1)),7) AS distance FROM m",
    "prdc": f"WITH {EMB}, {BALLS} SELECT round((SELECT avg(CASE WHEN balls>0 THEN 1e0 ELSE 0e0 END) FROM pg),6) AS precision, round((SELECT avg(CASE WHEN balls>0 THEN 1e0 ELSE 0e0 END) FROM pr),6) AS recall, round((SELECT avg(balls)/3 FROM pg),6) AS density, round((SELECT avg(CASE WHEN cov>0 THEN 1e0 ELSE 0e0 END) FROM pr),6) AS coverage",
    "improved_precision_recall": f"WITH {EMB}, {BALLS} SELECT round((SELECT avg(CASE WHEN balls>0 THEN 1e0 ELSE 0e0 END) FROM pg),6) AS precision, round((SELECT avg(CASE WHEN balls>0 THEN 1e0 ELSE 0e0 END) FROM pr),6) AS recall",
    "memorization_check": f"WITH {EMB}, {_knn('true', 1, 'gr')}, {_knn('true', 1, 'rr', 'q.id%2=0', 'd.id%2=0')} SELECT round((SELECT quantile_disc(sqrt(greatest(2-2*s,0)),0.5) FROM gr),6) AS generated_to_real, round((SELECT quantile_disc(sqrt(greatest(2-2*s,0)),0.5) FROM rr),6) AS real_to_real",
    "feature_separation": f"""WITH {EMB}, {CELLS}, cen AS (SELECT cls, list(x ORDER BY pos) AS c FROM (SELECT cls, pos, avg(x) AS x FROM cells GROUP BY cls, pos) t GROUP BY cls), mid AS (SELECT list(x ORDER BY pos) AS g FROM (SELECT pos, avg(x) AS x FROM cells GROUP BY pos) t), o AS (SELECT e.id, e.cls, list_distance(e.v, c.c) AS d FROM emb e JOIN cen c USING (cls)),
sp AS (SELECT cls, avg(d) AS s, sum(d*d) AS w, count(*) AS n FROM o GROUP BY cls), gap AS (SELECT a.cls, b.cls AS o, list_distance(a.c,b.c) AS gap, x.s AS s1, y.s AS s2 FROM cen a JOIN cen b ON a.cls<>b.cls JOIN sp x ON x.cls=a.cls JOIN sp y ON y.cls=b.cls), bt AS (SELECT sp.n, sp.w, pow(list_distance(c.c, mid.g),2) AS b FROM cen c JOIN sp USING (cls) CROSS JOIN mid),
pd AS (SELECT p.id, p.cls, q.cls AS o, sum(list_distance(p.v,q.v)) AS s, count(*) AS k FROM emb p CROSS JOIN emb q GROUP BY p.id, p.cls, q.cls), ab AS (SELECT id, max(CASE WHEN cls=o THEN s/(k-1) END) AS a, min(CASE WHEN cls<>o THEN s/k END) AS b FROM pd GROUP BY id)
SELECT round((SELECT avg((b-a)/greatest(a,b)) FROM ab),5) AS silhouette, round((SELECT avg(m) FROM (SELECT max((s1+s2)/gap) AS m FROM gap GROUP BY cls) t),5) AS davies_bouldin, round((SELECT (sum(n*b)/(count(*)-1))/(sum(w)/(sum(n)-count(*))) FROM bt),5) AS calinski_harabasz, round((SELECT avg(d) FROM o),5) AS compactness, round((SELECT avg(gap) FROM gap WHERE cls<o),5) AS separation, round((SELECT avg(b) FROM bt)/((SELECT avg(d*d) FROM o)+1e-12),5) AS fisher""",
}
