"""SQL for the oracle of stored tables, streams and image descriptors."""

from __future__ import annotations

from quillmill.plans import sql_evaluation as E
from quillmill.plans import sql_vectors as V

HISTORY = "h AS (SELECT user_id%12 AS run_id, row_number() OVER (PARTITION BY user_id%12 ORDER BY event_id) AS epoch, value/(value+40e0) AS val_f1, 1e0/(1e0+value) AS val_loss FROM events)"
PIXELS = f"{V.EMB}, px AS (SELECT id, (pos-1)//8 AS r, (pos-1)%8 AS c, least(greatest(round((x+1)*127.5e0),0),255) AS b FROM (SELECT id, generate_subscripts(v,1) AS pos, unnest(v) AS x FROM emb) t)"
ORACLES: dict[str, str] = {
    "embedding_bank": f"WITH {V.EMB} SELECT id, cls, CAST(id%5 AS INT) AS fold, CASE WHEN id%2=0 THEN 'train' ELSE 'test' END AS bank, round(list_dot_product(v,v),5) AS norm FROM emb WHERE id%5=2",
    "class_reference_table": f"WITH {V.EMB}, {V._scored('id%2=0')}, t AS (SELECT quantile_cont(ood_score,0.95) AS t FROM ood WHERE id%2=0), n AS (SELECT cls, count(*) AS n FROM emb WHERE id%2=0 GROUP BY cls) SELECT cls, any_value(n) AS n, CAST(count(*) AS INT) AS width, round(sum(s),4) AS spread, round(any_value(t),4) AS ood_threshold FROM ref JOIN n USING (cls) CROSS JOIN t GROUP BY cls",
    "predictions_table": f"WITH {E.PRED} SELECT model, experiment, seed, CAST(filename%2 AS INT) AS fold, count(*) AS n, round(avg(p),6) AS mean_p FROM pred WHERE model='ModelB' AND experiment='Raw' GROUP BY ALL",
    "training_history_table": f"WITH {HISTORY} SELECT run_id, epoch, round(CASE WHEN epoch>10 THEN val_f1/2 ELSE val_f1 END,6) AS val_f1, round(val_loss,6) AS val_loss FROM h",
    "selected_manifest": f"SELECT qid, cls, score FROM ({V.ORACLES['selection_scores']}) t WHERE selected=1",
    "concat_class_results": f"{V.FEATURES} SELECT qid, cls, round(own_mean,6) AS own_mean, CASE WHEN cls=0 THEN round(density,6) END AS density FROM f",
    "screening_tables": f"SELECT grp, roi, n_frames, mean_p, prediction FROM ({E.ORACLES['roi_screening_summary']}) t",
    "materialize_by_fingerprint": f"WITH {V.EMB} SELECT cls, count(*) AS n, 0 AS hit_before, 1 AS hit_after FROM emb GROUP BY cls",
    "ema_by_key_stream": E.ORACLES["ema_by_key"],
    "score_stream": V.ORACLES["mahalanobis_ood"],
    "total_variation": f"WITH {PIXELS}, dv AS (SELECT p.id, avg(abs(p.b-q.b))/255 AS d FROM px p JOIN px q ON p.id=q.id AND p.c=q.c AND q.r=p.r+1 GROUP BY p.id), dh AS (SELECT p.id, avg(abs(p.b-q.b))/255 AS d FROM px p JOIN px q ON p.id=q.id AND p.r=q.r AND q.c=p.c+1 GROUP BY p.id) SELECT dv.id, round(dv.d+dh.d,6) AS tv FROM dv JOIN dh USING (id)",
    "haar_energy": f"WITH {PIXELS}, q AS (SELECT id, r//2 AS i, c//2 AS j, sum(CASE WHEN r%2=0 AND c%2=0 THEN b ELSE 0 END) AS a, sum(CASE WHEN r%2=0 AND c%2=1 THEN b ELSE 0 END) AS b, sum(CASE WHEN r%2=1 AND c%2=0 THEN b ELSE 0 END) AS c, sum(CASE WHEN r%2=1 AND c%2=1 THEN b ELSE 0 END) AS d FROM px GROUP BY id, r//2, c//2) SELECT id, round(avg(abs(a-b+c-d))/510,6) AS lh, round(avg(abs(a+b-c-d))/510,6) AS hl, round(avg(abs(a-b-c+d))/510,6) AS hh FROM q GROUP BY id",
    "tissue_coverage": f"WITH {PIXELS} SELECT id, round(avg(CASE WHEN b>127 THEN 1e0 ELSE 0e0 END),6) AS coverage FROM px GROUP BY id",
    "fluorescence_stats": f"WITH {PIXELS}, g AS (SELECT id, b/255 AS g FROM px), m AS (SELECT id, avg(g)+5e-1*stddev_pop(g) AS t FROM g GROUP BY id), w AS (SELECT g.id, g.g, 1/(1+exp(-(g.g-m.t)/8e-2)) AS w FROM g JOIN m USING (id)), f AS (SELECT id, sum(w*g)/(sum(w)+1e-8) AS mu FROM w GROUP BY id) SELECT w.id, round(avg(w),6) AS coverage, round(any_value(mu),6) AS fg_mean, round(sqrt(sum(w*(g-mu)*(g-mu))/(sum(w)+1e-8)),6) AS fg_std FROM w JOIN f USING (id) GROUP BY w.id",
    "grayscale": f"WITH {V.EMB} SELECT id, round(0.299e0*v[1]+0.587e0*v[2]+0.114e0*v[3],6) AS gray, round((list_distance(v,list_reverse(v))*list_distance(v,list_reverse(v))/64)/(list_dot_product(v,v)/64+1e-8),6) AS rel_mse, round(pow(greatest(v[1]-v[2],0),2)/((v[2]+1)*(v[2]+1)+1e-8),6) AS hinge FROM emb",
    "softmax": f"WITH {V.EMB}, z AS (SELECT id, generate_subscripts(v[1:4],1)-1 AS k, exp(unnest(v[1:4])/5e-1) AS e FROM emb), p AS (SELECT id, k, e/sum(e) OVER (PARTITION BY id) AS p FROM z) SELECT id, round(max(p),6) AS confidence, round(-sum(p*ln(p)),6) AS entropy, CAST(max_by(k, p) AS INT) AS best FROM p GROUP BY id",
    "pair_metric": f"WITH {V.EMB}, {V._knn('q.cls=d.cls', 1)} SELECT qid, did, round(list_sum(list_transform(range(1,65), lambda i: abs(a.v[i]-b.v[i]))),6) AS city_block FROM near JOIN emb a ON a.id=qid JOIN emb b ON b.id=did",
    "embed": f"WITH {V.EMB}, h AS (SELECT id, list_transform(range(1,33), lambda i: v[i]+v[i+32]) AS h FROM emb) SELECT id, round(h[1]/sqrt(list_dot_product(h,h)),4) AS first, round(1e0,4) AS norm FROM h",
    "extra_quality_metric": f"""{V.FEATURES}, pm AS ({{pm}}), u AS (SELECT f.qid, f.cls, own_mean, margin, city_block FROM f JOIN pm USING (qid)),
 n AS (SELECT *, min(own_mean) OVER w AS a0, max(own_mean) OVER w AS a1, min(margin) OVER w AS b0, max(margin) OVER w AS b1, min(city_block) OVER w AS c0, max(city_block) OVER w AS c1 FROM u WINDOW w AS (PARTITION BY cls))
 SELECT qid, cls, round(city_block,6) AS city_block, round(5e-1*(own_mean-a0)/(a1-a0)+3e-1*(margin-b0)/(b1-b0)+2e-1*(1-(city_block-c0)/(c1-c0)),6) AS score FROM n""",
    "averaged_views": f"WITH {V.EMB}, p AS (SELECT id, list_avg(list_transform(range(0,4), lambda i: 1/(1+exp(v[i*2+1]-v[i*2+2])))) AS p FROM emb) SELECT id, round(p,6) AS p, CASE WHEN p>=5e-1 THEN 1 ELSE 0 END AS pred FROM p",
}
_CITY = ORACLES["pair_metric"].replace("round(list_sum(", "(list_sum(").replace(",6) AS city_block", ") AS city_block").replace("SELECT qid, did, (", "SELECT qid, (")
ORACLES["extra_quality_metric"] = ORACLES["extra_quality_metric"].replace("{pm}", _CITY)
