"""SQL for the oracle of the evaluation queries, written apart from the operators that they check."""

from __future__ import annotations

#: Prediction rows: three models, two conditions, three seeds.
PRED = """pred AS (
  SELECT m.model, x.experiment, s.seed, b.event_id AS filename, b.user_id, b.y,
         7e-1*p0 + 3e-1*((event_id*(7+2*m.k+4*x.k+6*s.k))%101)/101e0 AS p
  FROM (SELECT event_id, user_id, value/(value+40e0) AS p0,
               CASE WHEN 7e-1*value/(value+40e0) + 3e-1*((event_id*13)%97)/97e0 > 5e-1 THEN 1 ELSE 0 END AS y
        FROM events) b
  CROSS JOIN (VALUES ('ModelA',0),('ModelB',1),('ModelC',2)) m(model,k)
  CROSS JOIN (VALUES ('Raw',0),('Raw_SelectedSynthetic',1)) x(experiment,k)
  CROSS JOIN (VALUES (42,0),(100,1),(123,2)) s(seed,k))"""
RUN = "model, experiment, seed"

#: One conditional aggregation gives every count that the closed forms need.
COUNTS = f"""counts AS (
  SELECT {RUN}, CAST(sum(CASE WHEN y=1 AND p>=5e-1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
         CAST(sum(CASE WHEN y=0 AND p>=5e-1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
         CAST(sum(CASE WHEN y=1 AND p<5e-1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
         CAST(sum(CASE WHEN y=0 AND p<5e-1 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM pred GROUP BY {RUN})"""

METRICS = f"""rates AS (
  SELECT *, tp+fp+fn+tn AS n, coalesce(tp/nullif(tp+fn,0),0) AS r1, coalesce(tn/nullif(tn+fp,0),0) AS r0,
         coalesce(tp/nullif(tp+fp,0),0) AS p1, coalesce(tn/nullif(tn+fn,0),0) AS p0 FROM counts),
metrics AS (
  SELECT *, coalesce(2*p1*r1/nullif(p1+r1,0),0) AS f1, coalesce(2*p0*r0/nullif(p0+r0,0),0) AS f0, (tp+tn)/n AS acc,
         coalesce((tp*tn-fp*fn)/nullif(sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)),0),0) AS mcc,
         ((tp+fp)*(tp+fn)+(tn+fp)*(tn+fn))/(n*n) AS pe FROM rates)"""
FINAL = f"""final AS (
  SELECT {RUN}, CAST(n AS BIGINT) AS n, acc AS accuracy, (r0+r1)/2 AS balanced_accuracy, (p0+p1)/2 AS precision_macro, (r0+r1)/2 AS recall_macro,
         (f0+f1)/2 AS f1_macro, (f1*(tp+fn)+f0*(tn+fp))/n AS f1_weighted, (r0+r1)/2 AS specificity_macro, mcc, (acc-pe)/nullif(1-pe,0) AS kappa
  FROM metrics)"""
HEAD = f"WITH {PRED}, {COUNTS}, {METRICS}, {FINAL}"

#: Average ranks of tied scores, per run; scores are grouped first, so the window sees one row a score.
RANKS = f"""scores AS (SELECT {RUN}, p, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM pred GROUP BY {RUN}, p),
ranked AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {RUN} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) - (n-1)/2e0 AS r FROM scores),
auc AS (SELECT {RUN}, (sum(r*pos) - CAST(sum(pos) AS DOUBLE)*(sum(pos)+1)/2e0) / nullif(CAST(sum(pos) AS DOUBLE)*CAST(sum(n)-sum(pos) AS DOUBLE),0) AS roc_auc FROM ranked GROUP BY {RUN})"""
CURVE = f"""scores AS (SELECT {RUN}, p, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM pred GROUP BY {RUN}, p),
cum AS (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(n-pos) OVER w AS DOUBLE) AS fp,
        CAST(sum(pos) OVER (PARTITION BY {RUN}) AS DOUBLE) AS np, CAST(sum(n-pos) OVER (PARTITION BY {RUN}) AS DOUBLE) AS nn
        FROM scores WINDOW w AS (PARTITION BY {RUN} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curve AS (SELECT {RUN}, p AS threshold, fp/nn AS fpr, tp/np AS tpr, tp/(tp+fp) AS prec, pos/np AS step FROM cum)"""


def _r(names: str) -> str:
    return ", ".join(f"round({x}, 6) AS {x}" for x in names.split())


ALL = "accuracy balanced_accuracy precision_macro recall_macro f1_macro f1_weighted specificity_macro mcc kappa"
NAMES = ALL.split()


def _normal_tail(z: str) -> str:
    """P(Z > z) by Simpson's rule; the oracle's engine has no error function."""
    return f"(5e-1 - ({z})/6000*list_sum(list_transform(range(0,2001), lambda i: CASE WHEN i=0 OR i=2000 THEN 1e0 WHEN i%2=1 THEN 4e0 ELSE 2e0 END * exp(-(({z})*i/2e3)*(({z})*i/2e3)/2e0)))/sqrt(2*pi()))"


LONG = " UNION ALL ".join(f"SELECT {RUN}, '{m}' AS metric, {m} AS v FROM final" for m in NAMES)
PAIRS = f"""long AS (SELECT model, experiment, seed, 'accuracy' AS metric, accuracy AS v FROM final UNION ALL SELECT model, experiment, seed, 'f1_macro', f1_macro FROM final),
pairs AS (SELECT a.model, a.seed, a.metric, a.v AS a, b.v AS b, b.v-a.v AS d FROM long a JOIN long b ON a.model=b.model AND a.seed=b.seed AND a.metric=b.metric AND a.experiment='Raw' AND b.experiment='Raw_SelectedSynthetic')"""
TWO = f"two AS (SELECT {RUN}, y, round(p,12) AS p, round(1-round(p,12),12) AS q FROM base)"

SCREEN = f"""{PRED}, alias AS (SELECT * FROM (VALUES ('healthy','normal'),('normal','normal'),('smoker','smoke'),('smoking','smoke'),('smoke','smoke'),('malignant','cancer'),('oscc','cancer'),('tumor','cancer'),('cancer','cancer')) a(raw, name)),
ranks AS (SELECT * FROM (VALUES ('normal',0),('smoke',1),('cancer',2)) r(name, group_rank)),
members AS (SELECT filename, user_id AS roi, model AS member, p AS p_raw, CASE filename%3 WHEN 0 THEN 'healthy' WHEN 1 THEN ' Smo-ker' ELSE 'OSCC' END AS raw_group FROM pred WHERE experiment='Raw' AND seed=42),
named AS (SELECT m.*, a.name AS grp, r.group_rank FROM members m LEFT JOIN alias a ON replace(replace(replace(lower(trim(raw_group)),' ',''),'-',''),'_','') = a.raw LEFT JOIN ranks r ON a.name=r.name),
screen0 AS (SELECT filename, roi, grp, group_rank, avg(least(1e0, p_raw+5e-2*group_rank)) AS p, stddev_pop(least(1e0, p_raw+5e-2*group_rank)) AS epistemic FROM named GROUP BY filename, roi, grp, group_rank),
screen AS (SELECT *, greatest(p,1-p) AS confidence, -(p*ln(greatest(p,1e-8))+(1-p)*ln(greatest(1-p,1e-8))) AS entropy FROM screen0)"""
SRANK = """sr AS (SELECT *, CAST(rank() OVER (ORDER BY p) AS DOUBLE) + (count(*) OVER (PARTITION BY p) - 1)/2e0 AS rp,
  CAST(rank() OVER (ORDER BY group_rank) AS DOUBLE) + (count(*) OVER (PARTITION BY group_rank) - 1)/2e0 AS rg FROM (SELECT group_rank, round(p, 9) AS p FROM screen) s)"""

BINS = "bin AS (SELECT *, CASE WHEN p>=5e-1 THEN p ELSE 1-p END AS conf, CASE WHEN (p>=5e-1 AND y=1) OR (p<5e-1 AND y=0) THEN 1e0 ELSE 0e0 END AS hit FROM pred)"

KRUSKAL = """g AS (SELECT group_rank, sum(rp) AS s, CAST(count(*) AS DOUBLE) AS n FROM sr GROUP BY group_rank), t AS (SELECT sum(c*c*c-c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM sr GROUP BY p) x), a AS (SELECT sum(s*s/n) AS q, sum(n) AS n FROM g), kw AS (SELECT (12e0/(a.n*(a.n+1))*a.q-3*(a.n+1))/(1-t.tie/(a.n*a.n*a.n-a.n)) AS h, CAST(a.n AS BIGINT) AS n FROM a CROSS JOIN t)"""
KNOWN = """kn AS (SELECT CASE WHEN grp='cancer' THEN 1 ELSE 0 END AS y, rank() OVER (ORDER BY round(p,9)) + (count(*) OVER (PARTITION BY round(p,9))-1)/2e0 AS r FROM screen WHERE grp IN ('normal','cancer')), known AS (SELECT (sum(CASE WHEN y=1 THEN r ELSE 0e0 END)-sum(y)*(sum(y)+1)/2e0)/(sum(y)*(count(*)-sum(y))*1e0) AS roc_auc FROM kn)"""
MEASURED = "accuracy balanced_accuracy f1_macro mcc roc_auc pr_auc ece mce brier".split()
BENCH = f"""WITH {PRED}, {COUNTS}, {METRICS}, {FINAL}, {RANKS}, {BINS}, edged AS (SELECT {RUN}, conf, hit, greatest(CAST(ceil(conf*10) AS INT)-1, 0) AS b FROM bin), each AS (SELECT {RUN}, b, count(*) AS n, avg(conf) AS c, avg(hit) AS a FROM edged GROUP BY {RUN}, b),
 e AS (SELECT {RUN}, sum(n*abs(a-c))/sum(n) AS ece, max(abs(a-c)) AS mce FROM each GROUP BY {RUN}), br AS (SELECT {RUN}, avg((p-y)*(p-y)) AS brier FROM pred GROUP BY {RUN}),
 cum2 AS (SELECT *, sum(pos) OVER w*1e0 AS tp, sum(n) OVER w*1e0 AS k, sum(pos) OVER (PARTITION BY {RUN})*1e0 AS np FROM scores WINDOW w AS (PARTITION BY {RUN} ORDER BY p DESC)), ap AS (SELECT {RUN}, sum(pos/np*tp/k) AS pr_auc FROM cum2 GROUP BY {RUN}),
 m AS (SELECT model, experiment, {", ".join(f"avg({x}) AS {x}" for x in MEASURED)}, stddev_pop(f1_macro) AS f1_macro_std, stddev_pop(mcc) AS mcc_std FROM final JOIN auc USING ({RUN}) JOIN e USING ({RUN}) JOIN br USING ({RUN}) JOIN ap USING ({RUN}) GROUP BY model, experiment),
 unit AS (SELECT model, experiment, {", ".join(f"coalesce(({x}-min({x}) OVER ())/nullif(max({x}) OVER ()-min({x}) OVER (),0),5e-1) AS {x}" for x in [*MEASURED, "f1_macro_std", "mcc_std"])} FROM m)"""

ORACLES: dict[str, str] = {
    "brier_score": f"WITH {PRED} SELECT {RUN}, round(avg((p-y)*(p-y)), 6) AS brier FROM pred GROUP BY {RUN}",
    "ece_mce": f"""WITH {PRED}, {BINS}, edged AS (SELECT {RUN}, conf, hit, greatest(CAST(ceil(conf*10) AS INT)-1, 0) AS b FROM bin),
 each AS (SELECT {RUN}, b, count(*) AS n, avg(conf) AS c, avg(hit) AS a FROM edged GROUP BY {RUN}, b)
 SELECT {RUN}, round(sum(n*abs(a-c))/sum(n), 6) AS ece, round(max(abs(a-c)), 6) AS mce FROM each GROUP BY {RUN}""",
    "reliability_bins": f"""WITH {PRED}, edged AS (SELECT {RUN}, p, y, least(CAST(floor(p*10) AS INT), 9) AS b FROM pred)
 SELECT {RUN}, round(b/10e0, 6) AS bin_lower, round((b+1)/10e0, 6) AS bin_upper, count(*) AS n, round(avg(p), 6) AS mean_pred, round(avg(CAST(y AS DOUBLE)), 6) AS observed FROM edged GROUP BY {RUN}, b""",
    "mean_confusion": f"WITH {PRED}, {COUNTS} SELECT model, experiment, round(avg(tn),6) AS tn, round(avg(fp),6) AS fp, round(avg(fn),6) AS fn, round(avg(tp),6) AS tp FROM counts GROUP BY model, experiment",
    "pooled_confusion": f"WITH {PRED}, {COUNTS} SELECT model, experiment, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp FROM counts GROUP BY model, experiment",
    "roc_auc": f"WITH {PRED}, {RANKS} SELECT {RUN}, round(roc_auc, 6) AS roc_auc FROM auc",
    "average_precision": f"WITH {PRED}, {CURVE} SELECT {RUN}, round(sum(step*prec), 6) AS average_precision FROM curve GROUP BY {RUN}",
    "pr_auc_mean": f"WITH {PRED}, {CURVE}, ap AS (SELECT {RUN}, sum(step*prec) AS ap FROM curve GROUP BY {RUN}) SELECT model, experiment, round(avg(ap), 6) AS pr_auc FROM ap GROUP BY model, experiment",
    "youden_threshold": f"WITH {PRED}, {CURVE}, best AS (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY round(tpr-fpr, 12) DESC, threshold DESC) AS rn FROM curve) SELECT {RUN}, round(least(1e0, greatest(0e0, threshold)), 9) AS threshold, round(tpr-fpr, 6) AS youden FROM best WHERE rn=1",
    "align_predictions": f"WITH {PRED}, kept AS (SELECT * FROM pred WHERE NOT (model='ModelC' AND filename%1000=7)), n AS (SELECT experiment, seed, model, count(*) AS n FROM kept GROUP BY experiment, seed, model), o AS (SELECT a.experiment, a.seed, b.model, count(*) AS both_n FROM kept a JOIN kept b ON a.experiment=b.experiment AND a.seed=b.seed AND a.filename=b.filename AND a.y=b.y WHERE a.model='ModelA' GROUP BY a.experiment, a.seed, b.model) SELECT o.experiment, o.seed, o.model, o.both_n, CASE WHEN o.both_n=n.n AND n.n=r.n THEN 1 ELSE 0 END AS aligned FROM o JOIN n ON o.experiment=n.experiment AND o.seed=n.seed AND o.model=n.model JOIN n r ON o.experiment=r.experiment AND o.seed=r.seed AND r.model='ModelA'",
    "pair_experiments": f"{HEAD} SELECT r.model, r.seed, round(r.f1_macro,6) AS raw_f1, round(s.f1_macro,6) AS synthetic_f1, round(s.f1_macro-r.f1_macro,6) AS delta, CASE WHEN s.f1_macro-r.f1_macro>5e-3 THEN 'synthetic HELPED' WHEN s.f1_macro-r.f1_macro<-5e-3 THEN 'synthetic HURT' ELSE 'no change' END AS verdict FROM final r JOIN final s ON r.model=s.model AND r.seed=s.seed AND r.experiment='Raw' AND s.experiment='Raw_SelectedSynthetic'",
    "otsu_by_key": """WITH h AS (SELECT event_type AS k, CAST(least(floor(value),255) AS INT) AS v, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type, CAST(least(floor(value),255) AS INT)),
 c AS (SELECT k, v, sum(n) OVER w AS w0, sum(n*v) OVER w AS m0, sum(n) OVER (PARTITION BY k) AS t, sum(n*v) OVER (PARTITION BY k) AS mt FROM h WINDOW w AS (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 s AS (SELECT k, v, coalesce(w0*(t-w0)*(m0/w0-(mt-m0)/nullif(t-w0,0))*(m0/w0-(mt-m0)/nullif(t-w0,0)),0) AS between_var FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(between_var,3) DESC, v) AS rn FROM s)
 SELECT k AS event_type, v AS threshold FROM r WHERE rn=1""",
    "best_epoch": "WITH h AS (SELECT user_id%12 AS run_id, row_number() OVER (PARTITION BY user_id%12 ORDER BY event_id) AS epoch, value/(value+40e0) AS val_f1, 1e0/(1e0+value) AS val_loss FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_f1 DESC, val_loss, epoch) AS rn FROM h) SELECT run_id, CAST(epoch AS BIGINT) AS best_epoch, round(val_f1,6) AS val_f1, round(val_loss,6) AS val_loss FROM r WHERE rn=1",
    "min_max_norm": "WITH v AS (SELECT event_id, event_type, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events) SELECT event_id, event_type, round(CASE WHEN value IS NULL THEN NULL WHEN hi=lo THEN 5e-1 ELSE (value-lo)/(hi-lo) END,6) AS norm, round(CASE WHEN value IS NULL THEN NULL WHEN hi=lo THEN 5e-1 ELSE 1-(value-lo)/(hi-lo) END,6) AS inverted FROM v",
    "class_weights": f"WITH {PRED}, c AS (SELECT {RUN}, y, count(*) AS n FROM pred GROUP BY {RUN}, y) SELECT {RUN}, y AS label, round(sum(n) OVER (PARTITION BY {RUN}) / (2e0*n), 6) AS weight FROM c",
    "rank_models": f"WITH {PRED}, {COUNTS}, {METRICS}, {FINAL}, {RANKS}, m AS (SELECT f.model, f.experiment, round(avg(f.f1_macro),6) AS f1, round(avg(a.roc_auc),6) AS auc, round(avg(f.accuracy),6) AS acc FROM final f JOIN auc a ON f.model=a.model AND f.experiment=a.experiment AND f.seed=a.seed GROUP BY f.model, f.experiment) SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, auc DESC, acc DESC, model, experiment) AS BIGINT) AS rnk FROM m",
    "confusion_matrix": f"WITH {PRED}, {COUNTS} SELECT {RUN}, 0 AS truth, CAST(tn AS BIGINT) AS pred_0, CAST(fp AS BIGINT) AS pred_1 FROM counts UNION ALL SELECT {RUN}, 1, CAST(fn AS BIGINT), CAST(tp AS BIGINT) FROM counts",
    "classification_metrics": f"{HEAD} SELECT {RUN}, n, {_r(ALL)} FROM final",
    "per_class_metrics": f"""WITH {PRED}, {COUNTS}, {METRICS}, c AS (SELECT {RUN}, 1 AS label, tp, fp, fn, tn, p1 AS p, r1 AS r, f1 AS f, r0 AS sp FROM metrics UNION ALL SELECT {RUN}, 0, tn, fn, fp, tp, p0, r0, f0, r1 FROM metrics)
 SELECT {RUN}, label, CAST(tp+fn AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(p,6) AS precision, round(r,6) AS recall, round(f,6) AS f1, round(sp,6) AS specificity FROM c""",
    "run_mean_std": f"{HEAD} SELECT model, experiment, {', '.join(f'round(avg({m}),6) AS {m}_mean, round(stddev_pop({m}),6) AS {m}_std' for m in NAMES)} FROM final GROUP BY model, experiment",
    "cv_mean_std": f"{HEAD} SELECT model, experiment, count(*) AS n_folds, {', '.join(f'round(avg({m}),6) AS {m}_mean, round(stddev_samp({m}),6) AS {m}_std' for m in NAMES)} FROM final GROUP BY model, experiment",
    "metrics_long": f"{HEAD}, long AS ({LONG}) SELECT {RUN}, metric, round(v,6) AS value FROM long",
    "cv_summary": f"{HEAD}, long AS ({LONG}) SELECT model, experiment, metric, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS std, count(*) AS n_folds FROM long GROUP BY model, experiment, metric",
    "cv_comparison": f"{HEAD} SELECT model, experiment, {', '.join(f'round(avg({m}),6) AS {m}' for m in NAMES)} FROM final GROUP BY model, experiment",
    "roc_auc_macro_micro": f"""WITH {PRED.replace('pred AS', 'base AS', 1)}, {TWO}, parts AS (SELECT 'micro' AS part, {RUN}, y, p FROM two UNION ALL SELECT 'micro', {RUN}, 1-y, q FROM two UNION ALL SELECT 'one', {RUN}, y, p FROM two UNION ALL SELECT 'zero', {RUN}, 1-y, q FROM two),
 scores AS (SELECT part, {RUN}, p, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM parts GROUP BY part, {RUN}, p), ranked AS (SELECT *, CAST(sum(n) OVER (PARTITION BY part, {RUN} ORDER BY p) AS DOUBLE) - (n-1)/2e0 AS r FROM scores),
 auc AS (SELECT part, {RUN}, (sum(r*pos) - CAST(sum(pos) AS DOUBLE)*(sum(pos)+1)/2e0) / (CAST(sum(pos) AS DOUBLE)*CAST(sum(n)-sum(pos) AS DOUBLE)) AS a FROM ranked GROUP BY part, {RUN})
 SELECT {RUN}, round(avg(CASE WHEN part<>'micro' THEN a END),6) AS macro, round(max(CASE WHEN part='micro' THEN a END),6) AS micro FROM auc GROUP BY {RUN}""",
    "roc_auc_per_class": f"""WITH {PRED.replace('pred AS', 'base AS', 1)}, {TWO}, parts AS (SELECT 1 AS label, {RUN}, y, p FROM two UNION ALL SELECT 0, {RUN}, 1-y, q FROM two),
 ranked AS (SELECT *, rank() OVER (PARTITION BY label, {RUN} ORDER BY p) + (count(*) OVER (PARTITION BY label, {RUN}, p)-1)/2e0 AS r FROM parts)
 SELECT {RUN}, label, round((sum(CASE WHEN y=1 THEN r ELSE 0 END) - sum(y)*(sum(y)+1)/2e0)/(sum(y)*(count(*)-sum(y))*1e0),6) AS roc_auc FROM ranked GROUP BY {RUN}, label""",
    "roc_curve": f"WITH {PRED}, {CURVE} SELECT {RUN}, round(threshold, 9) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve UNION ALL SELECT DISTINCT {RUN}, CAST('inf' AS DOUBLE), 0e0, 0e0 FROM pred",
    "per_class_youden": f"""WITH {PRED.replace('pred AS', 'base AS', 1)}, {TWO}, parts AS (SELECT 1 AS label, {RUN}, y, p FROM two UNION ALL SELECT 0, {RUN}, 1-y, q FROM two),
 c AS (SELECT label, {RUN}, p, sum(sum(y)) OVER w*1e0/sum(sum(y)) OVER (PARTITION BY label, {RUN}) - sum(count(*)-sum(y)) OVER w*1e0/sum(count(*)-sum(y)) OVER (PARTITION BY label, {RUN}) AS j FROM parts GROUP BY label, {RUN}, p WINDOW w AS (PARTITION BY label, {RUN} ORDER BY p DESC)),
 b AS (SELECT *, row_number() OVER (PARTITION BY label, {RUN} ORDER BY round(j,12) DESC, p DESC) AS rn FROM (SELECT label, {RUN}, p, j FROM c UNION ALL SELECT DISTINCT label, {RUN}, CAST('Infinity' AS DOUBLE), 0e0 FROM c) u) SELECT {RUN}, label, round(p,6) AS threshold, round(j,6) AS youden FROM b WHERE rn=1""",
    "mean_roc_on_grid": f"""WITH {PRED}, {CURVE}, grid AS (SELECT CAST(g AS INT) AS k, g/199e0 AS x FROM range(0,200) t(g)),
 pts AS (SELECT {RUN}, fpr, max(tpr) AS tpr, min(tpr) AS low FROM (SELECT {RUN}, fpr, tpr FROM curve UNION ALL SELECT DISTINCT {RUN}, 0e0, 0e0 FROM curve) u GROUP BY {RUN}, fpr),
 seg AS (SELECT {RUN}, fpr AS x0, tpr AS y0, lead(fpr) OVER w AS x1, lead(low) OVER w AS y1 FROM pts WINDOW w AS (PARTITION BY {RUN} ORDER BY fpr)),
 hit AS (SELECT s.model, s.experiment, s.seed, g.k, CASE WHEN g.k=0 THEN 0e0 WHEN s.x1 IS NULL THEN s.y0 ELSE s.y0+(s.y1-s.y0)*(g.x-s.x0)/(s.x1-s.x0) END AS t FROM seg s JOIN grid g ON g.x>=s.x0 AND (s.x1 IS NULL OR g.x<s.x1))
 SELECT model, experiment, k, round(avg(t), 5) AS tpr_mean, round(stddev_pop(t), 5) AS tpr_std FROM hit GROUP BY model, experiment, k""",
    "temperature_grid": f"""WITH {PRED}, t AS (SELECT * FROM (VALUES (0.25e0),(0.5e0),(0.75e0),(1e0),(1.5e0),(2e0),(3e0),(5e0)) t(temp)),
 nll AS (SELECT {RUN}, temp, avg(ln(1e0+exp(-(CASE WHEN y=1 THEN 1e0 ELSE -1e0 END)*ln(p/(1e0-p))/temp))) AS nll FROM pred CROSS JOIN t GROUP BY {RUN}, temp), r AS (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY nll, temp) AS rn FROM nll)
 SELECT {RUN}, temp AS temperature, round(nll, 6) AS nll FROM r WHERE rn=1""",
    "apply_threshold": f"WITH {PRED} SELECT {RUN}, filename, CASE WHEN p>=4.5e-1 THEN 1 ELSE 0 END AS at_threshold, CASE WHEN p>1-p THEN 1 ELSE 0 END AS argmax_class, round(greatest(p,1-p), 6) AS confidence, round(-(p*ln(greatest(p,1e-8))+(1-p)*ln(greatest(1-p,1e-8))), 6) AS entropy FROM pred",
    "hard_examples": f"WITH {PRED}, h AS (SELECT {RUN}, filename, y AS truth, CASE WHEN p>=5e-1 THEN 1 ELSE 0 END AS pred, greatest(p,1-p) AS p_pred, CASE WHEN y=1 THEN p ELSE 1-p END AS p_truth FROM pred), k AS (SELECT *, round(p_pred-p_truth,9) AS hardness, row_number() OVER (PARTITION BY {RUN} ORDER BY round(p_pred-p_truth,9) DESC, filename) AS rn FROM h) SELECT {RUN}, filename, truth, pred, round(p_pred,6) AS p_pred, round(p_truth,6) AS p_truth, hardness FROM k WHERE rn<=10",
    "stratified_pick": f"""WITH {PRED}, c AS (SELECT {RUN}, filename, y AS truth, CASE WHEN p>=5e-1 THEN 1 ELSE 0 END AS pred FROM pred), d AS (SELECT *, CASE WHEN truth=pred THEN 1 ELSE 0 END AS correct FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY {RUN}, truth, correct ORDER BY filename) AS nth FROM d),
 first4 AS (SELECT * FROM k WHERE nth<=4), rest AS (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY filename) AS o FROM k WHERE nth>4), have AS (SELECT {RUN}, count(*) AS h FROM first4 GROUP BY {RUN})
 SELECT {RUN}, filename, truth, pred, correct FROM first4 UNION ALL SELECT r.model, r.experiment, r.seed, r.filename, r.truth, r.pred, r.correct FROM rest r JOIN have h ON r.model=h.model AND r.experiment=h.experiment AND r.seed=h.seed WHERE r.o<=16-h.h""",
    "soft_vote": f"""WITH {PRED}, {CURVE}, best AS (SELECT {RUN}, threshold, row_number() OVER (PARTITION BY {RUN} ORDER BY round(tpr-fpr, 12) DESC, threshold DESC) AS rn FROM curve), cuts AS (SELECT experiment, seed, avg(least(1e0,greatest(0e0,threshold))) AS t FROM best WHERE rn=1 GROUP BY experiment, seed),
 v AS (SELECT experiment, seed, filename, y, avg(p) AS p FROM pred GROUP BY experiment, seed, filename, y HAVING count(DISTINCT model)>=2), counts AS (SELECT 0 AS model, v.experiment, v.seed, sum(CASE WHEN y=1 AND p>=t THEN 1e0 ELSE 0e0 END) AS tp, sum(CASE WHEN y=0 AND p>=t THEN 1e0 ELSE 0e0 END) AS fp, sum(CASE WHEN y=1 AND p<t THEN 1e0 ELSE 0e0 END) AS fn, sum(CASE WHEN y=0 AND p<t THEN 1e0 ELSE 0e0 END) AS tn FROM v JOIN cuts c ON v.experiment=c.experiment AND v.seed=c.seed GROUP BY v.experiment, v.seed), {METRICS}, {FINAL}
 SELECT experiment, seed, n, {_r(ALL)} FROM final""",
    "mcnemar": f"""WITH {PRED}, c AS (SELECT {RUN}, filename, CASE WHEN (p>=5e-1) = (y=1) THEN 1 ELSE 0 END AS ok FROM pred), j AS (SELECT a.experiment, a.seed, a.model AS model_a, b.model AS model_b, count(*) FILTER (a.ok=1 AND b.ok=0) AS c, count(*) FILTER (a.ok=0 AND b.ok=1) AS d FROM c a JOIN c b ON a.experiment=b.experiment AND a.seed=b.seed AND a.filename=b.filename AND a.model<b.model GROUP BY a.experiment, a.seed, a.model, b.model),
 s AS (SELECT *, CASE WHEN c+d=0 THEN 0e0 ELSE (abs(c-d)-1)*(abs(c-d)-1)*1e0/(c+d) END AS x FROM j) SELECT experiment, seed, model_a, model_b, c AS only_a, d AS only_b, round(x,6) AS statistic, round(CASE WHEN c+d=0 THEN 1e0 ELSE 2*{_normal_tail('sqrt(x)')} END,6) AS p FROM s""",
    "paired_ttest": f"""{HEAD}, {PAIRS}, t AS (SELECT model, metric, count(*) AS n, avg(b) AS bm, avg(a) AS am, avg(d) AS dm, avg(d)/nullif(stddev_samp(d)/sqrt(count(*)*1e0),0) AS t FROM pairs GROUP BY model, metric)
 SELECT model, metric, n, round(bm,6) AS b_mean, round(am,6) AS a_mean, round(dm,6) AS difference, round(t,4) AS t, round(1-abs(t)/sqrt(2+t*t),4) AS p FROM t""",
    "wilcoxon_signed_rank": f"""{HEAD}, {PAIRS}, k AS (SELECT model, metric, round(d,12) AS d, count(*) OVER (PARTITION BY model, metric, abs(round(d,12))) AS t, rank() OVER (PARTITION BY model, metric ORDER BY abs(round(d,12))) + (count(*) OVER (PARTITION BY model, metric, abs(round(d,12)))-1)/2e0 AS r FROM pairs WHERE round(d,12)<>0),
 s AS (SELECT model, metric, count(*) AS n, sum(t*t-1) AS tie, least(sum(CASE WHEN d>0 THEN r ELSE 0e0 END), sum(CASE WHEN d<0 THEN r ELSE 0e0 END)) AS w FROM k GROUP BY model, metric)
 SELECT model, metric, n, round(w,6) AS w, round(CASE WHEN tie>0 THEN least(1e0, 2*{_normal_tail('((n*(n+1)/4e0-w)/sqrt((n*(n+1)*(2*n+1)-tie/2e0)/24))')}) ELSE least(1e0, 2e0*len(list_filter(range(0, CAST(pow(2,n) AS BIGINT)), lambda m: list_sum(list_transform(range(0,n), lambda i: (i+1)*((m>>i)&1))) <= w))/pow(2,n)) END,6) AS p FROM s""",
    "canonical_group": f"WITH {SCREEN} SELECT raw_group, grp, group_rank, count(*) AS n, coalesce(group_rank,99) AS sort_key FROM named GROUP BY raw_group, grp, group_rank",
    "ensemble_signal": f"WITH {SCREEN} SELECT filename, roi, grp, round(p,6) AS p, round(epistemic,6) AS epistemic, round(confidence,6) AS confidence, round(entropy,6) AS entropy FROM screen",
    "group_screening_summary": f"WITH {SCREEN} SELECT grp, group_rank, count(*) AS n, round(avg(p),6) AS mean_p, round(stddev_pop(p),6) AS std_p, round(avg(p)-196e-2*stddev_samp(p)/sqrt(count(*)*1e0),6) AS ci_low, round(avg(p)+196e-2*stddev_samp(p)/sqrt(count(*)*1e0),6) AS ci_high, round(median(p),6) AS median_p, round(avg(confidence),6) AS mean_confidence, round(avg(entropy),6) AS mean_entropy, round(avg(epistemic),6) AS mean_epistemic, round(1e2*avg(CASE WHEN p>=5e-1 THEN 1e0 ELSE 0e0 END),6) AS percent_positive FROM screen GROUP BY grp, group_rank",
    "roi_screening_summary": f"WITH {SCREEN} SELECT grp, roi, count(*) AS n_frames, round(avg(p),6) AS mean_p, round(stddev_pop(p),6) AS std_p, round(avg(confidence),6) AS mean_confidence, round(avg(entropy),6) AS mean_entropy, round(avg(epistemic),6) AS mean_epistemic, CASE WHEN avg(p)>=5e-1 THEN 'cancer' ELSE 'normal' END AS prediction FROM screen GROUP BY grp, roi",
    "spearman_trend": f"WITH {SCREEN}, {SRANK}, r AS (SELECT corr(rg, rp) AS rho, count(*) AS n FROM sr) SELECT round(rho,6) AS rho, n, round(2*{_normal_tail('least(40e0, abs(rho)*sqrt((n-2)/(1-rho*rho)))')},6) AS p FROM r",
    "kruskal_wallis": f"WITH {SCREEN}, {SRANK}, {KRUSKAL} SELECT round(h,4) AS h, n, round(exp(-h/2),4) AS p FROM kw",
    "mann_whitney_adjacent": f"""WITH {SCREEN}, pairs AS (SELECT group_rank AS lo, round(p,9) AS p, 1 AS first FROM screen WHERE group_rank<2 UNION ALL SELECT group_rank-1, round(p,9), 0 FROM screen WHERE group_rank>0), k AS (SELECT lo, first, p, rank() OVER (PARTITION BY lo ORDER BY p)+(count(*) OVER (PARTITION BY lo, p)-1)/2e0 AS r FROM pairs),
 ties AS (SELECT lo, sum(c*c*c-c) AS tie FROM (SELECT lo, count(*)*1e0 AS c FROM k GROUP BY lo, p) x GROUP BY lo), s AS (SELECT lo, sum(first)*1e0 AS n1, (count(*)-sum(first))*1e0 AS n2, sum(CASE WHEN first=1 THEN r ELSE 0e0 END)-sum(first)*(sum(first)+1)/2e0 AS u FROM k GROUP BY lo),
 z AS (SELECT s.*, -(u+5e-1-n1*n2/2)/sqrt(n1*n2/12*((n1+n2+1)-tie/((n1+n2)*(n1+n2-1)))) AS z FROM s JOIN ties USING (lo))
 SELECT lo AS rank_low, lo+1 AS rank_high, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u,4) AS u, round({_normal_tail('least(40e0, greatest(-40e0, z))')},4) AS p FROM z""",
    "normal_vs_cancer_auc": f"WITH {SCREEN}, {KNOWN} SELECT round(roc_auc,6) AS roc_auc FROM known",
    "progression_statistics": f"WITH {SCREEN}, {SRANK}, {KRUSKAL}, {KNOWN}, r AS (SELECT corr(rg, rp) AS rho, count(*) AS n FROM sr), q AS (SELECT *, 2*{_normal_tail('least(40e0, abs(rho)*sqrt((n-2)/(1-rho*rho)))')} AS rp FROM r) SELECT round(rho,4) AS rho, round(rp,4) AS rho_p, q.n, round(h,4) AS h, round(exp(-h/2),4) AS h_p, round(roc_auc,4) AS roc_auc, CASE WHEN rho>3e-1 AND rp<5e-2 THEN 'monotone continuum' ELSE 'no monotone continuum' END AS verdict FROM q CROSS JOIN kw CROSS JOIN known",
    "benchmark_score": f"""{BENCH}, s AS (SELECT model, experiment, round((accuracy+balanced_accuracy+f1_macro+mcc+roc_auc+pr_auc)/6,6) AS classification, 5e-1 AS feature, round((3-ece-mce-brier)/3,6) AS calibration, round((balanced_accuracy+2-f1_macro_std-mcc_std)/3,6) AS robustness, 5e-1 AS efficiency FROM unit),
 o AS (SELECT *, round(35e-2*classification+25e-2*feature+15e-2*calibration+15e-2*robustness+1e-1*efficiency,6) AS ov FROM s) SELECT model, experiment, classification, feature, calibration, robustness, efficiency, round(ov,5) AS overall, row_number() OVER (ORDER BY ov DESC, model, experiment) AS rnk FROM o""",
    "bench_min_max": f"{BENCH} SELECT model, experiment, round(accuracy,5) AS n_accuracy, round(1-brier,5) AS n_brier FROM unit",
    "limitation_flags": f"""WITH {PRED}, {BINS}, edged AS (SELECT {RUN}, conf, hit, greatest(CAST(ceil(conf*10) AS INT)-1, 0) AS b FROM bin), each AS (SELECT {RUN}, b, count(*) AS n, avg(conf) AS c, avg(hit) AS a FROM edged GROUP BY {RUN}, b), e AS (SELECT {RUN}, sum(n*abs(a-c))/sum(n) AS ece FROM each GROUP BY {RUN}),
 f AS (SELECT {RUN}, concat_ws('; ', CASE WHEN model='ModelC' THEN 'over 30 M parameters' END, CASE WHEN ece>1e-1 THEN 'ECE over 0.1' END, CASE WHEN seed=42 THEN 'over 20 ms an image' END) AS flags FROM e) SELECT {RUN}, CASE WHEN flags='' THEN 'none' ELSE flags END AS flags FROM f""",
    "metric_histogram": "WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type) SELECT b.event_type, CASE WHEN event_id%5=0 THEN 1 ELSE 0 END AS selected, least(CAST(floor((value-lo)/(hi-lo)*30) AS INT),29) AS bin, count(*) AS n FROM events b JOIN e ON b.event_type=e.event_type WHERE hi>lo GROUP BY ALL",
    "score_correlation": "WITH m AS (SELECT corr(event_id,user_id) AS eu, corr(event_id,value) AS ev, corr(user_id,value) AS uv FROM events) SELECT * FROM (SELECT 'event_id' AS a, 'event_id' AS b, 1e0 AS r UNION ALL SELECT 'user_id','user_id',1e0 UNION ALL SELECT 'value','value',1e0 UNION ALL SELECT 'event_id','user_id',round(eu,6) FROM m UNION ALL SELECT 'event_id','value',round(ev,6) FROM m UNION ALL SELECT 'user_id','value',round(uv,6) FROM m) x",
    "run_record_rollup": "WITH h AS (SELECT user_id%12 AS run_id, row_number() OVER (PARTITION BY user_id%12 ORDER BY event_id) AS epoch, value/(value+40e0) AS val_f1, 1e0/(1e0+value) AS val_loss FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_f1 DESC, val_loss, epoch) AS rn FROM h), b AS (SELECT *, run_id%3 AS grp, run_id*10+5 AS ts FROM r WHERE rn=1) SELECT grp, round(avg(val_f1),6) AS val_f1_mean, round(stddev_pop(val_f1),6) AS val_f1_std, round(avg(val_loss),6) AS val_loss_mean, round(stddev_pop(val_loss),6) AS val_loss_std, round(avg(ts),6) AS train_seconds_mean, round(avg(epoch),6) AS best_epoch_mean, round(avg(ts*1e0/epoch),6) AS epoch_seconds_mean FROM b GROUP BY grp",
    "ema_by_key": "WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(sum(pow(99e-2, n-i)*CASE WHEN i=1 THEN 1e0 ELSE 1e0-99e-2 END*value),5) AS ema FROM e GROUP BY event_type",
}

_AT = COUNTS.replace("p>=5e-1", "p>=threshold").replace("p<5e-1", "p<threshold")
_EVALUATED = [*NAMES, "roc_auc", "average_precision", "ece", "mce", "brier", "temperature", "threshold", "youden"]
ORACLES["evaluation_pipeline"] = f"""WITH {PRED.replace('pred AS', 'base AS', 1)}, held AS (SELECT *, greatest(least(p,1-1e-12),1e-12) AS c, filename%3=0 AS valid FROM base), split AS (SELECT *, ln(c/(1-c)) AS z FROM held),
 grid AS (SELECT * FROM (VALUES (0.25e0),(0.5e0),(0.75e0),(1e0),(1.5e0),(2e0),(3e0),(5e0)) t(temperature)), nll AS (SELECT {RUN}, temperature, avg(ln(1e0+exp(-(CASE WHEN y=1 THEN 1e0 ELSE -1e0 END)*z/temperature))) AS nll FROM split CROSS JOIN grid WHERE valid GROUP BY {RUN}, temperature),
 fit AS (SELECT {RUN}, temperature FROM (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY nll, temperature) AS rn FROM nll) x WHERE rn=1), cal AS (SELECT {RUN}, filename, y, valid, 1/(1+exp(-z/temperature)) AS p FROM split JOIN fit USING ({RUN})),
 vs AS (SELECT {RUN}, p, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM cal WHERE valid GROUP BY {RUN}, p), vc AS (SELECT *, sum(pos) OVER w*1e0/sum(pos) OVER (PARTITION BY {RUN}) - sum(n-pos) OVER w*1e0/sum(n-pos) OVER (PARTITION BY {RUN}) AS j FROM vs WINDOW w AS (PARTITION BY {RUN} ORDER BY p DESC)),
 thr AS (SELECT {RUN}, least(1e0, greatest(0e0, p)) AS threshold, j AS youden FROM (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY round(j,12) DESC, p DESC) AS rn FROM vc) x WHERE rn=1), pred AS (SELECT {RUN}, filename, y, p, threshold FROM cal JOIN thr USING ({RUN}) WHERE NOT valid),
 {_AT}, {METRICS}, {FINAL}, {RANKS}, {BINS}, edged AS (SELECT {RUN}, conf, hit, greatest(CAST(ceil(conf*10) AS INT)-1, 0) AS b FROM bin), each AS (SELECT {RUN}, b, count(*) AS n, avg(conf) AS c, avg(hit) AS a FROM edged GROUP BY {RUN}, b),
 e AS (SELECT {RUN}, sum(n*abs(a-c))/sum(n) AS ece, max(abs(a-c)) AS mce FROM each GROUP BY {RUN}), br AS (SELECT {RUN}, avg((p-y)*(p-y)) AS brier FROM pred GROUP BY {RUN}),
 cum2 AS (SELECT *, sum(pos) OVER w*1e0 AS tp, sum(n) OVER w*1e0 AS k, sum(pos) OVER (PARTITION BY {RUN})*1e0 AS np FROM scores WINDOW w AS (PARTITION BY {RUN} ORDER BY p DESC)), ap AS (SELECT {RUN}, sum(pos/np*tp/k) AS average_precision FROM cum2 GROUP BY {RUN}),
 runs AS (SELECT * FROM final JOIN auc USING ({RUN}) JOIN e USING ({RUN}) JOIN br USING ({RUN}) JOIN ap USING ({RUN}) JOIN fit USING ({RUN}) JOIN thr USING ({RUN}))
 {" UNION ALL ".join(f"SELECT {RUN}, '{m}' AS metric, round({m},5) AS value FROM runs" for m in _EVALUATED)}"""
