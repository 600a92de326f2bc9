"""SQL for the oracle of the manifest queries."""

from __future__ import annotations

FILES = """files AS (SELECT doc_id, CASE WHEN CAST(substr(source,4) AS INT)%2=0 THEN 'real' ELSE 'synth' END AS origin,
  CASE WHEN doc_id%3=0 THEN 'cancer' ELSE 'normal' END AS class_name,
  concat('roi_',CAST((doc_id*7)%41 AS VARCHAR(20)),'_',CAST(20240101+doc_id%5 AS VARCHAR(20)),'_',CAST(100000+doc_id%60 AS VARCHAR(20)),'.png') AS filename,
  text AS content FROM documents)"""
REGION = "CASE WHEN filename IS NULL THEN NULL WHEN regexp_extract(lower(filename),'roi_([0-9]+)_([0-9]{8})_([0-9]{6})',1)='' THEN filename ELSE concat('roi',regexp_extract(lower(filename),'roi_([0-9]+)_([0-9]{8})_([0-9]{6})',1),'_',regexp_extract(lower(filename),'roi_([0-9]+)_([0-9]{8})_([0-9]{6})',2)) END"

ORACLES: dict[str, str] = {
    "class_counts": f"WITH {FILES} SELECT origin, class_name, count(*) AS n FROM files GROUP BY origin, class_name",
    "region_group": f"WITH {FILES} SELECT doc_id, {REGION} AS region FROM files",
    "roi_id": f"WITH {FILES} SELECT doc_id, concat(class_name,':',regexp_extract(lower(filename),'^roi_([0-9]+)_([0-9]{{8}})_([0-9]{{6}})',1)) AS roi FROM files",
    "synthetic_not_in_raw": f"WITH {FILES} SELECT f.doc_id, f.class_name, f.filename FROM files f LEFT JOIN (SELECT DISTINCT class_name AS c, filename AS n FROM files WHERE origin='real') r ON f.class_name=r.c AND f.filename=r.n WHERE f.origin='synth' AND r.n IS NULL",
    "pool_real": f"WITH {FILES}, k AS (SELECT doc_id, class_name, doc_id%3 AS root_order, concat('f',CAST(doc_id%700 AS VARCHAR(20))) AS base FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY root_order, class_name, doc_id) AS rn FROM k) SELECT doc_id, class_name, root_order, base FROM r WHERE rn=1",
    "common_classes": f"WITH {FILES} SELECT class_name FROM files WHERE origin='real' INTERSECT SELECT class_name FROM files WHERE origin='synth'",
    "missing_classes": f"WITH {FILES}, v AS (SELECT * FROM (VALUES ('normal'),('cancer'),('benign')) v(class_name)) SELECT class_name FROM v EXCEPT SELECT class_name FROM files",
    "add_selected_synthetic": f"WITH {FILES} SELECT doc_id, class_name, 'real' AS part, 'train' AS role FROM files WHERE origin='real' UNION ALL SELECT doc_id, class_name, 'synth' AS part, 'train' AS role FROM files WHERE origin='synth' AND doc_id%5=0",
    "exclude_real_copies": f"WITH {FILES}, real_keys AS (SELECT DISTINCT class_name AS c, sha256(content) AS h FROM files WHERE origin='real') SELECT f.doc_id, f.class_name, CASE WHEN r.h IS NULL THEN 0 ELSE 1 END AS real_copy FROM files f LEFT JOIN real_keys r ON f.class_name=r.c AND sha256(f.content)=r.h WHERE f.origin='synth'",
    "path_parts": f"WITH {FILES} SELECT doc_id, filename AS base, 'png' AS ext, class_name AS folder, round(CAST(('0x'||substr(sha256(filename),1,8)) AS BIGINT)/4294967295e0,9) AS unit FROM files",
    "class_vocabulary_filter": f"WITH {FILES} SELECT doc_id, class_name FROM files WHERE class_name='cancer'",
    "sha256_content": f"WITH {FILES} SELECT doc_id, sha256(content) AS sha256, md5(content) AS md5 FROM files",
    "synthetic_not_in_raw_by_content": f"WITH {FILES} SELECT doc_id, class_name, filename FROM files f WHERE origin='synth' AND NOT EXISTS (SELECT 1 FROM files r WHERE r.origin='real' AND r.class_name=f.class_name AND r.content=f.content)",
    "dedup_by_content": f"WITH {FILES}, k AS (SELECT doc_id, class_name, filename, row_number() OVER (PARTITION BY class_name, content ORDER BY filename, doc_id) AS rn FROM files f WHERE origin='synth' AND NOT EXISTS (SELECT 1 FROM files r WHERE r.origin='real' AND r.class_name=f.class_name AND r.content=f.content)) SELECT doc_id, class_name, filename FROM k WHERE rn=1",
    "hash_holdout": f"WITH {FILES}, k AS (SELECT doc_id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY CAST(('0x'||substr(sha256(filename),1,8)) AS BIGINT), doc_id) AS rn, count(*) OVER (PARTITION BY class_name) AS n FROM files) SELECT doc_id, class_name, CASE WHEN rn<=greatest(2, round_even(n*15e-2,0)) THEN 'val' ELSE 'train' END AS role FROM k",
    "stratified_split": f"WITH {FILES}, k AS (SELECT doc_id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY CAST(('0x'||substr(sha256('0:'||doc_id),1,8)) AS BIGINT), doc_id) AS rn, count(*) OVER (PARTITION BY class_name) AS n FROM files) SELECT doc_id, class_name, CASE WHEN rn<=round(n*7e-1) THEN 'train' WHEN rn<=round(n*(7e-1+15e-2)) THEN 'val' ELSE 'test' END AS role FROM k",
    "stratified_group_split": f"WITH {FILES}, g AS (SELECT *, {REGION} AS region FROM files), c AS (SELECT region, class_name, count(*) AS c FROM g GROUP BY region, class_name), l AS (SELECT region, class_name AS label, row_number() OVER (PARTITION BY region ORDER BY c DESC, class_name) AS rn FROM c), k AS (SELECT region, row_number() OVER (PARTITION BY label ORDER BY CAST(('0x'||substr(sha256('0:'||region),1,8)) AS BIGINT), region) AS nth, count(*) OVER (PARTITION BY label) AS n FROM l WHERE rn=1) SELECT doc_id, g.region, CASE WHEN nth<=round(n*7e-1) THEN 'train' WHEN nth<=round(n*(7e-1+15e-2)) THEN 'val' ELSE 'test' END AS role FROM g JOIN k ON g.region=k.region",
    "group_disjoint": f"WITH {FILES}, g AS (SELECT {REGION} AS region, CASE WHEN doc_id%4=0 THEN 'test' ELSE 'train' END AS role FROM files) SELECT region, count(DISTINCT role) AS roles, CASE WHEN count(DISTINCT role)>1 THEN 1 ELSE 0 END AS leaks FROM g GROUP BY region",
    "expand_experiments": f"WITH {FILES}, rows AS (SELECT class_name, CASE WHEN doc_id%5=0 THEN 'test' ELSE 'train' END AS role, 'both' AS part FROM files WHERE origin='real' UNION ALL SELECT class_name, 'train', 'Raw_SelectedSynthetic' FROM files WHERE origin='synth'), runs AS (SELECT m.model, x.experiment, s.seed FROM (VALUES ('A'),('B')) m(model) CROSS JOIN (VALUES ('Raw'),('Raw_SelectedSynthetic')) x(experiment) CROSS JOIN (VALUES (42),(100)) s(seed)) SELECT model, experiment, seed, role, class_name, count(*) AS n FROM runs JOIN rows ON part='both' OR part=experiment GROUP BY model, experiment, seed, role, class_name",
    "capped_sample": f"WITH {FILES}, k AS (SELECT doc_id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY CAST(('0x'||substr(sha256('0:'||doc_id),1,8)) AS BIGINT), doc_id) AS rn FROM files) SELECT doc_id, class_name FROM k WHERE rn<=50",
}
