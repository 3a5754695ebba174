"""Registered queries of the evaluation: confusion, exact metrics, thresholds, gates and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import records as R
from ..schemas import CORRECT, LABELS
from . import adapter as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _scored(spark, d):
    return E.scored_records(V.gold(spark, d), V.records(spark, d))


_S = f"WITH {V.SCORED_SQL}, l(ord, label) AS (VALUES (0, '{LABELS[0]}'), (1, '{LABELS[1]}'), (2, '{LABELS[2]}')), p AS (SELECT * FROM scored WHERE agent_label IS NOT NULL)"
_CELLS = f"{_S}, cells AS (SELECT g.label AS gold, q.label AS pred, (SELECT count(*) FROM p WHERE gold_label = g.label AND agent_label = q.label) AS n FROM l g, l q)"
_CLASSES = f"{_CELLS}, k AS (SELECT label, sum(n) FILTER (gold = label AND pred = label) AS tp, sum(n) FILTER (gold <> label AND pred = label) AS fp, sum(n) FILTER (gold = label AND pred <> label) AS fn FROM cells, l GROUP BY label), c AS (SELECT label, cast(tp AS bigint) AS tp, cast(fp AS bigint) AS fp, cast(fn AS bigint) AS fn, tp + fp > 0 AND tp + fn > 0 AS known FROM k), f AS (SELECT label, CASE WHEN known THEN 2 * tp ELSE 0 END AS n, CASE WHEN known THEN 2 * tp + fp + fn ELSE 0 END AS d FROM c)"
_MACRO = f"{_CLASSES}, w AS (SELECT max(n) FILTER (label = '{LABELS[0]}')::HUGEINT AS n0, max(d) FILTER (label = '{LABELS[0]}')::HUGEINT AS d0, max(n) FILTER (label = '{LABELS[1]}')::HUGEINT AS n1, max(d) FILTER (label = '{LABELS[1]}')::HUGEINT AS d1, max(n) FILTER (label = '{LABELS[2]}')::HUGEINT AS n2, max(d) FILTER (label = '{LABELS[2]}')::HUGEINT AS d2 FROM f), m AS (SELECT CASE WHEN d0 * d1 * d2 > 0 THEN n0 * d1 * d2 + n1 * d0 * d2 + n2 * d0 * d1 ELSE 0 END AS num, 3 * d0 * d1 * d2 AS den FROM w)"
_RATIOS = f"r AS (SELECT 'agreement' AS metric, count(*) FILTER (agent_label = gold_label) AS num, count(agent_label) AS den FROM scored UNION ALL SELECT 'wrong_as_correct', count(*) FILTER (agent_label = '{CORRECT}' AND gold_label <> '{CORRECT}'), count(agent_label) FILTER (gold_label <> '{CORRECT}') FROM scored UNION ALL SELECT 'completion', count(agent_label), count(*) FROM scored UNION ALL SELECT 'review_ratio', count(*) FILTER (agent_label IS NOT NULL AND review_required), count(agent_label) FROM scored)"


@query(f"{_CELLS} SELECT * FROM cells")
def confusion_matrix(spark, d):
    return E.confusion_cells(_scored(spark, d))


@query(f"{_CELLS} SELECT gold, pred, cast(sum(n) AS bigint) AS n FROM cells GROUP BY CUBE (gold, pred)")
def confusion_cube(spark, d):
    return E.confusion_cube(_scored(spark, d))


@query(f"{_CELLS} SELECT (SELECT sum(n) FROM cells) = (SELECT count(*) FROM p) AS consistent")
def confusion_consistency(spark, d):
    s = _scored(spark, d)
    total = E.confusion_cells(s).agg(F.sum("n").alias("n"))
    return total.join(F.broadcast(s.where(E.legal(F.col("agent_label"))).agg(F.count("*").alias("m")))).select((F.col("n") == F.col("m")).alias("consistent"))


@query(f"{_CLASSES} SELECT c.label, tp, fp, fn, tp + fn AS support, tp AS precision_num, tp + fp AS precision_den, tp AS recall_num, tp + fn AS recall_den, f.n AS f1_num, f.d AS f1_den FROM c JOIN f USING (label)")
def per_class_prf(spark, d):
    return E.per_class(_scored(spark, d))


@query(f"{_MACRO} SELECT cast(num AS decimal(38, 0)) AS num, cast(den AS decimal(38, 0)) AS den, CASE WHEN den > 0 THEN num::DOUBLE / den::DOUBLE END AS value FROM m")
def macro_f1_exact(spark, d):
    return E.macro_f1(_scored(spark, d))


@query(f"WITH {V.SCORED_SQL}, {_RATIOS} SELECT *, CASE WHEN den > 0 THEN num::DOUBLE / den END AS value FROM r")
def overall_ratios(spark, d):
    return E.ratios(_scored(spark, d))


_CHECKS = f"{_MACRO}, {_RATIOS}, t AS (SELECT 'wrong_as_correct' AS check_key, num::DOUBLE / nullif(den, 0) <= 0.05 AS passed FROM r WHERE metric = 'wrong_as_correct' UNION ALL SELECT 'completion', num::DOUBLE / nullif(den, 0) >= 1 FROM r WHERE metric = 'completion' UNION ALL SELECT 'macro_f1', num::DOUBLE / nullif(den, 0)::DOUBLE >= 0.8 FROM m UNION ALL SELECT 'class_support', min(tp + fn) >= 5 FROM c)"


@query(f"{_CHECKS} SELECT * FROM t")
def thresholds(spark, d):
    return E.thresholds(_scored(spark, d))


@query(f"{_CHECKS} SELECT bool_and(coalesce(passed, false)) AS passed FROM t")
def all_thresholds_passed(spark, d):
    return E.all_passed(E.thresholds(_scored(spark, d)))


@query(f"WITH {V.SCORED_SQL} SELECT record_id, CASE WHEN failure_stage IS NOT NULL OR coalesce(status = 'failed', false) THEN 'failed' ELSE 'unfinished' END AS kind FROM scored WHERE agent_label IS NULL")
def missing_failed_unfinished(spark, d):
    return E.missing_kinds(_scored(spark, d))


@query(f"WITH {V.SCORED_SQL}, e AS (SELECT record_id, gold_label, agent_label, gold_label = agent_label AS agree FROM scored) SELECT * FROM e WHERE agree = false ORDER BY coalesce(try_cast(regexp_extract(record_id, '^([0-9]+)', 1) AS bigint), 0), record_id LIMIT 100")
def eval_records_agree_false(spark, d):
    rows = R.filtered(E.comparisons(_scored(spark, d)), agree=False)
    return R.page(rows, R.in_numeric_order(rows), 100).select("record_id", "gold_label", "agent_label", "agree")


@query(f"WITH {V.SCORED_SQL} SELECT agree, count(*) AS n FROM (SELECT gold_label = agent_label AS agree FROM scored) GROUP BY agree")
def agree_three_states(spark, d):
    return E.comparisons(_scored(spark, d)).groupBy("agree").agg(F.count("*").alias("n"))


@query(f"{_S} SELECT label, (SELECT count(*) FROM gold WHERE gold_label = label AND NOT excluded) AS n FROM l")
def label_counts(spark, d):
    return E.label_counts(V.gold(spark, d))


# The quota in SQL: largest remainders of 20 rows; with these counts no class hits its bounds but by `least` and `greatest`.
_QUOTA = f"{_S}, n AS (SELECT gold_label AS label, count(*) AS n FROM gold WHERE NOT excluded GROUP BY gold_label), x AS (SELECT n.label, ord, n, 20.0::DOUBLE * n / sum(n) OVER () AS share FROM n JOIN l USING (label)), y AS (SELECT *, cast(floor(share) AS bigint) AS low, row_number() OVER (ORDER BY share - floor(share) DESC, ord) AS r, 20 - sum(floor(share)) OVER () AS deficit FROM x), q AS (SELECT label, least(greatest(low + CASE WHEN r <= deficit THEN 1 ELSE 0 END, 1), n - 5) AS quota FROM y)"


def _take(spark, d):
    return E.quotas({r["label"]: r["n"] for r in E.label_counts(V.gold(spark, d)).collect()})


@query(f"{_QUOTA} SELECT label, cast(quota AS bigint) AS quota FROM q")
def split_quota_largest_remainder(spark, d):
    return spark.createDataFrame(list(_take(spark, d).items()), "label string, quota long")


_SPLIT = f"{_QUOTA}, s AS (SELECT record_id, gold_label, row_number() OVER (PARTITION BY gold_label ORDER BY record_id NOT IN ('1', '4'), md5('20261005:' || record_id), record_id) AS r FROM gold WHERE NOT excluded), a AS (SELECT record_id, gold_label, CASE WHEN r <= quota THEN 'calibration' ELSE 'holdout' END AS split FROM s JOIN q ON q.label = gold_label)"


@query(f"{_SPLIT} SELECT * FROM a")
def split_assignment_hash(spark, d):
    return E.hash_split(V.gold(spark, d), _take(spark, d))


@query(f"{_SPLIT} SELECT split, {', '.join(f"count(*) FILTER (gold_label = '{x}') AS n_{i}" for i, x in enumerate(LABELS))} FROM a GROUP BY split")
def split_label_counts(spark, d):
    return E.split_counts(E.hash_split(V.gold(spark, d), _take(spark, d)))


@query(f"{_SPLIT}, v AS (SELECT DISTINCT record_id FROM records WHERE status = 'completed' OR status = 'failed'), u AS (SELECT coalesce(a.record_id, v.record_id) AS record_id, CASE WHEN a.split = 'holdout' AND v.record_id IS NULL THEN 'missing' WHEN v.record_id IS NOT NULL AND a.split IS NULL THEN 'unassigned' WHEN v.record_id IS NOT NULL AND a.split <> 'holdout' THEN 'other_split' END AS problem FROM a FULL JOIN v USING (record_id)) SELECT * FROM u WHERE problem IS NOT NULL")
def split_id_gates(spark, d):
    assigned = E.hash_split(V.gold(spark, d), _take(spark, d))
    return E.id_gates(assigned, "holdout", V.records(spark, d).where(F.col("status").isin("completed", "failed")))
