"""Metrics against hand-computed numbers, and properties of splits."""

import pytest

from jurata.operators import evaluation as E
from jurata.schemas import LABELS

C, N, W = LABELS
ROWS = [(C, C)] * 5 + [(C, N), (N, C)] + [(N, N)] * 3 + [(W, C), (W, W), (C, None)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(str(i), g, p, False if p else None, "completed" if p else "failed", None if p else "stage2") for i, (g, p) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "record_id string, gold_label string, agent_label string, review_required boolean, status string, failure_stage string")


def test_confusion(scored):
    cells = {(r.gold, r.pred): r.n for r in E.confusion_cells(scored).collect()}
    assert [[cells[g, p] for p in LABELS] for g in LABELS] == [[5, 1, 0], [1, 3, 0], [1, 0, 1]]
    cube = {(r.gold, r.pred): r.n for r in E.confusion_cube(scored).collect()}
    assert cube[None, None] == 12 and cube[C, None] == 6 and cube[None, C] == 7 and len(cube) == 16


def test_per_class(scored):
    by = {r.label: r for r in E.per_class(scored).collect()}
    assert (by[C].tp, by[C].fp, by[C].fn, by[C].support, by[C].f1_num, by[C].f1_den) == (5, 2, 1, 6, 10, 13)
    assert (by[N].tp, by[N].fp, by[N].fn, by[N].support, by[N].f1_num, by[N].f1_den) == (3, 1, 1, 4, 6, 8)
    assert (by[W].tp, by[W].fp, by[W].fn, by[W].support) == (1, 0, 1, 2)


def test_report(scored):
    out = E.report(scored)
    assert out["macro_f1"] == (341, 468)
    assert out["agreement"] == (9, 12) and out["wrong_as_correct"] == (2, 6) and out["completion"] == (12, 13) and out["review_ratio"] == (0, 12)
    assert out["thresholds"] == {"wrong_as_correct": False, "macro_f1": False, "completion": False, "class_support": False}
    assert out["display"]["macro_f1"] == "0.7286（341/468）" and not out["passed"]
    one = E.macro_f1(scored).first()
    assert E.reduced(int(one.num), int(one.den)) == (341, 468)


def test_no_predictions_are_not_zero(spark, scored):
    none = scored.withColumn("agent_label", E.F.lit(None).cast("string"))
    assert {r.check_key: r.passed for r in E.thresholds(none).collect()} == {"wrong_as_correct": None, "macro_f1": None, "completion": False, "class_support": False}
    assert E.all_passed(E.thresholds(none)).first().passed is False
    assert E.report(none)["display"]["macro_f1"] == "不可计算（分母为 0）"
    assert {r.kind for r in E.missing_kinds(none).collect()} == {"failed", "unfinished"}


def test_illegal_labels(spark):
    gold = spark.createDataFrame([("1", C, False), ("2", "?", False)], "record_id string, gold_label string, excluded boolean")
    records = spark.createDataFrame([("1", "nearly", True, "completed", None)], "record_id string, agent_label string, review_required boolean, status string, failure_stage string")
    with pytest.raises(Exception, match="outside the contract"):
        E.scored_records(gold, records).collect()
    fine = E.comparisons(E.scored_records(gold.where("record_id = '1'"), records)).first()
    assert fine.agree is None


def test_quotas():
    assert E.quotas({C: 15, N: 10, W: 8}) == {C: 10, N: 5, W: 3}
    with pytest.raises(ValueError):
        E.quotas({C: 15, N: 10, W: 5})
    for counts in ((6, 6, 6), (100, 6, 6), (40, 30, 7), (999, 7, 8)):
        take = E.quotas(dict(zip(LABELS, counts, strict=True)))
        assert sum(take.values()) == min(20, sum(counts) - 15)
        assert all(1 <= take[k] <= n - 5 for k, n in zip(LABELS, counts, strict=True))


def _ids():
    return {C: [str(i) for i in range(1, 16)], N: [str(i) for i in range(16, 26)], W: [str(i) for i in range(26, 34)]}


def test_seeded_split():
    a = E.seeded_split(_ids())
    assert a == E.seeded_split(_ids()) and a != E.seeded_split(_ids(), seed=7)
    assert a["1"] == a["4"] == "calibration" and len(a) == 33
    assert [sum(a[i] == "calibration" for i in v) for v in _ids().values()] == [10, 5, 3]


def test_hash_split(spark):
    gold = spark.createDataFrame([(i, k, False) for k, v in _ids().items() for i in v], "record_id string, gold_label string, excluded boolean")
    rows = E.hash_split(gold, {C: 10, N: 5, W: 3}).collect()
    split = {r.record_id: r.split for r in rows}
    assert len(rows) == 33 and split["1"] == split["4"] == "calibration"
    assert [r[1:] for r in sorted(E.split_counts(E.hash_split(gold, {C: 10, N: 5, W: 3})).collect())] == [(10, 5, 3), (5, 5, 5)]


def test_id_gates(spark):
    manifest = spark.createDataFrame([("1", "holdout"), ("2", "holdout"), ("3", "calibration")], "record_id string, split string")
    records = spark.createDataFrame([("1",), ("3",), ("9",)], "record_id string")
    assert sorted(map(tuple, E.id_gates(manifest, "holdout", records).collect())) == [("2", "missing"), ("3", "other_split"), ("9", "unassigned")]
