"""An evaluation and a split end to end: gates first, then metrics, then files; a closed gate writes nothing.

The files are reports of a fixed size and manifests of a gold set (bounded by contract), written by the driver through
Spark's file systems; rows of an evaluation stay a DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import below
from ..functions.prompts import prompt_snapshot
from ..operators import evaluation as E
from ..schemas import INPUT_COLUMNS, LABELS, SPLITS
from ..sources import files
from ..sources.xlsx import workbook_bytes

# States in which a run can be evaluated.
TERMINAL = ("completed", "partial_failed")


class Gate(ValueError):
    """A condition of an evaluation or split that isn't met."""


def gates(gold: DataFrame, manifest: DataFrame, records: DataFrame, split: str, run_status: str, digests: tuple[str, str] | None = None) -> None:
    """Raises Gate: unknown split, run not ended, another gold file than the manifest's, records without id, other ids than the split's."""
    if split not in SPLITS:
        raise Gate(f"unknown split {split!r}")
    if run_status not in TERMINAL:
        raise Gate(f"run is {run_status}")
    if digests and digests[0] != digests[1]:
        raise Gate("the gold file isn't the one that was split")
    valid = records.where("status <> 'input_invalid'")
    if not valid.where("record_id is null").isEmpty():
        raise Gate("valid records without an id")
    if bad := E.id_gates(manifest, split, valid).orderBy("problem", "record_id").limit(10).collect():
        raise Gate("ids differ: " + ", ".join(f"{r.record_id} {r.problem}" for r in bad))
    lost = manifest.where(F.col("split") == split).join(gold.where("not excluded"), "record_id", "left_anti")
    if not lost.isEmpty():
        raise Gate("ids of the split without a gold row")


def run_evaluation(gold: DataFrame, manifest: DataFrame, records: DataFrame, split: str, run_status: str, folder: str, digests: tuple[str, str] | None = None, facts: Mapping[str, str] | None = None) -> tuple[dict, DataFrame]:
    """(report, rows): checks the gates, scores the split's records, writes report.json and report.md below folder."""
    gates(gold, manifest, records, split, run_status, digests)
    chosen = gold.join(manifest.where(F.col("split") == split).select("record_id"), "record_id", "left_semi")
    scored = E.scored_records(chosen, records.where("status <> 'input_invalid'")).cache()
    try:
        report = E.report(scored) | {"split": split, "freeze": dict(facts or {})}
        missing = E.missing_kinds(scored).orderBy("record_id").collect()
        report |= {k: [r.record_id for r in missing if r.kind == k] for k in ("failed", "unfinished")}
    finally:
        scored.unpersist()
    for name, text in (("report.json", json.dumps(report, ensure_ascii=False, indent=2, default=str)), ("report.md", markdown(report))):
        files.put(gold.sparkSession, f"{folder}/{name}", f"{text}\n".encode())
    return report, E.comparisons(scored)


def markdown(report: Mapping) -> str:
    """A report for people: confusion with totals, per-class and overall metrics, thresholds."""
    rows = ["# 评估报告", "", "| 人工＼预测 | " + " | ".join(LABELS) + " | 合计 |", "| --- " * (len(LABELS) + 2) + "|"]
    for g in LABELS:
        cells = [report["confusion"][g][p] for p in LABELS]
        rows.append(f"| {g} | " + " | ".join(map(str, cells)) + f" | {sum(cells)} |")
    rows += ["", "| 类别 | P | R | F1 | 样本 |", "| --- | --- | --- | --- | --- |"]
    for x in LABELS:
        c = report["per_class"][x]
        rows.append(f"| {x} | " + " | ".join(E.display(c[f"{m}_num"], c[f"{m}_den"]) for m in ("precision", "recall", "f1")) + f" | {c['support']} |")
    rows += ["", *[f"- {k}: {v}" for k, v in report["display"].items()], ""]
    rows += [f"- {k}: {'不可判定' if v is None else '达标' if v else '未达标'}" for k, v in report["thresholds"].items()]
    return "\n".join(rows)


def generate_split(gold: DataFrame, folder: str, facts: Mapping[str, str], generated_at: str, seed: int = E.SPLIT_SEED, forced: Sequence[str] = E.FORCED_IDS) -> dict:
    """Splits a gold set (rows of gold_rows() with pos, record_id, gold_label, excluded and the 13 input columns), writes the manifest and both subset workbooks, never over existing ones."""
    spark = gold.sparkSession
    if any(files.exists(spark, f"{folder}/{n}") for n in ("split.json", *(f"{s}.xlsx" for s in SPLITS))):
        raise Gate("a frozen split is there already")
    rows = gold.orderBy("pos").collect()
    ids: dict[str, list[str]] = {}
    for r in rows:
        if not r["excluded"]:
            ids.setdefault(r["gold_label"], []).append(r["record_id"])
    assigned = E.seeded_split({k: ids.get(k, []) for k in LABELS}, seed, forced)
    order = [r["record_id"] for r in rows if not r["excluded"]]
    by_label = {s: {k: sum(assigned[i] == s for i in ids.get(k, ())) for k in LABELS} for s in SPLITS}
    manifest = {
        "manifest_version": "1", "seed": seed, "calibration_target": sum(by_label[SPLITS[0]].values()), "gold": dict(facts),
        "counts": {"gold_total": len(rows), "included": len(order), "excluded": len(rows) - len(order), **{s: sum(by_label[s].values()) for s in SPLITS}, **{f"{s}_by_label": by_label[s] for s in SPLITS}},
        "forced_calibration": [i for i in forced if i in assigned], "assignments": {i: assigned[i] for i in order}, "generated_at": generated_at,
    }
    for s in SPLITS:  # the input columns only: labels never leave with a subset
        own = (tuple(r[c] for c in INPUT_COLUMNS) for r in rows if assigned.get(r["record_id"]) == s)
        files.put(spark, f"{folder}/{s}.xlsx", workbook_bytes({"QA_REF": (list(INPUT_COLUMNS), own)}))
    files.put(spark, f"{folder}/split.json", (json.dumps(manifest, ensure_ascii=False, indent=2) + "\n").encode())
    return manifest


def evaluation_folder(root: str, run_id: str, evaluation_id: str) -> str:
    """Where an evaluation's reports go; ids that would leave the root are errors."""
    return f"{root.rstrip('/')}/{below('evaluations', f'{run_id}/{evaluation_id}')}"


def frozen(run: Mapping, facts: Mapping[str, str]) -> dict[str, str]:
    """The versions that an evaluation rests on: the run's own, the prompts' and what is given (gold and manifest digests); nothing that looks like a secret."""
    versions = {f"prompt_{s}": p["sha256"] for s, p in (run.get("prompts") or prompt_snapshot()).items()}
    own = {k: str(run[k]) for k in ("run_id", "input_digest", "revision", "mode") if run.get(k) is not None}
    secret = ("key", "token", "secret", "password")
    return {k: v for k, v in (own | versions | dict(facts)).items() if not any(s in k.lower() for s in secret)}


# What a manifest must hold, and its version.
MANIFEST_KEYS, MANIFEST_VERSION = ("manifest_version", "seed", "calibration_target", "gold", "counts", "forced_calibration", "assignments", "generated_at"), "1"


def read_manifest(spark, path: str) -> DataFrame:
    """(record_id, split, pos) of a manifest file; anything missing or unknown is an error, and so are counts that don't add up."""
    try:
        payload = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
        pairs = [(str(k), str(v), i) for i, (k, v) in enumerate(payload["assignments"].items())]
        int(payload["seed"]), payload["gold"]["sha256"]
        if lost := [k for k in MANIFEST_KEYS if k not in payload]:
            raise KeyError(", ".join(lost))
        if str(payload["manifest_version"]) != MANIFEST_VERSION:
            raise ValueError(f"version {payload['manifest_version']!r}")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise Gate(f"not a split manifest: {e!r}") from e
    if unknown := {v for _, v, _ in pairs} - set(SPLITS):
        raise Gate(f"unknown splits {sorted(unknown)}")
    if any(payload["counts"].get(s) != sum(v == s for _, v, _ in pairs) for s in SPLITS):
        raise Gate("the counts aren't those of the assignments")
    return spark.createDataFrame(pairs, "record_id string, split string, pos int")


