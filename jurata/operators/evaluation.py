"""Evaluation: scored records, confusion matrix, exact metrics, thresholds, and stratified splits.

Metrics are pairs of integers (numerator, denominator). A zero denominator isn't computable: it stays null through
thresholds and never counts as passed. The data pass is one aggregate to at most nine cells; all else is arithmetic on
those.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import CORRECT, LABELS, MAX_WRONG_AS_CORRECT, MIN_CLASS_SUPPORT, MIN_MACRO_F1, SPLITS

# The split's contract.
CALIBRATION_TARGET, MIN_CALIBRATION, MIN_HOLDOUT, SPLIT_SEED, FORCED_IDS = 20, 1, 5, 20261005, ("1", "4")


def legal(label: Column) -> Column:
    return F.coalesce(label.isin(*LABELS), F.lit(False))


def labels_table(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LABELS)), "ord int, label string")


def scored_records(gold: DataFrame, records: DataFrame) -> DataFrame:
    """Included gold rows with their prediction; a gold label outside the contract is an error, a prediction outside it is none."""
    checked = F.when(F.col("gold_label").isin(*LABELS), F.col("gold_label")).otherwise(F.raise_error(F.concat(F.lit("gold label outside the contract: "), F.coalesce("gold_label", F.lit("null")))))
    joined = gold.where("not excluded").join(records.select("record_id", "agent_label", "review_required", "status", "failure_stage"), "record_id", "left")
    return joined.withColumn("gold_label", checked)


def comparisons(scored: DataFrame) -> DataFrame:
    """Per record: agree is null without a legal prediction."""
    return scored.withColumn("agree", F.when(legal(F.col("agent_label")), F.col("gold_label") == F.col("agent_label")))


def confusion_cells(scored: DataFrame) -> DataFrame:
    """(gold, pred, n) of all nine cells, zeros included."""
    spark = scored.sparkSession
    n = scored.where(legal(F.col("agent_label"))).groupBy(F.col("gold_label").alias("gold"), F.col("agent_label").alias("pred")).agg(F.count("*").alias("n"))
    one = labels_table(spark)
    spine = one.select(F.col("label").alias("gold"), F.explode(F.array(*map(F.lit, LABELS))).alias("pred"))
    return spine.join(n, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_cube(scored: DataFrame) -> DataFrame:
    """Cells with row totals, column totals and the grand total (null stands for all)."""
    return confusion_cells(scored).cube("gold", "pred").agg(F.sum("n").alias("n"))


def per_class(scored: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support, *_num, *_den): counts and exact precision, recall and F1 of each class."""
    cells = confusion_cells(scored)
    each = cells.select("gold", "pred", "n", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    is_gold, is_pred = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = each.groupBy("label").agg(total(is_gold & is_pred).alias("tp"), total(~is_gold & is_pred).alias("fp"), total(is_gold & ~is_pred).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    known = (tp + fp > 0) & (tp + fn > 0)
    return out.select("label", "tp", "fp", "fn", (tp + fn).alias("support"), tp.alias("precision_num"), (tp + fp).alias("precision_den"), tp.alias("recall_num"), (tp + fn).alias("recall_den"), F.when(known, 2 * tp).otherwise(0).alias("f1_num"), F.when(known, 2 * tp + fp + fn).otherwise(0).alias("f1_den"))


def macro_f1(scored: DataFrame) -> DataFrame:
    """(num, den, value): the mean of the three F1 as one fraction, not reduced; 0/0 if any class has none."""
    wide = per_class(scored).agg(*[F.max(F.when(F.col("label") == x, F.col(c)).cast("decimal(12,0)")).alias(f"{c}_{i}") for i, x in enumerate(LABELS) for c in ("f1_num", "f1_den")])
    n, d = ([F.col(f"f1_{k}_{i}") for i in range(3)] for k in ("num", "den"))
    num = n[0] * d[1] * d[2] + n[1] * d[0] * d[2] + n[2] * d[0] * d[1]
    den = d[0] * d[1] * d[2] * 3
    ok = (d[0] > 0) & (d[1] > 0) & (d[2] > 0)
    out = wide.select(F.when(ok, num).otherwise(0).cast("decimal(38,0)").alias("num"), F.when(ok, den).otherwise(0).cast("decimal(38,0)").alias("den"))
    return out.select("num", "den", F.try_divide(F.col("num").cast("double"), F.col("den").cast("double")).alias("value"))


def ratios(scored: DataFrame) -> DataFrame:
    """(metric, num, den, value) of agreement, wrong_as_correct, completion and review_ratio."""
    has, hit = legal(F.col("agent_label")), F.col("agent_label") == F.col("gold_label")
    wrong = F.col("gold_label") != CORRECT
    pairs = {
        "agreement": (has & hit, has),
        "wrong_as_correct": (has & wrong & (F.col("agent_label") == CORRECT), has & wrong),
        "completion": (has, F.lit(True)),
        "review_ratio": (has & F.coalesce("review_required", F.lit(False)), has),
    }
    one = scored.agg(*[F.struct(F.lit(k).alias("metric"), F.count_if(F.coalesce(a, F.lit(False))).alias("num"), F.count_if(b).alias("den")).alias(k) for k, (a, b) in pairs.items()])
    out = one.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")
    return out.withColumn("value", F.try_divide(F.col("num").cast("double"), F.col("den").cast("double")))


def thresholds(scored: DataFrame) -> DataFrame:
    """(check_key, passed): passed is null where the metric isn't computable."""
    value = ratios(scored).groupBy().agg(*[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(k) for k in ("wrong_as_correct", "completion")])
    thin = per_class(scored).agg((F.min("support") >= MIN_CLASS_SUPPORT).alias("class_support"))
    row = value.join(F.broadcast(macro_f1(scored).select(F.col("value").alias("macro_f1")))).join(F.broadcast(thin))  # one row each
    checks = {"wrong_as_correct": F.col("wrong_as_correct") <= MAX_WRONG_AS_CORRECT, "macro_f1": F.col("macro_f1") >= MIN_MACRO_F1, "completion": F.col("completion") >= 1.0, "class_support": F.col("class_support")}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_key"), c.alias("passed")) for k, c in checks.items()])).alias("c")).select("c.*")


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"))


def missing_kinds(scored: DataFrame) -> DataFrame:
    """(record_id, kind) of records without a legal prediction: failed or unfinished."""
    failed = F.col("failure_stage").isNotNull() | F.coalesce(F.col("status") == "failed", F.lit(False))
    return scored.where(~legal(F.col("agent_label"))).select("record_id", F.when(failed, "failed").otherwise("unfinished").alias("kind"))


def id_gates(manifest: DataFrame, split: str, records: DataFrame) -> DataFrame:
    """(record_id, problem): valid records against the ids of a split: missing, other_split or unassigned."""
    mine = manifest.select("record_id", "split")
    both = mine.join(records.select("record_id").distinct().withColumn("_there", F.lit(True)), "record_id", "full")
    there = F.coalesce("_there", F.lit(False))
    problem = F.when((F.col("split") == split) & ~there, "missing").when(there & F.col("split").isNull(), "unassigned").when(there & (F.col("split") != split), "other_split")
    return both.select("record_id", problem.alias("problem")).where("problem is not null")


def reduced(num: int, den: int) -> tuple[int, int]:
    g = math.gcd(num, den)
    return (num // g, den // g) if g > 1 else (num, den)


def display(num: int, den: int, digits: int = 4) -> str:
    return f"{num / den:.{digits}f}（{num}/{den}）" if den > 0 else "不可计算（分母为 0）"


def display_of(num: Column, den: Column) -> Column:
    """display() as an expression for counts: four digits of the double num / den, its exact value rounded half to even.

    Unless num / den lies in the middle between two texts, its double rounds as the fraction does. In the middle it counts on
    which side the double is: its 54 bits as an integer are compared with the middle at the same scale.
    """
    d = F.nullif(den.cast("long"), F.lit(0).cast("long"))
    n = num.cast("long")
    twice = F.floor((n * 20000 - (n * 20000) % d) / d)  # of a ten-thousandth; whole numbers below 2**53, so exact
    middle = ((n * 20000) % d == 0) & (twice % 2 == 1)
    x = n.cast("double") / d.cast("double")
    scale = (F.lit(53) - F.floor(F.log2(x))).cast("int")
    whole = (x * F.pow(F.lit(2.0), scale)).cast("long").cast("decimal(19,0)")
    half = (scale / 2).cast("int")
    power = F.call_function("shiftleft", F.lit(1).cast("long"), half).cast("decimal(19,0)") * F.call_function("shiftleft", F.lit(1).cast("long"), scale - half).cast("decimal(19,0)")
    side = F.signum((whole * F.lit(20000).cast("decimal(5,0)")).cast("decimal(38,0)") - (power * twice.cast("decimal(19,0)")).cast("decimal(38,0)"))
    low = ((twice - 1) / 2).cast("long")
    near = F.when(~middle, ((n * 20000 + d - (n * 20000 + d) % (d * 2)) / (d * 2)).cast("long")).when((side > 0) | ((side == 0) & (low % 2 == 1)), low + 1).otherwise(low)
    text = F.concat(((near - near % 10000) / 10000).cast("long").cast("string"), F.lit("."), F.lpad((near % 10000).cast("string"), 4, "0"))
    return F.when(den > 0, F.concat(text, F.lit("（"), num.cast("string"), F.lit("/"), den.cast("string"), F.lit("）"))).otherwise("不可计算（分母为 0）")


def report(scored: DataFrame) -> dict:
    """All metrics of an evaluation as plain values (a few dozen numbers)."""
    cells = confusion_cells(scored).collect()
    out: dict = {"confusion": {g: {p: next(c["n"] for c in cells if (c["gold"], c["pred"]) == (g, p)) for p in LABELS} for g in LABELS}}
    out["per_class"] = {r["label"]: r.asDict() for r in per_class(scored).collect()}
    f1 = [(out["per_class"][x]["f1_num"], out["per_class"][x]["f1_den"]) for x in LABELS]
    mean = sum((Fraction(*v) for v in f1), Fraction(0)) / len(f1) if all(d for _, d in f1) else None
    out["macro_f1"] = (mean.numerator, mean.denominator) if mean is not None else (0, 0)
    out |= {r["metric"]: (r["num"], r["den"]) for r in ratios(scored).collect()}
    out["display"] = {k: display(*out[k]) for k in ("macro_f1", "agreement", "wrong_as_correct", "completion", "review_ratio")}
    out["thresholds"] = {r["check_key"]: r["passed"] for r in thresholds(scored).collect()}
    out["passed"] = all(v is True for v in out["thresholds"].values())
    return out


# Splits


def label_counts(gold: DataFrame) -> DataFrame:
    """(label, n) of included rows, zeros included."""
    n = gold.where("not excluded").groupBy(F.col("gold_label").alias("label")).agg(F.count("*").alias("n"))
    return labels_table(gold.sparkSession).join(F.broadcast(n), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def quotas(counts: Mapping[str, int], total: int | None = None) -> dict[str, int]:
    """Calibration rows of each label: largest remainders of the target, kept between one and what leaves a holdout of five.

    Three numbers; ties go by the order of labels. Raises ValueError where no split is possible.
    """
    short = {k: n for k, n in counts.items() if n < MIN_CALIBRATION + MIN_HOLDOUT}
    if short or not counts:
        raise ValueError(f"too few rows of {short or 'any label'} for a split")
    everything = sum(counts.values())
    total = min(CALIBRATION_TARGET, everything - MIN_HOLDOUT * len(counts)) if total is None else total
    names = [x for x in LABELS if x in counts]
    share = {k: total * counts[k] / everything for k in names}
    out = {k: int(share[k]) for k in names}
    for k in sorted(names, key=lambda k: out[k] - share[k])[: total - sum(out.values())]:
        out[k] += 1
    room = {k: counts[k] - MIN_HOLDOUT for k in names}
    out = {k: min(max(v, MIN_CALIBRATION), room[k]) for k, v in out.items()}
    while (gap := total - sum(out.values())) != 0:
        if gap > 0:
            k = max(names, key=lambda k: room[k] - out[k])
            if room[k] <= out[k]:
                raise ValueError("no label has room for more calibration rows")
        else:
            k = min((k for k in names if out[k] > MIN_CALIBRATION), key=lambda k: out[k], default=None)
            if k is None:
                raise ValueError("every label is at its least")
        out[k] += 1 if gap > 0 else -1
    return out


def hash_split(gold: DataFrame, take: Mapping[str, int], seed: int = SPLIT_SEED, forced: Sequence[str] = FORCED_IDS) -> DataFrame:
    """(record_id, gold_label, split): per label the forced ids and then the smallest digests, as many as `take` says.

    Reproducible for a seed at any size: the draw is a rank by digest, so the rank limit is pushed below the exchange and
    each label sends only its quota through one task.
    """
    rows = gold.where("not excluded").select("record_id", "gold_label")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("record_id")).cast("binary"))
    keyed = rows.withColumn("_rest", ~F.col("record_id").isin(*forced) if forced else F.lit(True)).withColumn("_draw", draw)
    most = max(take.values())
    best = keyed.withColumn("_n", F.row_number().over(W.partitionBy("gold_label").orderBy("_rest", "_draw", "record_id"))).where(F.col("_n") <= most)
    quota = reduce(lambda c, kv: c.when(F.col("gold_label") == kv[0], kv[1]), take.items(), F.when(F.lit(False), 0))
    chosen = best.where(F.col("_n") <= quota).select("record_id").withColumn("_in", F.lit(True))
    return rows.join(F.broadcast(chosen), "record_id", "left").select("record_id", "gold_label", F.when(F.col("_in"), SPLITS[0]).otherwise(SPLITS[1]).alias("split"))  # chosen: at most the target


def seeded_split(ids: Mapping[str, Sequence[str]], seed: int = SPLIT_SEED, forced: Sequence[str] = FORCED_IDS) -> dict[str, str]:
    """The split that the seeded generator of the standard library draws, for a gold set of contract size (at most 1000 ids).

    One generator serves the labels in their order; ids are sorted as text and forced ones taken out before the shuffle.
    """
    take = quotas({k: len(v) for k, v in ids.items()})
    for label, own in ids.items():
        if len(set(own) & set(forced)) > take[label]:
            raise ValueError(f"more forced ids than the quota {take[label]} of {label}")
    rng, out = random.Random(seed), {}
    for label in LABELS:
        fixed = [i for i in forced if i in set(ids.get(label, ()))]
        drawn = sorted(i for i in ids.get(label, ()) if i not in forced)
        rng.shuffle(drawn)
        chosen = {*fixed, *drawn[: take.get(label, 0) - len(fixed)]}
        out |= {i: SPLITS[0] if i in chosen else SPLITS[1] for i in ids.get(label, ())}
    return out


def split_counts(assigned: DataFrame) -> DataFrame:
    """(split, n_0, n_1, n_2): rows of each label in either split, zeros included."""
    return assigned.groupBy("split").agg(*[F.count_if(F.col("gold_label") == x).alias(f"n_{i}") for i, x in enumerate(LABELS)])
