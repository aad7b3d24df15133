"""Predictions against ground truth: one-to-one matching, confusion counts, ordered verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ranking import place_in_group, running, slices
from siltstone.operators.summaries import rates, safe_ratio
from siltstone.session import materialize


def greedy_assign(pairs: DataFrame, keys: Sequence[str], left: str, right: str, score: str) -> DataFrame:
    """Rows (keys, left, right, score): scored pairs taken from the best down if both ends are free.

    Equal scores go to the greater ``left``, then the greater ``right``. Negative and null scores never match; a pair given
    twice counts once, with its better score. The order being total, the pairs the greedy walk takes are those that are
    the best of both their ends, then the same among what is left when these ends are gone: each round finds them by two
    aggregations, so no group has to meet in one task. There are as many rounds as the longest chain of pairs of which
    each displaces the next.
    """
    base = pairs.select(*keys, left, right, F.col(score).cast("double").alias(score)).filter((F.col(score) >= 0) & ~F.isnan(score)).dropna(subset=[left, right])
    rest = materialize(base.groupBy(*keys, left, right).agg(F.max(score).alias(score)), "pairs")
    done: DataFrame | None = None
    order = F.struct(F.col(score), F.col(left), F.col(right))

    def best(df: DataFrame, end: str, name: str) -> DataFrame:
        return df.groupBy(*[F.col(k).alias(f"_{name}k{i}") for i, k in enumerate(keys)], F.col(end).alias(f"_{name}")).agg(F.max(order).alias(f"_{name}best"))

    def same(end: str, name: str) -> Column:
        on = F.col(end) == F.col(f"_{name}")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_{name}k{i}"))
        return on

    while done is None or not rest.isEmpty():
        both = rest.join(best(rest, left, "l"), same(left, "l")).join(best(rest, right, "r"), same(right, "r"))
        taken = materialize(both.filter((order == F.col("_lbest")) & (order == F.col("_rbest"))).select(*base.columns), "taken")
        done = taken if done is None else done.unionByName(taken)
        ends = lambda end, name: taken.select(*[F.col(k).alias(f"_{name}k{i}") for i, k in enumerate(keys)], F.col(end).alias(f"_{name}"))  # noqa: E731, B023
        rest = materialize(rest.join(ends(left, "l"), same(left, "l"), "left_anti").join(ends(right, "r"), same(right, "r"), "left_anti"), "pairs")
    return done


def mutual_best(pairs: DataFrame, keys: Sequence[str], left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each other's best, ties to the smaller partner: one round of the assignment, without Python."""
    wl = Window.partitionBy(*keys, left).orderBy(F.desc(score), right)
    wr = Window.partitionBy(*keys, right).orderBy(F.desc(score), left)
    return pairs.filter(F.col(score) >= 0).withColumn("_l", F.row_number().over(wl)).withColumn("_r", F.row_number().over(wr)).filter("_l = 1 AND _r = 1").drop("_l", "_r")


def _paired(gt: DataFrame, pred: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """The i-th row of ground truth with the i-th prediction of equal ``keys``, in the order of their rows: what a walk that
    gives each the first free one comes to where all of a key will do."""
    g = place_in_group(gt, keys, ["gt_row"], "_i").select(*keys, "_i", "gt_row")
    p = place_in_group(pred, keys, ["pred_row"], "_i").select(*keys, "_i", "pred_row")
    return g.join(p, [*keys, "_i"]).select("_k", "gt_row", "pred_row", F.lit(how).alias("how"))


def _walked(gt: DataFrame, pred: DataFrame, keys: Sequence[str], ok: Callable[[tuple, tuple], bool], how: str) -> DataFrame:
    """Each ground truth in order takes the first free prediction that ``ok`` accepts, group by group of ``keys``."""

    def match(gs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        free = dict(enumerate(ps.sort_values("pred_row")[["pred_row", "_a", "_f"]].itertuples(index=False, name=None)))
        out = []
        for a in gs.sort_values("gt_row")[["_k", "gt_row", "_a", "_f"]].itertuples(index=False, name=None):
            hit = next((i for i, b in free.items() if ok(a[1:], b)), None)
            if hit is not None:
                out.append((a[0], a[1], free.pop(hit)[0], how))
        return pd.DataFrame(out, columns=["_k", "gt_row", "pred_row", "how"])

    return gt.groupBy(*keys).cogroup(pred.groupBy(*keys)).applyInPandas(match, "_k string, gt_row bigint, pred_row bigint, how string")


def _stretches(gt: DataFrame, pred: DataFrame, tolerance: int) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows with an address, and ``_part``: stretches of addresses further than ``tolerance`` from all others."""
    side = lambda df, row, no: df.filter("_a IS NOT NULL").select("_k", "_a", "_f", F.col(row).alias("_row"), F.lit(no).alias("_side"))
    both = slices(side(gt, "gt_row", 0).unionByName(side(pred, "pred_row", 1)), ["_k"], ["_a"])
    both = running(both, ["_k"], ["_a"], F.col("_a"), "_reach", "max", own=False)
    new = F.when(F.col("_reach").isNull() | (F.col("_a") > F.col("_reach") + tolerance), 1).otherwise(0)
    both = running(both.withColumn("_new", new), ["_k"], ["_a", F.desc("_new")], F.col("_new"), "_part")
    part = lambda no, row: both.filter(F.col("_side") == no).select("_k", "_part", F.col("_row").alias(row), "_a", "_f")
    return materialize(part(0, "gt_row"), "near"), materialize(part(1, "pred_row"), "near")


def staged_match(gt: DataFrame, pred: DataFrame, keys: Sequence[str], tolerance: int = 16) -> DataFrame:
    """Rows (keys, gt_row, pred_row, how): one-to-one matches of records (gt_row or pred_row, address, function_name).

    Four passes, each over ground truth in order taking the first free prediction: equal address, address within
    ``tolerance``, function names of which one holds the other, any for ground truth without both. Rows are numbered
    uniquely within ``keys``; a null key is a key. Where all predictions of a key will do, in the first and the last
    pass, ranks are joined; near addresses are matched within stretches too far from others to interact; only names are
    compared key by key, and only of rows that no pass before has matched.
    """

    def side(df: DataFrame, row: str) -> DataFrame:
        return materialize(df.select(F.to_json(F.struct(*keys)).alias("_k"), *keys, F.col(row).cast("bigint").alias(row), F.col("address").alias("_a"), F.nullif("function_name", F.lit("")).alias("_f")), row)

    g, p = side(gt, "gt_row"), side(pred, "pred_row")
    found: DataFrame | None = None

    def free(df: DataFrame, row: str) -> DataFrame:
        return df if found is None else df.join(found.select("_k", row), ["_k", row], "left_anti")

    def keep(rows: DataFrame) -> DataFrame:
        rows = materialize(rows, "matched")
        return rows if found is None else found.unionByName(rows)

    found = keep(_paired(g.filter("_a IS NOT NULL"), p.filter("_a IS NOT NULL"), ["_k", "_a"], "address"))
    near = _stretches(free(g, "gt_row"), free(p, "pred_row"), tolerance)
    found = keep(_walked(*near, ["_k", "_part"], lambda a, b: abs(a[1] - b[1]) <= tolerance, "near"))
    named = lambda df, row: free(df, row).filter("_f IS NOT NULL").select("_k", row, "_a", "_f")
    found = keep(_walked(named(g, "gt_row"), named(p, "pred_row"), ["_k"], lambda a, b: a[2] in b[2] or b[2] in a[2], "function"))
    found = keep(_paired(free(g, "gt_row").filter("_a IS NULL AND _f IS NULL"), free(p, "pred_row"), ["_k"], "label"))
    return found.join(g.select("_k", *keys).distinct(), "_k").select(*keys, "gt_row", "pred_row", "how")


# Families of sinks whose labels are taken for one another at part credit.
SINK_FAMILIES = {"MEMORY_WRITE": ["COPY_SINK", "MEMSET_SINK", "STORE_SINK", "LOOP_WRITE_SINK", "LENGTH_TRUST_SINK", "UNBOUNDED_WALK_SINK", "PARSING_OVERFLOW_SINK"], "FORMAT_STRING": ["FORMAT_STRING", "FORMAT_STRING_SINK"], "FUNC_PTR": ["FUNC_PTR", "FUNC_PTR_SINK"]}


def sink_family(label: Column) -> Column:
    """The family of a label; labels of no family are one of their own."""
    return F.coalesce(*[F.when(label.isin(labels), F.lit(name)) for name, labels in SINK_FAMILIES.items()], label)


def detailed_match(gt: DataFrame, pred: DataFrame, keys: Sequence[str], label: str = "label", part: float = 0.5) -> DataFrame:
    """Rows (keys, gt_id, pred_id, how, credit): :func:`staged_match` by label first, with credit 1; then what is left on both
    sides by family of labels, at equal or near address or by name, with credit ``part``.

    ``gt`` has gt_id, ``pred`` pred_id, unique within ``keys``, and both label, address, function_name.
    """
    g, p = gt.withColumnRenamed("gt_id", "gt_row"), pred.withColumnRenamed("pred_id", "pred_row")
    exact = materialize(staged_match(g, p, [*keys, label]), "exact")
    same = lambda row: [F.col(f"x.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*keys, row)]
    left = lambda df, row: df.alias("x").join(exact.alias("m"), same(row), "left_anti").withColumn("_family", sink_family(F.col(label))).filter("address IS NOT NULL OR function_name IS NOT NULL")
    partial = staged_match(left(g, "gt_row"), left(p, "pred_row"), [*keys, "_family"])
    rows = exact.drop(label).withColumn("credit", F.lit(1.0)).unionByName(partial.drop("_family").withColumn("how", F.concat("how", F.lit("_family"))).withColumn("credit", F.lit(part)))
    return rows.withColumnsRenamed({"gt_row": "gt_id", "pred_row": "pred_id"})


def match_scores(gt: DataFrame, pred: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``keys`` the counts and rates of :func:`detailed_match`, strict (only full credit counts) and weighted."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    hits = matches.groupBy(*keys).agg(F.count_if(F.col("credit") >= 1).alias("tp"), F.sum("credit").alias("credit"))
    both = count(gt, "n_gt").join(count(pred, "n_pred"), list(keys), "full_outer").join(hits, list(keys), "left").fillna(0, ["n_gt", "n_pred", "tp", "credit"])
    p, r = safe_ratio(F.col("credit"), F.col("n_pred")), safe_ratio(F.col("credit"), F.col("n_gt"))
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_gt") - F.col("tp")
    return both.select(*keys, "tp", fp.alias("fp"), fn.alias("fn"), *rates(F.col("tp"), fp, fn), p.alias("weighted_precision"), r.alias("weighted_recall"), safe_ratio(2 * p * r, p + r).alias("weighted_f1"))


def artifact_score(pairs: DataFrame, terms: Sequence[tuple[Column, float]], vetoes: Sequence[Column] = ()) -> DataFrame:
    """``pairs`` with ``score``: the weights of all ``terms`` that hold, -1 (never matched) where none does or a veto holds."""
    total = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in terms), F.lit(0.0))
    veto = F.lit(False)
    for v in vetoes:
        veto = veto | F.coalesce(v, F.lit(False))
    return pairs.withColumn("score", F.when(veto | (total <= 0), F.lit(-1.0)).otherwise(total))


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """Per label true and false positives and false negatives with rates, from rows of actual and predicted labels."""
    sides = F.array(F.struct(actual.alias("label"), F.lit("gt").alias("side")), F.struct(predicted.alias("label"), F.lit("pred").alias("side")))
    hit = F.coalesce(actual == predicted, F.lit(False))
    rows = df.select(hit.alias("hit"), F.explode(sides).alias("s")).select("hit", "s.*").filter("label IS NOT NULL")
    tp, fp, fn = F.count_if((F.col("side") == "gt") & F.col("hit")), F.count_if((F.col("side") == "pred") & ~F.col("hit")), F.count_if((F.col("side") == "gt") & ~F.col("hit"))
    counts = rows.groupBy("label").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return counts.select("label", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def ordered_status(predicted: Column, expected: Column, order: Sequence[str]) -> Column:
    """exact, over or under after the rank of both in ``order``; unknown values rank below all."""
    rank = lambda c: F.coalesce(*[F.when(c == v, F.lit(i + 1)) for i, v in enumerate(order)], F.lit(0))
    return F.when(expected.isNull(), "unspecified").when(predicted.isNull(), "missing").when(rank(predicted) == rank(expected), "exact").when(rank(predicted) > rank(expected), "over").otherwise("under")


def rule_verdict(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str, bool, Column]], label: str) -> DataFrame:
    """Per row a verdict from the rules of its label: (label, rule id, required, condition that may be null).

    A required rule that fails rejects; all required ones satisfied verify; else the row is partial, or unknown if its
    label has no rules. Optional rules are counted only.
    """
    checks = F.array(*[F.struct(F.lit(lb).alias("label"), F.lit(i).alias("id"), F.lit(req).alias("required"), cond.alias("ok")) for lb, i, req, cond in rules])
    own = F.filter(checks, lambda c: c["label"] == F.col(label))
    need = F.filter(F.col("_c"), lambda c: c["required"])
    verdict = (
        F.when(F.size("_c") == 0, "UNKNOWN").when(F.exists(need, lambda c: F.coalesce(~c["ok"], F.lit(False))), "REJECTED")
        .when(F.forall(need, lambda c: F.coalesce(c["ok"], F.lit(False))), "VERIFIED").otherwise("PARTIAL")
    )
    return df.withColumn("_c", own).select(*keys, label, verdict.alias("verdict"), F.size(F.filter("_c", lambda c: F.coalesce(c["ok"], F.lit(False)))).alias("satisfied"))
