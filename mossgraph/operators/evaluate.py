"""Evaluation of predicted classes and partitions, and differences of tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files
from .projection import checksum


def confusion(pairs: DataFrame) -> DataFrame:
    """``pairs(expected, actual)`` -> counts."""
    return pairs.groupBy("expected", "actual").agg(F.count("*").alias("n"))


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class; 0 where undefined."""
    counts = confusion(pairs)
    labels = counts.select(F.col("expected").alias("label")).union(counts.select("actual")).distinct()
    hit = counts.where("expected = actual").select(F.col("expected").alias("label"), F.col("n").alias("tp"))
    want = counts.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("wanted"))
    got = counts.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("got"))
    rows = labels.join(hit, "label", "left").join(want, "label", "left").join(got, "label", "left").na.fill(0)
    p, r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("got")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("wanted")), F.lit(0.0))
    return rows.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"), F.col("wanted").cast("long").alias("support"))


def b_cubed(rows: DataFrame) -> DataFrame:
    """``rows(pred, gold)`` -> one row of precision, recall and F1; counts are summed before they meet."""
    cell = rows.groupBy("pred", "gold").agg(F.count("*").alias("n"))
    cell = cell.withColumns({"np": F.sum("n").over(Window.partitionBy("pred")), "ng": F.sum("n").over(Window.partitionBy("gold"))})
    sums = cell.agg(F.sum(F.col("n") * F.col("n") / F.col("np")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("ng")).alias("r"), F.sum("n").alias("n"))
    p, r = F.coalesce(F.try_divide("p", "n"), F.lit(1.0)), F.coalesce(F.try_divide("r", "n"), F.lit(1.0))
    return sums.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def b_cubed_by(rows: DataFrame, key: str) -> DataFrame:
    """``rows(key, pred, gold)`` -> ``(key, n, precision, recall, f1)`` of each key by itself."""
    cell = rows.groupBy(key, "pred", "gold").agg(F.count("*").alias("n"))
    cell = cell.withColumns({"np": F.sum("n").over(Window.partitionBy(key, "pred")), "ng": F.sum("n").over(Window.partitionBy(key, "gold"))})
    sums = cell.groupBy(key).agg(F.sum(F.col("n") * F.col("n") / F.col("np")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("ng")).alias("r"), F.sum("n").alias("n"))
    p, r = F.col("p") / F.col("n"), F.col("r") / F.col("n")
    return sums.select(key, "n", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def table_diff(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, unexpected or differ in a column."""
    columns = [c for c in expected.columns if c != key]
    a = actual.select(F.col(key).alias("ka"), *[F.col(c).alias(f"a_{c}") for c in columns])
    e = expected.select(F.col(key).alias("ke"), *[F.col(c).alias(f"e_{c}") for c in columns])
    both = a.join(e, F.col("ka") == F.col("ke"), "full_outer")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"a_{c}").eqNullSafe(F.col(f"e_{c}"))
    kind = F.when(F.col("ka").isNull(), F.lit("missing")).when(F.col("ke").isNull(), F.lit("unexpected")).when(changed, F.lit("changed"))
    return both.select(F.coalesce("ka", "ke").alias(key), kind.alias("difference")).where("difference is not null")


def linking_metrics(pairs: DataFrame) -> DataFrame:
    """One row of rates over ``pairs(gold, predicted, gold_match, predicted_match)``; ``new_claim`` is the reject class."""
    reject, told = F.col("gold") == "new_claim", F.col("predicted") == "new_claim"
    same = F.col("gold_match") == F.col("predicted_match")
    share = lambda of, cond: F.round(F.avg(F.when(of, cond.cast("double"))), 6)
    both = F.count_if(reject & told)
    return pairs.agg(
        share(~reject, same & ~told).alias("matched_top1"), share(F.col("gold") == "same_claim", (F.col("predicted") == "same_claim") & same).alias("reuse_accuracy"), share(F.lit(True), reject == told).alias("related_vs_reject"),
        F.round(both / F.count_if(told), 6).alias("reject_precision"), F.round(both / F.count_if(reject), 6).alias("reject_recall"), share(reject, ~told).alias("false_link_rate"),
    )


def worst_by(checks: DataFrame, key: str) -> DataFrame:
    """The worst severity of each group: error before warning before ok."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return checks.groupBy(key).agg(F.max(rank).alias("_r")).select(key, F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), F.col("_r") + 1).alias("severity"))


def exact_partition(members: DataFrame, results: DataFrame) -> DataFrame:
    """``(source_id, exact)``: whether ``results(source_id, result, id)`` hold each of ``members(source_id, id)`` once and nothing else."""
    counted = members.select("source_id", "id", F.lit(1).alias("_m"), F.lit(0).alias("_r")).union(results.select("source_id", "id", F.lit(0), F.lit(1)))
    each = counted.groupBy("source_id", "id").agg(F.sum("_m").alias("_m"), F.sum("_r").alias("_r"))
    return each.groupBy("source_id").agg(F.bool_and((F.col("_m") == 1) & (F.col("_r") == 1)).alias("exact"))


def golden_diff(actual: dict[str, DataFrame], golden: dict[str, DataFrame], key: str) -> DataFrame:
    """``(collection, key, difference)`` over all collections: missing, unexpected and changed rows."""
    out = None
    for name in golden:
        part = table_diff(actual[name], golden[name], key).select(F.lit(name).alias("collection"), key, "difference")
        out = part if out is None else out.unionByName(part)
    return out


class BadGolden(ValueError):
    """Golden views of another version, or not what was written."""


def build_golden(views: dict[str, DataFrame], folder: str, metadata: dict[str, str]) -> dict:
    """Write ``views`` as what later ones are compared with, with ``metadata`` and a checksum of each; an existing folder is refused."""
    spark = next(iter(views.values())).sparkSession
    if files.exists(spark, f"{folder}/manifest.json"):
        raise FileExistsError(folder)
    for name, view in views.items():
        view.write.mode("overwrite").parquet(f"{folder}/{name}")
    manifest = {"metadata": metadata, "checksums": {name: checksum(spark.read.parquet(f"{folder}/{name}")) for name in views}}
    files.write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def compare_golden(actual: dict[str, DataFrame], folder: str, metadata: dict[str, str], key: str = "id") -> DataFrame:
    """``(collection, key, difference)`` between ``actual`` and the golden views of ``folder``, which must be sound and of the same metadata.

    Collections that only one side has are an error."""
    spark = next(iter(actual.values())).sparkSession
    text = files.read_text(spark, f"{folder}/manifest.json")
    if text is None:
        raise BadGolden("no manifest")
    manifest = json.loads(text)
    if manifest["metadata"] != metadata:
        raise BadGolden(f"of {manifest['metadata']}, not {metadata}")
    if set(manifest["checksums"]) != set(actual):
        raise BadGolden(f"collections {sorted(manifest['checksums'])}, not {sorted(actual)}")
    golden = {name: spark.read.parquet(f"{folder}/{name}") for name in actual}
    for name, view in golden.items():
        if checksum(view) != manifest["checksums"][name]:
            raise BadGolden(f"{name} is not what was written")
    return golden_diff(actual, golden, key)


# The classes of a case.
CLASSES = ("same_claim", "near_duplicate", "elaboration", "qualification", "contradiction", "supersedes", "new_claim")


def corpus_problems(cases: DataFrame, version: int = 1, least: int = 6) -> DataFrame:
    """``(problem, id)`` of ``cases(id, expected, matched, rationale, version)``: repeated ids, no rationale, another version, a match
    where there should be none or none where there should be one, and classes with fewer than ``least`` cases."""
    named = lambda rows, problem, key="id": rows.select(F.lit(problem).alias("problem"), F.col(key).cast("string").alias("id"))
    twice = cases.groupBy("id").count().where("count > 1")
    counts = cases.groupBy("expected").agg(F.count("*").alias("n"))
    classes = cases.sparkSession.createDataFrame([(c,) for c in CLASSES], "expected string").join(counts, "expected", "left").where(F.coalesce("n", F.lit(0)) < least)
    wrong = cases.where((F.col("expected") == "new_claim") == F.col("matched").isNotNull())
    return named(twice, "duplicate id").union(named(cases.where(F.trim("rationale") == ""), "no rationale")).union(named(cases.where(F.col("version") != version), "unknown version")).union(named(wrong, "match")).union(named(classes, "too few", "expected"))


def cases(observations: DataFrame, claims: DataFrame, plan) -> DataFrame:
    """``(id, classification, matched)``: each case's observation planned against its own claims; a case is a family."""
    return plan(observations, claims).select(F.col("observation_id").alias("id"), "classification", F.col("matched_claim_id").alias("matched"))
