"""Evaluation of retrieval runs: case verdicts, release gate, run comparison, latency figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS_RATE = 0.80
MAX_DROP = 0.05
TOP_N = 5
DUMP_CHARS = 200


def evaluate_cases(cases: DataFrame, report: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """One verdict per case.

    ``cases``: case_name, expected_md_id ('' for a negative), expected_document_id, expected_anchor_prefix,
    expected_text_contains, enabled. ``report``: check_compliance rows with query_id = case_name. With both an
    anchor prefix and a text given one of them is enough, else the one given must hold. Disabled cases pass.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    anchor_ok = ~some("expected_anchor_prefix") | F.startswith(
        F.coalesce("paragraph_anchor", F.lit("")), F.col("expected_anchor_prefix")
    )
    text_ok = ~some("expected_text_contains") | F.contains(
        F.lower(F.coalesce("quoted_text", F.lit(""))), F.lower("expected_text_contains")
    )
    either = some("expected_anchor_prefix") & some("expected_text_contains")
    criteria = F.when(either, anchor_ok | text_ok).otherwise(anchor_ok & text_ok)
    right_document = F.col("document_id").eqNullSafe(F.col("expected_document_id"))
    hit = (F.col("rank") <= top_n) & right_document & criteria
    joined = cases.join(report.withColumnRenamed("query_id", "case_name"), "case_name", "left")
    per_case = joined.groupBy("case_name").agg(
        F.first("expected_md_id").alias("expected_md_id"),
        F.first(F.coalesce("enabled", F.lit(True))).alias("enabled"),
        F.bool_or(F.coalesce("low_confidence", F.lit(True))).alias("low_confidence"),
        F.max("retrieval").alias("retrieval_mode"),
        F.count("rank").alias("provisions"),
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"),
        F.min_by(F.coalesce("paragraph_anchor", F.lit("")), F.when(hit, F.col("rank"))).alias("hit_anchor"),
        F.coalesce(F.bool_or(right_document), F.lit(False)).alias("present"),
        F.array_sort(F.collect_set(F.element_at(F.split("document_id", ":"), -1))).alias("seen"),
    )
    negative = F.coalesce("expected_md_id", F.lit("")) == ""
    passed = F.when(~F.col("enabled"), True).when(negative, F.col("low_confidence")).otherwise(F.col("hit"))
    detail = (
        F.when(~F.col("enabled"), "skipped (disabled)")
        .when(negative & F.col("low_confidence"), "low confidence as expected")
        .when(negative, F.concat(F.lit("expected low confidence, got "), F.col("provisions"), F.lit(" provisions")))
        .when(F.col("hit"), F.concat(F.lit("matched at "), F.col("hit_anchor")))
        .when(F.col("provisions") == 0, "no provisions returned")
        .when(
            ~F.col("present"),
            F.concat(F.lit("expected "), F.col("expected_md_id"), F.lit(" not among "), F.array_join("seen", ",")),
        )
        .otherwise(F.concat(F.lit("expected "), F.col("expected_md_id"), F.lit(" present but unmatched")))
    )
    return per_case.select(
        "case_name", "enabled", passed.alias("passed"), detail.alias("detail"), "low_confidence", "retrieval_mode", "provisions"
    )


def eval_gate(results: DataFrame, previous_rate: Column | None = None, pass_rate: float = PASS_RATE, max_drop: float = MAX_DROP) -> DataFrame:
    """total, passed, failed, hit_rate, gate_passed; with a previous rate also release_ok (drop below five points)."""
    out = (
        results.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))
        .withColumn("failed", F.col("total") - F.col("passed"))
        .withColumn("hit_rate", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0))
        .withColumn("gate_passed", F.col("hit_rate") >= pass_rate)
    )
    if previous_rate is None:
        return out
    drop = F.round(previous_rate - F.col("hit_rate"), 9)
    return out.withColumn(
        "release_ok", F.col("gate_passed") & F.coalesce(drop < max_drop, F.lit(True))
    )


def locked_regressions(results: DataFrame, locked: DataFrame) -> DataFrame:
    """(locked, broken, ok): the named cases must pass whatever the overall rate; an absent one is broken."""
    joined = locked.select("case_name").distinct().join(results.select("case_name", "passed"), "case_name", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("locked"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("broken")
    ).withColumn("ok", F.col("broken") == 0)


def provision_keys(report: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """(query_id, keys): ordered document::anchor keys of the first hits."""
    key = F.concat(F.coalesce("document_id", F.lit("")), F.lit("::"), F.coalesce("paragraph_anchor", F.lit("")))
    ranked = F.array_sort(F.collect_list(F.when(F.col("rank") <= top_n, F.struct("rank", key.alias("key")))))
    return report.groupBy("query_id").agg(F.transform(ranked, lambda r: r["key"]).alias("keys"))


def dump_cases(results: DataFrame, report: DataFrame, cases: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """(case_name, line): one JSON line per case, provision texts cut at 200 characters.

    ``results`` may carry latency_ms, the milliseconds a case took; it is written where it is known.
    """
    provision = F.struct(
        "rank", "document_id", "paragraph_anchor", F.substring(F.coalesce("quoted_text", F.lit("")), 1, DUMP_CHARS).alias("quoted_text"),
        "fusion_score", "sparse_rank", "dense_rank",
    )
    tops = (
        report.filter(F.col("rank") <= top_n)
        .groupBy(F.col("query_id").alias("case_name"))
        .agg(F.array_sort(F.collect_list(provision)).alias("top_provisions"))
    )
    joined = results.join(cases.select("case_name", "clause", "expected_md_id"), "case_name").join(tops, "case_name", "left")
    empty = F.array().cast(tops.schema["top_provisions"].dataType)
    line = F.to_json(
        F.struct(
            "case_name", "clause", "expected_md_id", "passed", "low_confidence", "retrieval_mode", "detail",
            *(["latency_ms"] if "latency_ms" in results.columns else []),
            F.transform(
                F.coalesce("top_provisions", empty),
                lambda p: F.struct(
                    p["document_id"].alias("document_id"), p["paragraph_anchor"].alias("paragraph_anchor"),
                    p["quoted_text"].alias("quoted_text"), p["fusion_score"].alias("fusion_score"),
                    p["sparse_rank"].alias("sparse_rank"), p["dense_rank"].alias("dense_rank"),
                ),
            ).alias("top_provisions"),
        )
    )
    return joined.select("case_name", line.alias("line"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; two empty ones agree."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def compare_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per case of two runs (case_name, passed, keys): agreement and outcome; a case missing on one side is named."""
    left = a.select("case_name", F.struct("passed", "keys").alias("a"))
    right = b.select("case_name", F.struct("passed", "keys").alias("b"))
    both = left.join(right, "case_name", "full_outer")
    present = F.col("a").isNotNull() & F.col("b").isNotNull()
    first = lambda s: F.try_element_at(F.col(f"{s}.keys"), F.lit(1))
    top1 = F.coalesce(first("a") == first("b"), F.lit(False))
    return both.select(
        "case_name", present.alias("present"),
        F.when(present, F.col("a.passed")).alias("passed_a"), F.when(present, F.col("b.passed")).alias("passed_b"),
        F.when(present, top1).alias("top1_same"),
        F.when(present, jaccard(F.col("a.keys"), F.col("b.keys"))).alias("jaccard"),
        F.when(~present, "missing on one side")
        .when(F.col("a.passed") != F.col("b.passed"), "different outcome")
        .when(~top1, "top-1 differs")
        .otherwise("same")
        .alias("flag"),
    )


def compare_summary(pairs: DataFrame) -> DataFrame:
    """Aggregate of :func:`compare_pair`; cases missing on one side stay in n only."""
    rate = lambda c: F.count_if(c) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("passed_a")).alias("hit_rate_a"),
        rate(F.col("passed_b")).alias("hit_rate_b"),
        F.count_if(F.col("passed_a") & F.col("passed_b")).alias("both_pass"),
        F.count_if(F.col("passed_a") & ~F.col("passed_b")).alias("only_a"),
        F.count_if(~F.col("passed_a") & F.col("passed_b")).alias("only_b"),
        F.count_if(~F.col("passed_a") & ~F.col("passed_b")).alias("neither"),
        F.count_if("top1_same").alias("top1_same"),
        F.avg("jaccard").alias("mean_jaccard"),
        F.percentile("jaccard", 0.5).alias("median_jaccard"),
        F.min("jaccard").alias("min_jaccard"),
    )


def compare_runs(runs: DataFrame) -> DataFrame:
    """Every pair of runs (run, case_name, passed, keys) over the cases all runs share: one row per pair.

    ``disagreements`` counts the cases on which not all runs agree; it is the same on every row.
    """
    n_runs = runs.select("run").distinct().agg(F.count(F.lit(1))).scalar()
    shared = (
        runs.groupBy("case_name")
        .agg(F.count_distinct("run").alias("_runs"), F.count_distinct("passed").alias("_outcomes"))
        .filter(F.col("_runs") == n_runs)
    )
    full = runs.join(shared, "case_name")
    disagreements = shared.agg(F.count_if(F.col("_outcomes") > 1)).scalar()
    cases = runs.select("case_name").distinct().agg(F.count(F.lit(1))).scalar()
    side = lambda s: full.select(
        "case_name", F.col("run").alias(f"run_{s}"), F.col("passed").alias(f"passed_{s}"), F.col("keys").alias(f"keys_{s}")
    )
    pairs = side("a").join(side("b"), "case_name").filter(F.col("run_a") < F.col("run_b"))
    first = lambda s: F.try_element_at(F.col(f"keys_{s}"), F.lit(1))
    overlap = jaccard(F.col("keys_a"), F.col("keys_b"))
    return (
        pairs.groupBy("run_a", "run_b")
        .agg(
            F.count_if("passed_a").alias("passed_a"),
            F.count_if("passed_b").alias("passed_b"),
            F.count_if(F.coalesce(first("a") == first("b"), F.lit(False))).alias("top1_same"),
            F.avg(overlap).alias("mean_jaccard"),
            F.percentile(overlap, 0.5).alias("median_jaccard"),
            F.min(overlap).alias("min_jaccard"),
        )
        .withColumn("cases", cases)
        .withColumn("disagreements", disagreements)
    )


def latency_stats(calls: DataFrame, groups: Sequence[str], value: str, share: float = 0.95, buckets: int = 1024) -> DataFrame:
    """calls, mean, min, max and p95 per group, p95 being the sorted value at position int(n * share).

    Exact without sorting a group: counts per value are summed into value ranges, and only the range that holds
    the wanted position is ordered, so a group with most of the rows is still worked on by many tasks.
    """
    groups = list(groups)
    counts = calls.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy(*groups).agg(
        F.sum("c").alias("calls"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    width = F.col("max") - F.col("min")
    number = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col(value) - F.col("min")) / width * buckets), F.lit(buckets - 1))
    )
    bucketed = counts.join(totals, groups).withColumn("bucket", number.cast("int"))
    wanted = F.floor(F.col("calls") * F.lit(share)) + 1
    per_bucket = bucketed.groupBy(*groups, "bucket", "calls").agg(F.sum("c").alias("in_bucket"))
    upto = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    target = (
        per_bucket.withColumn("through", F.sum("in_bucket").over(upto))
        .withColumn("before", F.col("through") - F.col("in_bucket"))
        .filter((F.col("before") < wanted) & (wanted <= F.col("through")))
        .select(*groups, "bucket", "before")
    )
    inside = Window.partitionBy(*groups, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = (
        bucketed.join(target, [*groups, "bucket"])
        .withColumn("upto", F.col("before") + F.sum("c").over(inside))
        .filter(F.col("upto") >= wanted)
        .groupBy(*groups)
        .agg(F.min(value).alias("p95"))
    )
    return totals.join(picked, groups)
