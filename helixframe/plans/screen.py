"""Plan, score and summarise a screen of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.functions import vectors as V
from helixframe.operators import aggregates, classify, joins, matching, ordering, reshape

GROUP_ORDER = ["splice_dinucleotide", "splice_nearby_20bp", "other_snv"]


def run_plan(variants: DataFrame, nearby: DataFrame, dinucleotide: DataFrame, key: list[str], length: int, limit: int = 0, retain: int = 0) -> DataFrame:
    """Variants in order of priority, position and allele, with run_id, window and whether raw arrays are kept."""
    sets = [(GROUP_ORDER[0], dinucleotide), (GROUP_ORDER[1], nearby)]
    p = classify.priority_by_membership(variants, key, sets, GROUP_ORDER[2], "screen_group")
    order = [ordering.by_priority(F.col("screen_group"), GROUP_ORDER), F.col("position_1based"), F.col("ref"), F.col("alt")]
    first = ordering.first_rows(p, order, limit)
    start = F.col("position_1based") - length // 2
    out = first.withColumns({"run_id": S.variant_key("cv", F.col("id"), F.col("position_1based"), F.col("ref"), F.col("alt")), "window_start_1based": start, "window_end_1based": start + length - 1})
    if not retain:
        return out.withColumn("retain_raw", F.lit(False))
    kept = out.orderBy(*order).limit(retain).select("run_id").withColumn("retain_raw", F.lit(True))
    return out.join(kept, "run_id", "left").withColumn("retain_raw", F.coalesce("retain_raw", F.lit(False)))


def summarise_variant(results: DataFrame, centre: int, site_index: str = "site_index", series: str = "relative_l2", radius: int = 20) -> DataFrame:
    """Means of a run's series: whole, before and after the variant, and around variant and nearest site if the window is whole."""
    v = F.col(series)
    return results.withColumns(
        {
            "mean_relative_l2": V.mean(v), "pre_variant_mean": V.slice_mean(v, 0, centre), "post_variant_mean": V.slice_mean(v, F.lit(centre), F.size(v)),
            "variant_20bp_mean_relative_l2": V.region_mean(v, centre, radius), "nearest_site_mean_relative_l2": V.region_mean(v, F.col(site_index), radius),
            "max_relative_l2": F.array_max(V.wide(v)), "max_offset_bp": V.argmax(v) - centre,
        }
    ).drop(series)


def group_summary(datasets: dict[str, DataFrame], group: str, metrics: list[str]) -> DataFrame:
    """n, median, p90, p99 and maximum of each metric by dataset and group; NULL metrics don't count as zero."""
    return aggregates.distribution_summary(reshape.tagged_union(datasets), ["dataset", group], metrics)


def candidates(summary: DataFrame, key: str, group: list[str], locus: str, metrics: list[tuple[str, str]], control_metric: str, k: int) -> DataFrame:
    """Top rows by either metric with their labels, and a matched control for each."""
    labels = ordering.top_labels(summary, key, metrics, k)
    chosen = summary.join(labels, key).select(key, *group, locus, control_metric, "labels")
    # at most k rows for each metric
    from pyspark.sql import Window

    chosen = chosen.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc(control_metric), key)))
    controls = matching.matched_controls(chosen, summary, key, group, locus, control_metric)
    marked = controls.select(F.col("control").alias(key), F.concat(F.lit("comparison_for:"), F.col(key)).alias("labels"))
    return chosen.select(key, "labels").unionByName(marked)


def native_versus_corrected(native: DataFrame, corrected: DataFrame, key: list[str], centre: int, series: str = "relative_l2") -> DataFrame:
    """Means before and after the variant of two runs of the same variants, and how they differ."""
    side = lambda df, name: df.select(*key, V.slice_mean(F.col(series), 0, centre).alias(f"{name}_pre"), V.slice_mean(F.col(series), F.lit(centre), F.size(series)).alias(f"{name}_post"))
    both = joins.one_to_one(side(native, "native"), side(corrected, "corrected"), key)
    return both.withColumns({"pre_change": F.col("corrected_pre") - F.col("native_pre"), "post_change": F.col("corrected_post") - F.col("native_post")})
