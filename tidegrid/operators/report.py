"""Summaries of per-target results, text reports and masked layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.config import FDR_LEVEL
from tidegrid.operators.stats import significant


CONSTANTS = ("n_exhaustive_shifts", "p_resolution_min", "n_exhaustive_shifts_sensitivity", "p_resolution_min_sensitivity")


def _said(value: Column, form: str = "%.5f") -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.format_string(form, value))


def optional(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds columns that older results lack, as null."""
    return rows.withColumns({c: F.lit(None).cast("double") for c in columns if c not in rows.columns})


def metrics(results: DataFrame, keys: list[str], level: float = FDR_LEVEL) -> DataFrame:
    """One row for each key over all its targets; `N/A` where nothing can be told. One pass, one shuffle."""
    rows = optional(results, ["r2_global_normalized", "delta_r2_normalized", "p_value_fdr_sensitivity", *CONSTANTS])
    d, r, dn, rn = F.col("delta_r2"), F.col("r2_global"), F.col("delta_r2_normalized"), F.col("r2_global_normalized")
    sig, far = significant(F.col("p_value_fdr"), level), significant(F.col("p_value_fdr_sensitivity"), level)
    has = dn.isNotNull()
    pct = lambda c: F.avg(c.cast("double")) * 100
    at = lambda c, p: F.percentile(c, F.lit(p))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), at(r, 0.5).alias("r2_global_median"), F.max(r).alias("r2_global_max"), pct(r > 0).alias("r2_global_positive_pct"),
        at(d, 0.5).alias("delta_median"), (at(d, 0.75) - at(d, 0.25)).alias("delta_iqr"), at(d, 0.05).alias("delta_p5"), at(d, 0.95).alias("delta_p95"), F.min(d).alias("delta_min"), F.max(d).alias("delta_max"), pct(d > 0).alias("delta_positive_pct"),
        F.count_if(sig).alias("sig_count"), pct(sig).alias("sig_pct"), F.avg(F.when(sig, d)).alias("_sm"), at(F.when(sig, d), 0.5).alias("_sd"), F.max(F.when(sig, d)).alias("_sx"),
        pct(has).alias("ceiling_pct"), at(F.when(has, rn), 0.5).alias("_rn"), at(dn, 0.5).alias("_dn"), at(dn, 0.95).alias("_d9"), F.avg(F.when(sig, dn)).alias("_sn"),
        F.count("p_value_fdr_sensitivity").alias("_ns"), F.count_if(far).alias("sig_sensitivity_count"), pct(far).alias("sig_sensitivity_pct"), F.count_if(sig & far).alias("_both"),
        # of one length of test series, so the same in all rows of a key
        *[F.max(c).alias(c) for c in CONSTANTS],
    )
    stable = F.when((F.col("_ns") > 0) & (F.col("sig_count") > 0), F.col("_both") * 100.0 / F.col("sig_count"))
    said = {"sig_delta_mean": _said(F.col("_sm")), "sig_delta_median": _said(F.col("_sd")), "sig_delta_max": _said(F.col("_sx")), "r2_global_normalized_median": _said(F.col("_rn")), "delta_normalized_median": _said(F.col("_dn")), "delta_normalized_p95": _said(F.col("_d9")), "sig_delta_normalized_mean": _said(F.col("_sn")), "sensitivity_computable": F.col("_ns") > 0, "sensitivity_stability_pct": _said(stable, "%.2f")}
    return out.withColumns(said).drop("_sm", "_sd", "_sx", "_rn", "_dn", "_d9", "_sn", "_ns", "_both")


def across(summary: DataFrame) -> DataFrame:
    """Means over subjects and how many show an effect; an empty summary gives zero subjects and nulls."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("r2_global_median", "r2_global_positive_pct", "delta_median", "delta_positive_pct", "ceiling_pct", "sig_pct", "sig_sensitivity_pct")]
    return summary.agg(F.count("*").alias("subjects"), F.count_if(F.col("sig_count") > 0).alias("subjects_with_effect"), *means)


def markdown(summary: DataFrame, key: str) -> DataFrame:
    """key, report: a line for each metric, built row by row where the rows are."""
    lines = [F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for c in summary.columns if c != key]
    return summary.select(key, F.concat_ws("\n", F.concat(F.lit("# "), F.col(key).cast("string")), F.lit(""), *lines).alias("report"))


def _line(form: str, *values) -> Column:
    """A line; N/A stands for what is null."""
    return F.format_string(form, *[F.coalesce(v if isinstance(v, Column) else F.col(v), F.lit("N/A")) for v in values])


def _num(name: str, places: int) -> Column:
    return F.format_string(f"%.{places}f", name)


def _whole(name: str) -> Column:
    return F.format_number(F.col(name), 0)


def subject_report(summary: DataFrame, key: str, level: float = FDR_LEVEL) -> DataFrame:
    """key, report: a section for each row of metrics(), line by line where the rows are. What cannot be told is said so:
    gains without a significant target, the ceiling without a target it can be estimated for, the sensitivity without a
    shift beyond the larger margin."""
    lines = [
        _line("### %s\n", F.col(key).cast("string")),
        _line("- Targets: %s", _whole("total")),
        _line("- Full model: median R2 %s, largest R2 %s, above zero in %s%% of targets", _num("r2_global_median", 4), _num("r2_global_max", 4), _num("r2_global_positive_pct", 2)),
        _line("- Gain over the controls, all targets: median %s, interquartile range %s, 5th percentile %s, 95th %s, from %s to %s, above zero in %s%%", _num("delta_median", 5), _num("delta_iqr", 5), _num("delta_p5", 5), _num("delta_p95", 5), _num("delta_min", 5), _num("delta_max", 5), _num("delta_positive_pct", 2)),
        _line(f"- Significant (q < {level}): %s targets (%s%%)", _whole("sig_count"), _num("sig_pct", 2)),
        F.when(F.col("sig_count") > 0, _line("  - their gain: mean %s, median %s, largest %s", "sig_delta_mean", "sig_delta_median", "sig_delta_max")).otherwise(F.lit("  - their gain: N/A, no target passed the corrected level")),
        _line("  - resolution: %s shifts, smallest p %s", _whole("n_exhaustive_shifts"), _num("p_resolution_min", 5)),
        F.when(F.col("ceiling_pct") > 0, _line("- Against the noise ceiling (estimable in %s%% of targets): median R2 %s, median gain %s, 95th percentile of gain %s, mean gain where significant %s", _num("ceiling_pct", 2), "r2_global_normalized_median", "delta_normalized_median", "delta_normalized_p95", "sig_delta_normalized_mean")).otherwise(F.lit("- Against the noise ceiling: N/A, no target has repeats that agree")),
        F.when(
            F.col("sensitivity_computable"),
            F.concat(
                _line("- With the larger margin (%s shifts, smallest p %s): %s significant targets (%s%%)", _whole("n_exhaustive_shifts_sensitivity"), _num("p_resolution_min_sensitivity", 5), _whole("sig_sensitivity_count"), _num("sig_sensitivity_pct", 2)),
                F.when(F.col("sig_count") > 0, _line(", which keep %s%% of those above", "sensitivity_stability_pct")).otherwise(F.lit("")),
            ),
        ).otherwise(F.lit("- With the larger margin: N/A, the test series is too short")),
    ]
    return summary.select(key, F.concat_ws("\n", *lines).alias("report"))


def sample_report(summary: DataFrame, level: float = FDR_LEVEL) -> DataFrame:
    """report: the section on all rows of metrics() together; a description, no inference."""
    lines = [
        F.lit("## All participants\n"),
        _line(f"- Significant targets (q < {level}) in %s of %s", _whole("subjects_with_effect"), _whole("subjects")),
        _line("- Full model: mean of medians R2 %s, above zero in %s%% of targets on average", _num("mean_r2_global_median", 4), _num("mean_r2_global_positive_pct", 2)),
        _line("- Gain: mean of medians %s, above zero in %s%% of targets on average", _num("mean_delta_median", 5), _num("mean_delta_positive_pct", 2)),
        _line("- Noise ceiling estimable in %s%% of targets on average", _num("mean_ceiling_pct", 2)),
        _line("- Significant with the larger margin: %s%% of targets on average", _num("mean_sig_sensitivity_pct", 2)),
    ]
    return across(summary).select(F.concat_ws("\n", *lines).alias("report"))


def document(summary: DataFrame, key: str, title: str, level: float = FDR_LEVEL) -> DataFrame:
    """report: title, each participant's section in order, and the sample's."""
    each = subject_report(summary, key, level).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "report"))), lambda x: x["report"]), "\n\n").alias("a"), F.lit(1).alias("_one"))
    both = each.join(sample_report(summary, level).select(F.col("report").alias("b"), F.lit(1).alias("_one")), "_one")
    return both.select(F.concat_ws("\n\n", F.lit(f"# {title}"), F.lit("## Each participant"), "a", "b").alias("report"))


def layers(results: DataFrame, level: float = FDR_LEVEL, floor: float = 0.01) -> DataFrame:
    """Adds layer_r2 (above the floor), layer_significant and layer_delta."""
    return results.withColumn("layer_r2", F.when(F.col("r2_global") > floor, F.col("r2_global"))).withColumn("layer_significant", F.when(significant(F.col("p_value_fdr"), level), F.col("delta_r2"))).withColumn("layer_delta", F.col("delta_r2"))


def limits(layered: DataFrame, keys: list[str]) -> DataFrame:
    """Colour limits: 99th percentiles, not below fixed floors."""
    p99 = lambda c, f: F.greatest(F.coalesce(F.percentile(c, F.lit(0.99)), F.lit(f)), F.lit(f))
    return layered.groupBy(*keys).agg(p99(F.col("layer_r2"), 0.05).alias("limit_r2"), p99(F.col("layer_significant"), 0.01).alias("limit_significant"), p99(F.abs("layer_delta"), 0.005).alias("limit_delta"))
