"""How stable a score is: rank correlation, top-k overlap, reaction to an outlier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip
from ..functions.scoring import scaled_between
from .joins import left_on, with_group_stats, with_table_stats
from .ordering import exact_quantiles, top_per_group, top_rows, value_ranks


def with_minmax_score(df: DataFrame, scores: dict[str, tuple[Column, bool]]) -> DataFrame:
    """Min-max scores over the whole table (the scaling the anchored bands replaced)."""
    raw = df.withColumns({f"__r_{n}": v.cast("double") for n, (v, _) in scores.items()})
    limits = {f"__lo_{n}": F.min(f"__r_{n}") for n in scores} | {f"__hi_{n}": F.max(f"__r_{n}") for n in scores}
    bounded = with_table_stats(raw, limits)
    return bounded.withColumns(
        {
            n: scaled_between(f"__r_{n}", F.col(f"__lo_{n}"), F.col(f"__hi_{n}"), inv)
            for n, (_, inv) in scores.items()
        }
    ).select(*df.columns, *scores)


def spearman(df: DataFrame, a: str, b: str, out: str = "spearman", keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation over rows where both values are known; 0 when one side is constant.

    With ``keys`` every group gets its own correlation in the same pass.
    """
    both = df.select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b")).where(
        F.col("__a").isNotNull() & F.col("__b").isNotNull()
    )
    ranks_a = value_ranks(both, "__a", keys, out="__ra")
    ranks_b = value_ranks(both, "__b", keys, out="__rb")
    # Equal pairs are combined first, so the joins see one row per distinct pair.
    pairs = both.groupBy(*keys, "__a", "__b").agg(F.count("*").alias("__n"))
    ranked = pairs.join(ranks_a, [*keys, "__a"]).join(ranks_b, [*keys, "__b"])
    n, ra, rb = F.col("__n"), F.col("__ra"), F.col("__rb")
    moments = ranked.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(n * ra).alias("sa"),
        F.sum(n * rb).alias("sb"),
        F.sum(n * ra * ra).alias("saa"),
        F.sum(n * rb * rb).alias("sbb"),
        F.sum(n * ra * rb).alias("sab"),
    )
    va = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")
    vb = F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    return moments.select(
        *keys, F.when((va > 0) & (vb > 0), cov / F.sqrt(va) / F.sqrt(vb)).otherwise(F.lit(0.0)).alias(out)
    )


def topk_overlap(
    df: DataFrame, a: str, b: str, ids: Sequence[str], k: int = 10, out: str = "overlap", keys: Sequence[str] = ()
) -> DataFrame:
    """Number of ids that are in the top k of both scores, over the table or per group."""
    tie = [F.col(i).asc() for i in ids]
    if not keys:
        first = top_rows(df, [F.col(a).desc_nulls_last(), *tie], k).select(*ids).distinct()
        second = top_rows(df, [F.col(b).desc_nulls_last(), *tie], k).select(*ids).distinct()
        return first.intersect(second).agg(F.count("*").alias(out))
    first = top_per_group(df, keys, [F.col(a).desc_nulls_last(), *tie], k).select(*keys, *ids).distinct()
    second = top_per_group(df, keys, [F.col(b).desc_nulls_last(), *tie], k).select(*keys, *ids).distinct()
    return first.intersect(second).groupBy(*keys).agg(F.count("*").alias(out))


def outlier_shifts(
    df: DataFrame, value: str, ids: Sequence[str], band: Sequence[str], keys: Sequence[str], factor: float = 3.0
) -> DataFrame:
    """Median absolute score change of all other rows when the largest value is multiplied.

    Compares anchored and min-max scaling. ``band`` names the columns with the low end, the high
    end and the inversion flag of the anchor, equal within a group. One row with the largest value is
    moved. Everything is read from (key, value) counts: the other rows are all values with one of
    the largest taken away, and only the ends of the scale move. An anchored score depends on its
    own row alone, so no other row changes (NULL where there is none).
    """
    invert = F.col(band[2])
    counts = (
        df.select(*keys, *band, F.col(value).cast("double").alias("__raw")).where(F.col("__raw").isNotNull())
        .groupBy(*keys, *band, "__raw").agg(F.count(F.lit(1)).alias("__n"))
    )
    ends = with_group_stats(counts, keys, {"__lo": F.min("__raw"), "__hi": F.max("__raw")})
    others = ends.withColumn("__n", F.col("__n") - (F.col("__raw") == F.col("__hi")).cast("int")).where("__n > 0")
    peak = F.col("__hi") * factor
    ranged = with_group_stats(others, keys, {"__min": F.min("__raw"), "__max": F.max("__raw")}).withColumns(
        {"__lo2": F.least("__min", peak), "__hi2": F.greatest("__max", peak)}
    )

    def minmax(low: str, high: str) -> Column:
        plain = scaled_between("__raw", F.col(low), F.col(high))
        return F.when(invert, 100.0 - plain).otherwise(plain)

    changes = ranged.select(*keys, "__n", F.abs(minmax("__lo2", "__hi2") - minmax("__lo", "__hi")).alias("change"))
    medians = exact_quantiles(changes, "change", {"shift": 0.5}, keys, weight="__n")
    every = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return left_on(every, medians, keys).select(
        *keys, F.col("shift").alias("legacy_outlier_median_abs_shift"),
        F.when(F.col("shift").isNotNull(), F.lit(0.0)).alias("anchored_outlier_median_abs_shift"),
    )
