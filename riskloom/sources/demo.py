"""A made table of users whose churn two columns give away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def demo_frame(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """15 columns. days_since_last_login is made from the target; cohort_engagement_v2
    is noise for the earlier 70 % of sign-up dates and made from the target after
    them; income is null for 15 %, revenue is skewed, two columns are constant."""
    k = iter(range(seed * 100, seed * 100 + 100))
    u = lambda: F.rand(next(k))
    g = lambda: F.randn(next(k))

    def whole(low: int, high: int):
        return F.least(F.floor(F.lit(low) + u() * (high - low)), F.lit(high - 1)).cast("long")

    level = u()
    df = spark.range(1, n + 1, 1, 4).select(
        F.col("id").alias("user_id"),
        whole(0, 731).alias("_day"),
        F.round(F.greatest(F.lit(18.0), F.least(F.lit(90.0), g() * 12 + 38))).cast("long").alias("age"),
        F.when(u() >= 0.15, F.exp(g() * 0.8 + 10.5)).alias("income"),
        whole(0, 120).alias("tenure_months"),
        F.greatest(F.round(g() * 15**0.5 + 15), F.lit(0.0)).cast("long").alias("_logins"),
        F.when(level < 0.55, "free").when(level < 0.80, "pro").when(level < 0.95, "team").otherwise("enterprise").alias("plan"),
        F.element_at(F.array(*map(F.lit, ("US", "GB", "DE", "FR", "BR", "JP", "IN", "AU"))), whole(1, 9).cast("int")).alias("country"),
        whole(1, n + 1).alias("referrer_id"),
        F.lit("active").alias("status"),
        F.lit(42).cast("long").alias("constant_col"),
        (F.exp(g() * 1.5 + 3) * F.when(u() < 0.004, 50).otherwise(1)).alias("_spent"),
        u().alias("_chance"),
        (g() * 0.4).alias("_shift"),
        g().alias("_noise"),
        u().alias("_since"),
        u().alias("_even"),
    )
    df = df.withColumn("n_logins", F.col("_logins") + F.floor(F.col("tenure_months") / 12))
    often = F.col("n_logins") / F.greatest(F.col("tenure_months"), F.lit(1))
    odds = F.lit(-2.5) + 1.5 * (often < 2).cast("int") + 0.8 * (F.col("plan") == "free").cast("int") + F.col("_shift") - 0.02 * (F.col("age") - 38)
    df = df.withColumn("churned", (F.col("_chance") < 1 / (1 + F.exp(-odds))).cast("long"))
    # The time-ordered split falls where the leak begins: at the row quantile of the date.
    df = df.crossJoin(F.broadcast(df.agg(F.percentile("_day", 0.7).alias("_edge"))))
    made = F.when(F.col("churned") == 1, F.col("_noise") * 0.01 + 0.9).otherwise(F.col("_noise") * 0.01 + 0.1)
    return df.select(
        "user_id",
        F.date_add(F.lit("2024-04-30").cast("date"), F.col("_day").cast("int")).alias("signup_date"),
        "age",
        "income",
        "tenure_months",
        "n_logins",
        "plan",
        "country",
        "referrer_id",
        "status",
        "constant_col",
        F.when(F.col("plan") == "free", 0.0).otherwise(F.col("_spent")).alias("revenue"),
        F.when(F.col("_day") > F.col("_edge"), made).otherwise(F.col("_even")).alias("cohort_engagement_v2"),
        F.floor(F.when(F.col("churned") == 1, 30 + F.col("_since") * 335).otherwise(F.col("_since") * 14)).cast("long").alias("days_since_last_login"),
        "churned",
    )
