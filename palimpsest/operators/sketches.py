"""Usage figures of any period from daily sketches: quantiles of durations and distinct users; top users and counts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a quantile sketch (rank error about 2.3 / K**0.9, 0.3 % here).
K = 1600


def daily_sketches(activity: DataFrame, time: str = "logged_at", user: str = "user_uuid", duration: str = "duration_ms", by: tuple[str, ...] = ()) -> DataFrame:
    """(day, [by], n, duration_sum, n_durations, durations, distinct, item), to be kept and merged: a row a day, whose item is null, and a row for each user of a day.

    durations is a KLL sketch, distinct a HyperLogLog sketch, both null in the rows of users, which hold a user's name as `item` and the count n: the most frequent
    users of a period can't be told from a bounded sketch of its days. All are combined in the tasks before the shuffle. Rows without a time are left out; null users
    and durations enter no sketch.
    """
    seconds = F.col(duration).cast("double")
    name = F.col(user).cast("string")
    timed = activity.filter(F.col(time).isNotNull()).withColumns({"day": F.to_date(time), "item": name})
    days = timed.groupBy("day", *by).agg(
        F.count("*").alias("n"),
        F.sum(seconds).alias("duration_sum"),
        F.count(duration).alias("n_durations"),
        F.kll_sketch_agg_double(seconds, K).alias("durations"),
        F.hll_sketch_agg(name).alias("distinct"),
    )
    users = timed.filter("item is not null").groupBy("day", *by, "item").agg(F.count("*").alias("n"))
    return days.withColumn("is_day", F.lit(True)).unionByName(users.withColumn("is_day", F.lit(False)), allowMissingColumns=True)


def period_figures(daily: DataFrame, period: Column, by: tuple[str, ...] = (), top: int = 10) -> DataFrame:
    """(period, [by], n, distinct_users, mean_duration, p95_duration, top_users) of the days merged by `period`, an expression of `day`.

    top_users is an array of (item, count), the most frequent first, smaller names first among equals. No activity row is read again.
    """
    keys = ("period", *by)
    rows = daily.withColumn("period", period)
    merged = rows.filter("is_day").groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_users"),
        F.try_divide(F.sum("duration_sum"), F.sum("n_durations")).alias("mean_duration"),
        F.kll_merge_agg_double("durations", K).alias("__durations"),
    )
    counted = rows.filter("not is_day").groupBy(*keys, "item").agg(F.sum("n").alias("count"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "item")
    first = counted.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top)
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rn", "item", "count"))).alias("l"))
    named = listed.select(*(F.col(k).alias(f"__{k}") for k in keys), F.transform("l", lambda x: F.struct(x["item"].alias("item"), x["count"].alias("count"))).alias("top_users"))
    same = [merged[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    p95 = F.when(F.kll_sketch_get_n_double("__durations") > 0, F.kll_sketch_get_quantile_double("__durations", F.lit(0.95)))
    return merged.join(named, same, "left").withColumns({"p95_duration": p95, "top_users": F.coalesce("top_users", F.array().cast("array<struct<item:string,count:bigint>>"))}).drop("__durations", *(f"__{k}" for k in keys))
