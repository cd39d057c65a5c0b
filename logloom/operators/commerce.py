"""Order, payment and job statistics. Money is summed in integer cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .skew import salted_join


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def safe_ratio(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``part / whole`` scaled, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * F.lit(scale) / whole)


def payment_stats(df: DataFrame, amount: Column, success: Column) -> DataFrame:
    """Transactions, revenue of the successful ones, their average, success rate in percent."""
    won = F.sum(F.when(success, cents(amount)))
    return df.agg(F.count("*").alias("n"), F.count_if(success).alias("won"), F.coalesce(won, F.lit(0).cast("bigint")).alias("c")).select(
        F.col("n").alias("total_transactions"), (F.col("c") / 100).alias("total_revenue"),
        safe_ratio(F.col("c"), F.col("won"), 0.01).alias("average_transaction"),
        safe_ratio(F.col("won"), F.col("n")).alias("successful_rate"))


def compare_periods(df: DataFrame, at: str, amount: Column, as_of: str, days: int) -> DataFrame:
    """Last ``days`` against the ``days`` before: difference, percentage, direction per measure, one scan."""
    end = F.lit(as_of).cast("timestamp_ntz")
    mid, start = end - F.expr(f"interval {days} days"), end - F.expr(f"interval {2 * days} days")
    when = F.col(at)
    now, before = (when >= mid) & (when < end), (when >= start) & (when < mid)
    c = cents(amount)
    zero = F.lit(0).cast("bigint")
    sums = df.where((when >= start) & (when < end)).agg(
        F.count_if(now).alias("n1"), F.count_if(before).alias("n0"),
        F.coalesce(F.sum(F.when(now, c)), zero).alias("c1"), F.coalesce(F.sum(F.when(before, c)), zero).alias("c0"))
    n1, n0, c1, c0 = (F.col(x) for x in ("n1", "n0", "c1", "c0"))

    def row(name: str, cur: Column, prev: Column) -> Column:
        return F.struct(F.lit(name).alias("measure"), cur.cast("double").alias("current"), prev.cast("double").alias("previous"),
                        (cur - prev).cast("double").alias("difference"),
                        F.when(prev == 0, F.lit(0.0)).otherwise((cur - prev) * F.lit(100.0) / prev).alias("percentage"),
                        (cur > prev).alias("is_increase"))

    average = [safe_ratio(c1, n1, 1.0), safe_ratio(c0, n0, 1.0)]
    return sums.select(F.inline(F.array(row("transactions", n1, n0), row("revenue_cents", c1, c0), row("average_cents", *average))))


def share_by(df: DataFrame, key: str, amount: Column) -> DataFrame:
    """Count, revenue and percentage of all rows per key; the total is a scalar subquery."""
    total = df.agg(F.count("*").alias("t")).scalar()
    return df.groupBy(key).agg(F.count("*").alias("count"), (F.sum(cents(amount)) / 100).alias("revenue")).withColumn(
        "percentage_of_total", F.col("count") * F.lit(100.0) / total)


def monthly_trend(df: DataFrame, at: str, amount: Column) -> DataFrame:
    """Transactions, revenue and average per month."""
    month = F.trunc(F.col(at), "month")
    sums = df.groupBy(month.alias("m")).agg(F.count("*").alias("transactions"), F.sum(cents(amount)).alias("c"))
    return sums.select(F.date_format("m", "MMM").alias("month"), F.year("m").alias("year"), "transactions",
                       (F.col("c") / 100).alias("revenue"), (F.col("c") / F.col("transactions") / 100).alias("average"))


def daily_trend(df: DataFrame, at: str, amount: Column, last_day: str, days: int) -> DataFrame:
    """Orders and revenue for each of the last ``days`` days, silent days as zero."""
    end = F.to_date(F.lit(last_day))
    first = F.date_sub(end, days - 1)
    day = F.to_date(F.col(at))
    sums = df.where((F.col(at) >= first) & (day <= end)).groupBy(day.alias("day")).agg(
        F.count("*").alias("orders"), F.sum(cents(amount)).alias("c"))
    calendar = df.sparkSession.range(days).select(F.date_sub(end, F.col("id").cast("int")).alias("day"))
    return calendar.join(sums, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"),
        (F.coalesce("c", F.lit(0).cast("bigint")) / 100).alias("revenue"))


def month_over_month(df: DataFrame, at: str) -> DataFrame:
    """Change of the monthly count; the month before is found by an equi-join on the month number."""
    number = (F.year(at) * 12 + F.month(at)).cast("int")
    counts = df.groupBy(number.alias("m")).agg(F.count("*").alias("n"))
    prev = counts.select((F.col("m") + 1).alias("m"), F.col("n").alias("p"))
    return counts.join(prev, "m", "left").select(
        F.floor((F.col("m") - 1) / 12).cast("int").alias("year"), (F.pmod(F.col("m") - 1, F.lit(12)) + 1).alias("month"), "n",
        F.col("p").alias("previous"), (F.col("n") - F.col("p")).alias("change"),
        F.when(F.col("p") > 0, (F.col("n") - F.col("p")) * F.lit(100.0) / F.col("p")).alias("change_pct"))


def rates(df: DataFrame, keys: list[str], parts: dict[str, Column]) -> DataFrame:
    """Share in percent of the rows meeting each condition, per key."""
    counts = [F.count_if(c).alias(f"{n}_count") for n, c in parts.items()]
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), *counts)
    for n in parts:
        out = out.withColumn(f"{n}_rate", safe_ratio(F.col(f"{n}_count"), F.col("total")))
    return out


def affiliate_stats(events: DataFrame, key: str, click: Column, conversion: Column, amount: Column) -> DataFrame:
    """Clicks, conversions, earnings, conversion rate (0 without clicks) and average commission per key."""
    e = events.groupBy(key).agg(
        F.count_if(click).alias("clicks"), F.count_if(conversion).alias("conversions"),
        F.coalesce(F.sum(F.when(conversion, cents(amount))), F.lit(0).cast("bigint")).alias("c"))
    return e.select(key, "clicks", "conversions", (F.col("c") / 100).alias("earnings"),
                    safe_ratio(F.col("conversions"), F.col("clicks")).alias("conversion_rate"),
                    safe_ratio(F.col("c"), F.col("conversions"), 0.01).alias("average_commission"))


def job_stats(df: DataFrame, keys: list[str], status: str, duration: str) -> DataFrame:
    """Totals by outcome, success rate and duration bounds per key."""
    s, d = F.col(status), F.col(duration)
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(s == "success").alias("success"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "warning").alias("warning"), F.min(d).alias("duration_min"), F.max(d).alias("duration_max"),
        F.sum(d).alias("duration_sum"),
    ).withColumn("success_rate", safe_ratio(F.col("success"), F.col("total"))).withColumn(
        "duration_avg", F.col("duration_sum") / F.col("total")).drop("duration_sum")


def category_tree(nodes: DataFrame) -> DataFrame:
    """Depth and path of every node reachable from a root: nodes(id, parent_id, name).

    Pointers are doubled: a node knows the path from an ancestor to itself, and takes over what that ancestor knows, so the rounds grow with the
    logarithm of the depth. A node is done when its ancestor is above a root. Round r ends the depths from 2^(r-1) to 2^r - 1; one that ends none is
    the last, as every deeper node would have an ancestor there. Nodes below a missing parent go, nodes on a cycle stay behind.
    """
    state = cut(nodes.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.col("name").alias("path")))
    while True:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("before"))
        moved = salted_join(state.where(F.col("up").isNotNull()), above, ["up"], "inner", row_key=F.xxhash64("id")).select(
            "id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("before", F.lit(" / "), "path").alias("path"))
        moved = cut(moved)
        state = state.where(F.col("up").isNull()).unionByName(moved)
        if moved.where(F.col("up").isNull()).isEmpty():
            return state.where(F.col("up").isNull()).select("id", "depth", "path")
