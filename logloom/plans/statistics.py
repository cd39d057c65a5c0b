"""Commerce and CMS statistics, query-log analytics, data quality, delivery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import commerce, delivery, quality, querylog, relations
from .registry import query

col = F.col
CENTS = "cast(round({} * 100) as bigint)"
PRICE = CENTS.format("o_totalprice")
# the order dates span several years; "now" for period statistics
AS_OF = "2001-01-01"


@query("b60_order_stats", f"select o_orderstatus as status, count(*) as orders, sum({PRICE}) / 100 as revenue, min(o_totalprice) as smallest, max(o_totalprice) as largest from orders group by o_orderstatus")
def order_stats(t):
    return t.orders.groupBy(col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("orders"), (F.sum(commerce.cents(col("o_totalprice"))) / 100).alias("revenue"),
        F.min("o_totalprice").alias("smallest"), F.max("o_totalprice").alias("largest"))


@query("b61_compare_periods", f"""with s as (select count(*) filter (where o_orderdate >= timestamp '{AS_OF}' - interval 365 days) as n1, count(*) filter (where o_orderdate < timestamp '{AS_OF}' - interval 365 days) as n0,
    cast(coalesce(sum({PRICE}) filter (where o_orderdate >= timestamp '{AS_OF}' - interval 365 days), 0) as bigint) as c1, cast(coalesce(sum({PRICE}) filter (where o_orderdate < timestamp '{AS_OF}' - interval 365 days), 0) as bigint) as c0
    from orders where o_orderdate >= timestamp '{AS_OF}' - interval 730 days and o_orderdate < timestamp '{AS_OF}'),
  m as (select 'transactions' as measure, cast(n1 as double) as cur, cast(n0 as double) as prev from s union all select 'revenue_cents', c1, c0 from s
    union all select 'average_cents', case when n1 = 0 then 0 else c1 / n1 end, case when n0 = 0 then 0 else c0 / n0 end from s)
  select measure, cur as current, prev as previous, cur - prev as difference, case when prev = 0 then 0.0 else (cur - prev) * 100.0 / prev end as percentage, cur > prev as is_increase from m""")
def compare_periods(t):
    return commerce.compare_periods(t.orders, "o_orderdate", col("o_totalprice"), AS_OF, 365)


@query("b62_payment_stats", f"""select count(*) as total_transactions, sum({PRICE}) filter (where o_orderstatus = 'F') / 100 as total_revenue,
  cast(sum({PRICE}) filter (where o_orderstatus = 'F') as double) * 0.01 / count(*) filter (where o_orderstatus = 'F') as average_transaction,
  cast(count(*) filter (where o_orderstatus = 'F') as double) * 100.0 / count(*) as successful_rate from orders""")
def payment_stats(t):
    return commerce.payment_stats(t.orders, col("o_totalprice"), col("o_orderstatus") == "F")


@query("b63_method_share", f"select o_orderpriority as method, count(*) as count, sum({PRICE}) / 100 as revenue, cast(count(*) as double) * 100.0 / (select count(*) from orders) as percentage_of_total from orders group by o_orderpriority")
def method_share(t):
    return commerce.share_by(t.orders.withColumnRenamed("o_orderpriority", "method"), "method", col("o_totalprice"))


@query("b64_monthly_trend", f"select strftime(m, '%b') as month, cast(year(m) as integer) as year, n as transactions, c / 100 as revenue, cast(c as double) / n / 100 as average from (select date_trunc('month', o_orderdate) as m, count(*) as n, sum({PRICE}) as c from orders group by m)")
def monthly_trend(t):
    return commerce.monthly_trend(t.orders, "o_orderdate", col("o_totalprice"))


@query("b64_daily_trend", f"""select strftime(d, '%Y-%m-%d') as day, count(o_orderkey) as orders, coalesce(sum({PRICE}), 0) / 100 as revenue from (select unnest(generate_series(timestamp '2000-12-31' - interval 89 days, timestamp '2000-12-31', interval 1 day)) as d)
  left join orders on date_trunc('day', o_orderdate) = d group by d""")
def daily_trend(t):
    return commerce.daily_trend(t.orders, "o_orderdate", col("o_totalprice"), "2000-12-31", 90)


@query("b65_active_recent_lists", """select * from (select 'recent' as list, o_orderkey as id from orders order by o_orderdate desc, o_orderkey limit 10) union all
  select 'published_after', o_orderkey from orders where o_orderdate >= timestamp '2000-06-01' and o_orderstatus = 'O' union all select 'min_views', doc_id from documents where n_chars >= 10000""")
def active_recent_lists(t):
    recent = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select(F.lit("recent").alias("list"), col("o_orderkey").alias("id"))
    after = t.orders.where((col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz")) & (col("o_orderstatus") == "O")).select(F.lit("published_after").alias("list"), col("o_orderkey").alias("id"))
    viewed = t.documents.where("n_chars >= 10000").select(F.lit("min_views").alias("list"), col("doc_id").alias("id"))
    return recent.unionByName(after).unionByName(viewed)


@query("b65_by_code_and_active", """select 'by_code' as list, c_custkey as id from customer where lower(c_name) in ('customer#000000001', 'customer#000000002') union all
  select 'active', o_orderkey from orders where o_orderstatus = 'O' and o_orderdate <= timestamp '2000-06-30'""")
def by_code_and_active(t):
    codes = t.customer.where(F.lower("c_name").isin("customer#000000001", "customer#000000002")).select(F.lit("by_code").alias("list"), col("c_custkey").alias("id"))
    active = t.orders.where((col("o_orderstatus") == "O") & (col("o_orderdate") <= F.lit("2000-06-30").cast("timestamp_ntz")))
    return codes.unionByName(active.select(F.lit("active").alias("list"), col("o_orderkey").alias("id")))


@query("b66_counts_by", """select 'status' as dimension, o_orderstatus as value, count(*) as n from orders group by o_orderstatus union all select 'priority', o_orderpriority, count(*) from orders group by o_orderpriority
  union all select 'year', cast(year(o_orderdate) as varchar), count(*) from orders group by all""")
def counts_by(t):
    # one pass for all dimensions
    rows = t.orders.select(col("o_orderstatus").alias("status"), col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("string").alias("year"))
    sets = rows.groupingSets([["status"], ["priority"], ["year"]], "status", "priority", "year").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(col("g") == 3, "status").when(col("g") == 5, "priority").otherwise("year")
    return sets.select(dimension.alias("dimension"), F.coalesce("status", "priority", "year").alias("value"), "n")


@query("b67_top_per_group", """select p_brand, l_partkey, n from (select p_brand, l_partkey, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, l_partkey) as rn from lineitem join part on p_partkey = l_partkey group by p_brand, l_partkey) where rn <= 3""")
def top_per_group(t):
    counts = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    ranked = counts.join(t.part, col("p_partkey") == col("l_partkey"))
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "l_partkey"))
    return ranked.withColumn("rn", rank).where("rn <= 3").select("p_brand", "l_partkey", "n")


_RATES = """select {k}, count(*) as total, count(*) filter (where event_type = 'purchase') as conversion_count, count(*) filter (where event_type = 'error') as error_count,
  cast(count(*) filter (where event_type = 'purchase') as double) * 100.0 / count(*) as conversion_rate, cast(count(*) filter (where event_type = 'error') as double) * 100.0 / count(*) as error_rate from events group by {k}"""


@query("b68_rates", _RATES.format(k="user_id"))
def rates(t):
    kind = col("event_type")
    return commerce.rates(t.events, ["user_id"], {"conversion": kind == "purchase", "error": kind == "error"})


@query("b69_month_over_month", """with c as (select cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, count(*) as n from orders group by all)
  select c.year, c.month, c.n, p.n as previous, c.n - p.n as change, case when p.n > 0 then cast(c.n - p.n as double) * 100.0 / p.n end as change_pct from c left join c p on p.year * 12 + p.month = c.year * 12 + c.month - 1""")
def month_over_month(t):
    return commerce.month_over_month(t.orders, "o_orderdate")


@query("b70_redemption_trend", f"""select strftime(d, '%Y-%m-%d') as day, count(event_id) as orders, coalesce(sum({CENTS.format('value')}), 0) / 100 as revenue from (select unnest(generate_series(timestamp '2024-01-30' - interval 44 days, timestamp '2024-01-30', interval 1 day)) as d)
  left join (select * from events where event_type = 'purchase') on date_trunc('day', ts) = d group by d""")
def redemption_trend(t):
    return commerce.daily_trend(t.events.where("event_type = 'purchase'"), "ts", col("value"), "2024-01-30", 45)


@query("b71_wait_times", """select date_trunc('month', o_orderdate) as month, count(*) as n, min(w) as shortest_days, max(w) as longest_days, cast(sum(w) as double) / count(*) as average_days
  from (select o_orderdate, date_diff('day', o_orderdate, l_shipdate) as w from lineitem join orders on o_orderkey = l_orderkey) where w >= 0 group by month""")
def wait_times(t):
    wait = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("bigint")
    both = t.lineitem.join(t.orders, col("l_orderkey") == col("o_orderkey")).withColumn("w", wait).where("w >= 0")
    # month of a timestamp without zone
    month = F.trunc("o_orderdate", "month").cast("timestamp_ntz")
    return both.groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.min("w").alias("shortest_days"), F.max("w").alias("longest_days"),
                                                  (F.sum("w") / F.count("*")).alias("average_days"))


@query("b71_current_waits", """select o_orderpriority as queue, count(*) as waiting, max(w) as longest_days, cast(sum(w) as double) / count(*) as average_days
  from (select o_orderpriority, date_diff('day', o_orderdate, timestamp '2001-01-01') as w from orders where o_orderstatus = 'O') group by o_orderpriority""")
def current_waits(t):
    # open entries wait until now
    wait = F.date_diff(F.lit("2001-01-01").cast("date"), F.to_date("o_orderdate")).cast("bigint")
    waits = t.orders.where("o_orderstatus = 'O'").select(col("o_orderpriority").alias("queue"), wait.alias("w"))
    return waits.groupBy("queue").agg(F.count("*").alias("waiting"), F.max("w").alias("longest_days"), (F.sum("w") / F.count("*")).alias("average_days"))


@query("b72_page_stats", """select source, count(*) as jobs, cast(sum(p) as bigint) as pages, cast(sum(p) as double) / count(*) as pages_per_job, cast(sum(n_chars) as double) / count(*) as average_size
  from (select source, n_chars, (n_chars + 2999) // 3000 as p from documents) group by source""")
def page_stats(t):
    pages = F.floor((col("n_chars") + 2999) / 3000).cast("bigint")
    return t.documents.select("source", "n_chars", pages.alias("p")).groupBy("source").agg(
        F.count("*").alias("jobs"), F.sum("p").alias("pages"), (F.sum("p") / F.count("*")).alias("pages_per_job"), (F.sum("n_chars") / F.count("*")).alias("average_size"))


_JOBS = """select {k} as hour, count(*) as total, count(*) filter (where s = 'success') as success, count(*) filter (where s = 'failed') as failed, count(*) filter (where s = 'warning') as warning, min(d) as duration_min, max(d) as duration_max,
  cast(count(*) filter (where s = 'success') as double) * 100.0 / count(*) as success_rate, cast(sum(d) as double) / count(*) as duration_avg
  from (select strftime(ts, '%Y-%m-%d %H') as h, case event_type when 'error' then 'failed' when 'signup' then 'warning' else 'success' end as s, cast(floor(value * 100) as bigint) as d from events) group by h"""


@query("b72_job_stats", _JOBS.format(k="h"))
def job_stats(t):
    kind = col("event_type")
    jobs = t.events.select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"),
                           F.when(kind == "error", "failed").when(kind == "signup", "warning").otherwise("success").alias("status"),
                           F.floor(col("value") * 100).cast("bigint").alias("duration"))
    return commerce.job_stats(jobs, ["hour"], "status", "duration")


@query("b73_category_tree", """with recursive nodes as (select 'r' || r_regionkey as id, null as parent_id, r_name as name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation
    union all select 's' || s_suppkey, 'n' || s_nationkey, s_name from supplier union all select 'c' || c_custkey, 'n' || c_nationkey, c_name from customer),
  tree as (select id, 0 as depth, cast(name as varchar) as path from nodes where parent_id is null union all select n.id, tr.depth + 1, tr.path || ' / ' || n.name from nodes n join tree tr on n.parent_id = tr.id)
  select id, depth, path from tree""")
def category_tree(t):
    def nodes(df, prefix, key, parent_prefix, parent, name):
        parent_id = F.concat(F.lit(parent_prefix), col(parent).cast("string")) if parent else F.lit(None).cast("string")
        return df.select(F.concat(F.lit(prefix), col(key).cast("string")).alias("id"), parent_id.alias("parent_id"), col(name).alias("name"))

    rows = (nodes(t.region, "r", "r_regionkey", "", None, "r_name").unionByName(nodes(t.nation, "n", "n_nationkey", "r", "n_regionkey", "n_name"))
            .unionByName(nodes(t.supplier, "s", "s_suppkey", "n", "s_nationkey", "s_name")).unionByName(nodes(t.customer, "c", "c_custkey", "n", "c_nationkey", "c_name")))
    return commerce.category_tree(rows)


@query("b74_shipping_rate", """with bands as (select r_regionkey as zone, k * 7 as low, (k + 1) * 7 as high, (r_regionkey + 1) * 100 + k * 25 as rate from region, range(0, 8) r(k))
  select l_orderkey, l_linenumber, l_partkey, l_quantity, n_regionkey as zone, cast(rate as bigint) as rate from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join bands on zone = n_regionkey and l_quantity >= low and l_quantity < high""")
def shipping_rate(t):
    k = F.explode(F.sequence(F.lit(0), F.lit(7)))
    bands = t.region.select(col("r_regionkey").alias("zone"), k.alias("k")).select(
        "zone", (col("k") * 7).alias("low"), ((col("k") + 1) * 7).alias("high"), ((col("zone") + 1) * 100 + col("k") * 25).cast("bigint").alias("rate"))
    zones = t.supplier.join(t.nation, col("s_nationkey") == col("n_nationkey")).select(col("s_suppkey").alias("l_suppkey"), col("n_regionkey").alias("zone"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey").join(zones, "l_suppkey").drop("l_suppkey")
    return relations.range_lookup(rows, "l_quantity", bands, "low", "high", "zone", 10).drop("low", "high")


@query("b75_balances", f"select c_mktsegment, sum({CENTS.format('c_acctbal')}) / 100 as balance, sum({CENTS.format('c_acctbal')}) filter (where c_acctbal > 0) / 100 as credit from customer group by c_mktsegment")
def balances(t):
    c = commerce.cents(col("c_acctbal"))
    return t.customer.groupBy("c_mktsegment").agg((F.sum(c) / 100).alias("balance"), (F.sum(F.when(col("c_acctbal") > 0, c)) / 100).alias("credit"))


@query("b76_between_dates", "select o_orderstatus, o_orderkey from orders where o_orderdate between timestamp '1999-03-01' and timestamp '1999-03-31'")
def between_dates(t):
    a, b = (F.lit(d).cast("timestamp_ntz") for d in ("1999-03-01", "1999-03-31"))
    return t.orders.where(col("o_orderdate").between(a, b)).select("o_orderstatus", "o_orderkey")


# -- query log ------------------------------------------------------------------

_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, '''(?:[^'']|'''')*''', '?', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', '?', 'g'), '\(\s*\?(?:\s*,\s*\?)+\s*\)', '(?)', 'g'), '\s+', ' ', 'g'))"""
_QL = f"""ql as (select *, {_NORM} as normalized_query, upper(regexp_extract(query, '^\\s*([A-Za-z]+)', 1)) as type,
  case when error is not null then 'failed' when duration > 100 then 'slow' else 'completed' end as status from query_logs)"""
_QSTATS = "count(*) as total, count(*) filter (where status = 'slow') as slow, count(*) filter (where status = 'failed') as failed, sum(duration) / count(*) as avg_ms, max(duration) as max_ms"


def _logs(t):
    return querylog.enrich(t.heavy.query_logs())


@query("b50_normalize_query", f"with {_QL} select id, normalized_query, type from ql")
def normalize_query(t):
    return _logs(t).select("id", "normalized_query", "type")


@query("b51_query_status", f"with {_QL} select id, status from ql")
def query_status(t):
    return _logs(t).select("id", "status")


@query("b52_query_stats", f"with {_QL} select type, connection, {_QSTATS} from ql group by type, connection")
def query_stats(t):
    return querylog.stats(_logs(t), "type", "connection")


@query("b52_duration_quantiles", f"with {_QL} select type, quantile_disc(duration, 0.5) as p50, quantile_disc(duration, 0.95) as p95 from ql group by type")
def duration_quantiles(t):
    q = querylog.duration_quantiles(_logs(t), [0.5, 0.95], "type")
    return q.select("type", col("quantiles_ms")[0].alias("p50"), col("quantiles_ms")[1].alias("p95"))


@query("b53_recent_queries", f"with {_QL} select id, executed_at, duration from ql where executed_at >= '1999-01-01 00:00:00' and connection = 'primary' and status = 'completed' and type = 'SELECT' and query ilike '%flag = ''N%' order by executed_at desc, id desc limit 50")
def recent_queries(t):
    return querylog.recent(_logs(t), 50, since="1999-01-01 00:00:00", connection="primary", wanted_status="completed", kind="SELECT", search="flag = 'N").select("id", "executed_at", "duration")


@query("b53_slow_queries", f"with {_QL} select id, executed_at, duration from ql where status = 'slow' order by duration desc, executed_at desc, id desc limit 50")
def slow_queries(t):
    return querylog.recent(_logs(t), 50, wanted_status="slow", slowest=True).select("id", "executed_at", "duration")


@query("b54_query_timeline", f"with {_QL} select substring(executed_at, 1, 10) as bucket, {_QSTATS} from ql group by bucket")
def query_timeline(t):
    return querylog.timeline(_logs(t), "day")


@query("b55_frequent_queries", f"with {_QL} select normalized_query, count(*) as times, sum(duration) / count(*) as avg_ms from ql group by normalized_query order by times desc, normalized_query limit 10")
def frequent_queries(t):
    return querylog.frequent(_logs(t))


@query("b56_prune", "select id, executed_at from query_logs where executed_at >= '1999-12-25 00:00:00' and not regexp_matches(query, '^UPDATE .* WHERE id IN \\(1[0-9]+,')")
def prune(t):
    return querylog.prune(t.query_logs(), "2000-01-01", 7, [r"^UPDATE .* WHERE id IN \(1[0-9]+,"]).select("id", "executed_at")


@query("b57_repeated_queries", f"with {_QL} select transaction_id, normalized_query, count(*) as times from ql group by transaction_id, normalized_query having count(*) > 3")
def repeated_queries(t):
    return querylog.repeated_queries(_logs(t), 3)


# -- data quality ---------------------------------------------------------------

def _errors(validated, *keys):
    return validated.select(*keys, F.array_join("errors", ",").alias("errors"), "valid")


def _rules_sql(rules):
    parts = ", ".join(f"case when not coalesce({test}, false) then '{name}' end" for name, test in rules)
    return f"concat_ws(',', {parts}) as errors, concat_ws(',', {parts}) = '' as valid"


@query("b80_string_rules", "select c_custkey, " + _rules_sql([
    ("min", "length(c_name) >= 10"), ("max", "length(c_mktsegment) <= 9"), ("length", "length(c_name) = 18"),
    ("email", r"regexp_matches(c_name || '@' || c_mktsegment, '^[^\s@]+@[^\s@]+\.[^\s@]+$')"), ("alphanumeric", "regexp_matches(c_mktsegment, '^[A-Za-z0-9]+$')")]) + " from customer")
def string_rules(t):
    name, seg = col("c_name"), col("c_mktsegment")
    return _errors(quality.validate(t.customer, [
        ("min", quality.min_length(name, 10)), ("max", quality.max_length(seg, 9)), ("length", quality.exact_length(name, 18)),
        ("email", quality.email(F.concat(name, F.lit("@"), seg))), ("alphanumeric", quality.alphanumeric(seg))]), "c_custkey")


@query("b81_number_rules", "select p_partkey, " + _rules_sql([
    ("min", "p_size >= 5"), ("max", "p_retailprice <= 1500"), ("integer", "p_retailprice = floor(p_retailprice)"), ("positive", "p_retailprice > 0"),
    ("decimals", "length(regexp_extract(regexp_replace(cast(p_retailprice as varchar), '\\.0$', ''), '\\.(\\d+)$', 1)) between 0 and 1"), ("divisible", "p_size % 3 = 0")]) + " from part")
def number_rules(t):
    size, price = col("p_size"), col("p_retailprice")
    return _errors(quality.validate(t.part, [
        ("min", size >= 5), ("max", price <= 1500), ("integer", quality.integer(price)), ("positive", quality.positive(price)),
        ("decimals", quality.decimal_digits(price, 0, 1)), ("divisible", quality.divisible_by(size, 3))]), "p_partkey")


@query("b82_array_rules", "select conv_id, turn, " + _rules_sql([
    ("min", "len(w) >= 5"), ("max", "len(w) <= 40"), ("each", "len(list_filter(w, lambda x: length(x) > 20)) = 0"), ("unique", "len(list_distinct(w)) = len(w)")])
    + " from (select conv_id, turn, string_split(text, ' ') as w from conversations)")
def array_rules(t):
    words = F.split("text", " ", -1)
    rows = t.conversations.select("conv_id", "turn", words.alias("w"))
    return _errors(quality.validate(rows, [
        ("min", F.size("w") >= 5), ("max", F.size("w") <= 40), ("each", quality.each(col("w"), lambda x: F.length(x) <= 20)),
        ("unique", quality.unique_items(col("w")))]), "conv_id", "turn")


@query("b83_boolean_enum_rules", "select doc_id, " + _rules_sql([("boolean", "quality in (0, 1)"), ("enum", "toxic in (0)")]) + " from labels")
def boolean_enum_rules(t):
    return _errors(quality.validate(t.labels, [("boolean", col("quality").isin(0, 1)), ("enum", col("toxic").isin(0))]), "doc_id")


@query("b84_date_rules", "select o_orderkey, " + _rules_sql([
    ("min", "o_orderdate >= timestamp '1996-01-01'"), ("before", "o_orderdate < timestamp '2000-01-01'"), ("weekday", "dayofweek(o_orderdate) not in (0, 6)"),
    ("between", "o_orderdate between timestamp '1995-06-01' and timestamp '2000-06-01'"), ("unix", "cast(floor(epoch(o_orderdate)) as bigint) between 0 and 2147483647")]) + " from orders")
def date_rules(t):
    d = col("o_orderdate")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return _errors(quality.validate(t.orders, [
        ("min", d >= day("1996-01-01")), ("before", d < day("2000-01-01")), ("weekday", quality.weekday(d)),
        ("between", d.between(day("1995-06-01"), day("2000-06-01"))), ("unix", quality.unix_range(F.unix_seconds(d.cast("timestamp"))))]), "o_orderkey")


@query("b84_more_date_rules", "select o_orderkey, " + _rules_sql([
    ("max", "o_orderdate <= timestamp '1999-12-31'"), ("after", "o_orderdate > timestamp '1996-06-30'"), ("today", "cast(o_orderdate as date) = date '1998-03-02'"),
    ("weekend", "dayofweek(o_orderdate) in (0, 6)"), ("datetime", "year(o_orderdate) between 1000 and 9999"), ("digits", "cast(o_orderkey * 100000000 as varchar) similar to '[0-9]{10,13}'")]) + " from orders")
def more_date_rules(t):
    d = col("o_orderdate")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return _errors(quality.validate(t.orders, [
        ("max", d <= day("1999-12-31")), ("after", d > day("1996-06-30")), ("today", quality.today(d, day("1998-03-02"))), ("weekend", quality.weekend(d)),
        ("datetime", quality.datetime_range(d)), ("digits", quality.unix_digits(col("o_orderkey") * 100000000))]), "o_orderkey")


@query("b85_object_shape", "select event_id, " + _rules_sql([("object", "json_type(props) = 'OBJECT'"), ("k", "json_type(props, '$.k') in ('UBIGINT', 'BIGINT')"), ("custom", "cast(json_extract_string(props, '$.k') as integer) % 2 = 0")]) + " from events")
def object_shape(t):
    tree = F.try_parse_json("props")
    k = F.try_variant_get(tree, "$.k", "int")
    return _errors(quality.validate(t.events, [
        ("object", F.schema_of_variant(tree).startswith("OBJECT<")), ("k", F.schema_of_variant(F.try_variant_get(tree, "$.k", "variant")) == "BIGINT"),
        ("custom", k % 2 == 0)]), "event_id")


@query("b86_rule_counts", """select rule, count(*) as failures from (select unnest(list_filter([case when not (n_chars >= 100) then 'min' end, case when not (n_chars <= 5000) then 'max' end, case when not (lang in ('en','fr')) then 'lang' end], lambda x: x is not null)) as rule from documents) group by rule""")
def rule_counts(t):
    return quality.rule_counts(quality.validate(t.documents, [
        ("min", col("n_chars") >= 100), ("max", quality.optional(col("n_chars"), col("n_chars") <= 5000)), ("lang", col("lang").isin("en", "fr"))]))


@query("b86_valid_quarantine", """select case when n_chars >= 100 and lang in ('en','fr') then 'valid' else 'quarantine' end as side, count(*) as n from documents group by side""")
def valid_quarantine(t):
    good, bad = quality.split(quality.validate(t.documents, [("min", col("n_chars") >= 100), ("lang", col("lang").isin("en", "fr"))]))
    return good.agg(F.count("*").alias("n")).select(F.lit("valid").alias("side"), "n").unionByName(
        bad.agg(F.count("*").alias("n")).select(F.lit("quarantine").alias("side"), "n"))


@query("b87_unique_key", "select project_id, lower(email) as email, count(*) as rows from (select project_id, email from project_members union all select project_id, email from project_invites) group by all having count(*) > 1 union all select 'line', l_orderkey || '-' || l_linenumber, count(*) from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def unique_key(t):
    people = t.project_members().select("project_id", "email").unionByName(t.project_invites().select("project_id", "email"))
    twice = quality.duplicates(people, [col("project_id"), F.lower("email")], ["project_id", "email"])
    lines = quality.duplicates(t.lineitem, [F.lit("line"), F.concat_ws("-", col("l_orderkey").cast("string"), col("l_linenumber").cast("string"))], ["project_id", "email"])
    return twice.unionByName(lines)


@query("b87_model_constraints", "select id, " + _rules_sql([
    ("project_id required", "project_id <> ''"), ("message required", "message <> ''"), ("trace_id required", "trace_id <> ''"),
    ("message max", "message is null or length(message) <= 40"), ("request_id max", "request_id is null or length(request_id) <= 7")]) + " from log_entries")
def model_constraints(t):
    # short limits, so that the rules bite on this data
    rules = quality.model_rules(["project_id", "message", "trace_id"], {"message": 40, "request_id": 7})
    return _errors(quality.validate(t.log_entries(), rules), "id")


@query("b87_foreign_key", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey is not null and l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def foreign_key(t):
    parents = t.orders.where("o_orderstatus <> 'P'")
    return quality.orphans(t.lineitem, parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


# -- delivery -------------------------------------------------------------------

@query("b90_pack_batches", """with s as (select source, doc_id, octet_length(encode(text)) as bytes, octet_length(encode(text)) <= 65536 as fits from documents),
  c as (select *, cast(floor(coalesce(sum(bytes + 1) over (partition by source, fits order by doc_id rows between unbounded preceding and 1 preceding), 0) / 65536) as bigint) as chunk from s),
  r as (select *, (row_number() over (partition by source, fits, chunk order by doc_id) - 1) // 20 as slice from c)
  select doc_id, case when fits then source || '-' || chunk || '-' || slice end as batch, cast(bytes as integer) as bytes from r""")
def pack_batches(t):
    return delivery.pack_batches(t.documents.select("source", "doc_id", "text"), "source", "doc_id", col("text"), max_entries=20, max_bytes=65536).select("doc_id", "batch", "bytes")


@query("b92_dead_letters", """select event_id, case when ts < timestamp '2024-01-24' then 'expired' when user_id % 5 >= 3 then 'discard' else 'retry' end as verdict from events where event_type = 'error'""")
def dead_letters(t):
    failed = t.events.where("event_type = 'error'").select("event_id", col("ts").alias("failed_at"), (col("user_id") % 5).alias("attempts"))
    return delivery.dead_letters(failed, F.lit("2024-01-31").cast("timestamp_ntz")).select("event_id", "verdict")


@query("b93_event_replay", """select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value, min(event_id) as first_at, max(event_id) as last_at, count(*) as events from events group by user_id""")
def event_replay(t):
    return delivery.replay(t.events, "user_id", ["event_id"], ["event_type", "value"])


_MAIL = "mail as (select user_id % 7 as campaign, 'User' || user_id || '@Example.com' as email, case event_type when 'click' then 'opened' when 'error' then 'bounced' when 'view' then 'sent' else 'delivered' end as kind from events)"


def _mail(t):
    k = col("event_type")
    return t.events.select((col("user_id") % 7).alias("campaign"), F.concat(F.lit("User"), col("user_id").cast("string"), F.lit("@Example.com")).alias("email"),
                           F.when(k == "click", "opened").when(k == "error", "bounced").when(k == "view", "sent").otherwise("delivered").alias("kind"))


@query("b94_delivery_metrics", f"""with {_MAIL} select campaign, count(*) as total, {', '.join(f"count(*) filter (where kind = '{k}') as {k}_count, cast(count(*) filter (where kind = '{k}') as double) * 100.0 / count(*) as {k}_rate" for k in ('delivered', 'bounced', 'opened'))} from mail group by campaign""")
def delivery_metrics(t):
    return delivery.delivery_metrics(_mail(t), ["campaign"], "kind")


@query("b94_bounced_addresses", f"with {_MAIL} select lower(email) as email, count(*) as bounces, 'bounce' as type from mail where kind = 'bounced' group by all")
def bounced_addresses(t):
    return delivery.bounced_addresses(_mail(t), "kind", "email")


@query("b95_array_helpers", """select conv_id, turn, cast(ceil(len(w) / 4.0) as integer) as chunks, array_to_string(w[5:8], ' ') as second_chunk, cast(len(list_distinct(w)) as integer) as distinct_words,
  cast(len(list_distinct(list_transform(w, lambda x: length(x)))) as integer) as lengths, cast(len(list_filter(w, lambda x: length(x) = 3)) as integer) as of_three from (select conv_id, turn, string_split(text, ' ') as w from conversations)""")
def array_helpers(t):
    w = col("w")
    grouped = delivery.group_array(w, F.length)
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ", -1).alias("w")).withColumn("chunked", delivery.chunk_array(w, 4)).withColumn("by_length", grouped)
    second = F.coalesce(F.array_join(F.try_element_at("chunked", F.lit(2)), " "), F.lit(""))
    return rows.select("conv_id", "turn", F.size("chunked").alias("chunks"), second.alias("second_chunk"), F.size(F.array_distinct(w)).alias("distinct_words"),
                       F.size("by_length").alias("lengths"), F.coalesce(F.size(F.try_element_at("by_length", F.lit(3))), F.lit(0)).alias("of_three"))


@query("b96_hit_rate", "select event_type, count(*) as total, count(*) filter (where value > 20) as hit_count, cast(count(*) filter (where value > 20) as double) * 100.0 / count(*) as hit_rate from events group by event_type")
def hit_rate(t):
    return delivery.hit_rate(t.events, ["event_type"], col("value") > 20)


@query("b96_job_statistics", "select status, count(*) as jobs, min(created_at) as oldest, max(created_at) as newest from fix_runs group by status")
def job_statistics(t):
    """Depth of every state of the work queue."""
    return t.fix_runs().groupBy("status").agg(F.count("*").alias("jobs"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
