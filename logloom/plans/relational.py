"""Documented query-builder surface on the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import changes, commerce, relations
from .registry import query

col = F.col


@query("b01_select_alias_distinct", "select distinct c_mktsegment as segment, c_nationkey as nation from customer")
def select_alias_distinct(t):
    return t.customer.select(col("c_mktsegment").alias("segment"), col("c_nationkey").alias("nation")).distinct()


@query("b02_where_and_or", "select o_orderkey, o_totalprice from orders where (o_orderstatus = 'F' and o_totalprice > 100000) or (o_orderpriority = '1-URGENT' and (o_totalprice >= 400000 or o_totalprice < 2000))")
def where_and_or(t):
    price = col("o_totalprice")
    return t.orders.where(((col("o_orderstatus") == "F") & (price > 100000)) | ((col("o_orderpriority") == "1-URGENT") & ((price >= 400000) | (price < 2000)))).select("o_orderkey", "o_totalprice")


@query("b03_where_in", "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('F','P') and o_orderpriority not in ('5-LOW','3-MEDIUM')")
def where_in(t):
    return t.orders.where(col("o_orderstatus").isin("F", "P") & ~col("o_orderpriority").isin("5-LOW", "3-MEDIUM")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("b04_where_null", "select id, trace_id is null as untraced from log_entries where request_id is not null and channel is null")
def where_null(t):
    return t.log_entries().where(col("request_id").isNotNull() & col("channel").isNull()).select("id", col("trace_id").isNull().alias("untraced"))


@query("b05_where_between", "select o_orderkey, o_totalprice from orders where o_totalprice between 50000 and 60000")
def where_between(t):
    return t.orders.where(col("o_totalprice").between(50000, 60000)).select("o_orderkey", "o_totalprice")


@query("b06_where_like", "select p_partkey, p_name from part where p_name like '%ring%' and p_brand like 'Brand#_'")
def where_like(t):
    return t.part.where(col("p_name").like("%ring%") & col("p_brand").like("Brand#_")).select("p_partkey", "p_name")


@query("b07_joins", """select 'inner' as kind, count(*) as n from orders join customer on c_custkey = o_custkey
  union all select 'left', count(*) from customer left join orders on c_custkey = o_custkey union all select 'right', count(*) from orders right join customer on c_custkey = o_custkey and o_orderstatus = 'P'""")
def joins(t):
    o, c = t.orders, t.customer
    on = col("c_custkey") == col("o_custkey")
    sides = {"inner": o.join(c, on), "left": c.join(o, on, "left"), "right": o.where("o_orderstatus = 'P'").join(c, on, "right")}
    out = None
    for kind, df in sides.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("b08_order_by", """select * from (select 'latest' as scope, o_orderkey from orders order by o_orderdate desc, o_totalprice, o_orderkey limit 20)
  union all select * from (select 'oldest', o_orderkey from orders order by o_orderdate, o_orderkey limit 20)""")
def order_by(t):
    latest = t.orders.orderBy(F.desc("o_orderdate"), "o_totalprice", "o_orderkey").limit(20).select(F.lit("latest").alias("scope"), "o_orderkey")
    return latest.unionByName(t.orders.orderBy("o_orderdate", "o_orderkey").limit(20).select(F.lit("oldest").alias("scope"), "o_orderkey"))


@query("b08_random_order")
def random_order(t):
    return t.orders.select("o_orderkey").orderBy(F.rand(7), "o_orderkey").limit(100)


@query("b09_group_aggregates", """select o_orderstatus, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents, min(o_totalprice) as lowest, max(o_totalprice) as highest,
  sum(cast(round(o_totalprice * 100) as bigint)) / count(*) as average_cents from orders group by o_orderstatus""")
def group_aggregates(t):
    c = F.sum(commerce.cents(col("o_totalprice")))
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), c.alias("cents"), F.min("o_totalprice").alias("lowest"),
                                                 F.max("o_totalprice").alias("highest"), (c / F.count("*")).alias("average_cents"))


@query("b10_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where(col("n") > 12)


@query("b11_take_skip", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def take_skip(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey")


@query("b12_paginate", """select 'row' as part, o_orderkey as a, cast(null as bigint) as total, cast(null as bigint) as last_page from (select o_orderkey from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 15 offset 30)
  union all select 'info', 3, count(*), greatest(1, cast(ceil(count(*) / 15.0) as bigint)) from orders where o_orderstatus = 'F'""")
def paginate(t):
    rows, info = relations.paginate(t.orders.where("o_orderstatus = 'F'"), [col("o_orderdate"), col("o_orderkey")], 3, 15)
    return rows.select(F.lit("row").alias("part"), col("o_orderkey").alias("a")).unionByName(
        info.select(F.lit("info").alias("part"), col("current_page").alias("a"), "total", "last_page"), allowMissingColumns=True)


@query("b13_chunked_processing", "select count(*) as rows, cast(sum(length(text)) as bigint) as chars from documents")
def chunked_processing(t):
    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = pa.compute.sum(pa.compute.utf8_length(batch.column(0))).as_py() or 0
        return pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "chars": pa.array([total], pa.int64())})

    chunks = relations.map_chunks(t.documents.select("text"), sizes, "rows bigint, chars bigint")
    return chunks.agg(F.sum("rows").alias("rows"), F.sum("chars").alias("chars"))


@query("b14_insert_or_ignore", """select n_nationkey as id, n_name as name from nation union all
  select s.id, arg_min(s.name, s.seq) from (select s_nationkey + cast(s_suppkey % 3 as integer) * 10 as id, s_name as name, s_suppkey as seq from supplier) s
  where s.id not in (select n_nationkey from nation) group by s.id""")
def insert_or_ignore(t):
    rows = t.supplier.select((col("s_nationkey") + (col("s_suppkey") % 3).cast("int") * 10).alias("id"), col("s_name").alias("name"), col("s_suppkey").alias("seq"))
    return changes.insert_or_ignore(t.nation.select(col("n_nationkey").alias("id"), col("n_name").alias("name")), rows, ["id"], ["seq"])


@query("b15_update_increment_delete", "select p_partkey, p_size + case when p_type = 'ECONOMY' then 1 else 0 end as p_size, case when p_brand = 'Brand#1' then 'retired' else p_brand end as p_brand from part where p_name <> 'small ring'")
def update_increment_delete(t):
    return t.part.where(col("p_name") != "small ring").select(
        "p_partkey", (col("p_size") + F.when(col("p_type") == "ECONOMY", 1).otherwise(0)).alias("p_size"),
        F.when(col("p_brand") == "Brand#1", "retired").otherwise(col("p_brand")).alias("p_brand"))


@query("b16_raw_expression", "select o_orderkey, concat(o_orderstatus, '-', o_orderpriority) as tag, cast(year(o_orderdate) as integer) as y from orders")
def raw_expression(t):
    return t.orders.select("o_orderkey", F.expr("concat(o_orderstatus, '-', o_orderpriority)").alias("tag"), F.expr("year(o_orderdate)").alias("y"))


@query("b16_raw_sql_with_arguments", "select o_orderstatus, count(*) as n from orders where o_totalprice > 250000 group by o_orderstatus")
def raw_sql_with_arguments(t):
    return t.spark.sql("select o_orderstatus, count(*) as n from {o} where o_totalprice > :floor group by o_orderstatus", args={"floor": 250000}, o=t.orders)


@query("b17_find_first", "select 'find' as how, c_custkey, c_name from customer where c_custkey = 77 union all select * from (select 'first', c_custkey, c_name from customer order by c_name desc limit 1)")
def find_first(t):
    one = t.customer.where(col("c_custkey") == 77).limit(1).select(F.lit("find").alias("how"), "c_custkey", "c_name")
    return one.unionByName(t.customer.orderBy(F.desc("c_name")).limit(1).select(F.lit("first").alias("how"), "c_custkey", "c_name"))


@query("b18_has_relations", """select 'whereHas' as scope, count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)
  union all select 'doesntHave', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
def has_relations(t):
    c = t.customer.withColumnRenamed("c_custkey", "k")
    o = t.orders.withColumnRenamed("o_custkey", "k")
    big = relations.where_has(c, o.where("o_totalprice > 450000"), ["k"]).agg(F.count("*").alias("n")).select(F.lit("whereHas").alias("scope"), "n")
    return big.unionByName(relations.where_missing(c, o, ["k"]).agg(F.count("*").alias("n")).select(F.lit("doesntHave").alias("scope"), "n"))


@query("b19_eager_loading", """select c_custkey, c_name, row_number() over (partition by c_custkey order by o_orderkey) - 1 + case when o_orderkey is null then null else 0 end as position, o_orderkey, o_orderstatus
  from customer left join orders on o_custkey = c_custkey and o_orderpriority <> '5-LOW'""")
def eager_loading(t):
    c = t.customer.select(col("c_custkey").alias("k"), "c_name")
    o = t.orders.where("o_orderpriority <> '5-LOW'").select(col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    loaded = relations.with_related(c, o, "k", ["o_orderkey"])
    return loaded.select(col("k").alias("c_custkey"), "c_name", "position", "o_orderkey", "o_orderstatus")


@query("b20_relation_through", """select n_name, count(distinct o_orderkey) as orders, count(distinct l_partkey) as parts from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by n_name""")
def relation_through(t):
    return (t.lineitem.join(t.orders, col("l_orderkey") == col("o_orderkey")).join(t.customer, col("o_custkey") == col("c_custkey"))
            .join(t.nation, col("c_nationkey") == col("n_nationkey")).groupBy("n_name")
            .agg(F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts")))


@query("b20_morph_relation", """select event_id, event_type, case event_type when 'purchase' then (select c_name from customer where c_custkey = user_id) when 'click' then (select p_name || ' ' || p_partkey from part where p_partkey = user_id) end as label
  from events where event_type in ('purchase', 'click')""")
def morph_relation(t):
    targets = {"purchase": t.customer.select(col("c_custkey").alias("id"), col("c_name").alias("label")),
               "click": t.part.select(col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", col("p_partkey").cast("string")).alias("label"))}
    return relations.morph(targets, t.events.select("event_id", "event_type", "user_id"), "event_type", "user_id").drop("user_id")


@query("b21_soft_deletes", """select scope, count(*) as n from (select 'without' as scope from customer where c_acctbal >= 0 union all select 'only' from customer where c_acctbal < 0 union all select 'with' from customer) group by scope""")
def soft_deletes(t):
    rows = t.customer.withColumn("deleted_at", F.when(col("c_acctbal") < 0, F.lit("2024-01-01")))
    out = None
    for scope in ("without", "with", "only"):
        part = relations.alive(rows, trashed=scope).agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("b22_scopes", "select c_mktsegment, count(*) as n from customer where c_acctbal > 5000 and c_nationkey < 10 group by c_mktsegment")
def scopes(t):
    def rich(df):
        return df.where(col("c_acctbal") > 5000)

    def nations(limit):
        return lambda df: df.where(col("c_nationkey") < limit) if limit else df

    return t.customer.transform(rich).transform(nations(10)).transform(nations(None)).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("b23_distinct_on", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn = 1")
def distinct_on(t):
    return relations.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), col("o_orderkey")])


@query("b23_json_contains", "select event_id from events where cast(json_extract_string(props, '$.k') as integer) = 42")
def json_contains(t):
    return t.events.where(F.try_variant_get(F.try_parse_json("props"), "$.k", "int") == 42).select("event_id")


@query("b24_daily_revenue", """select strftime(d, '%Y-%m-%d') as day, sum(c) / 100 as revenue from (select date_trunc('day', o_orderdate) as d, cast(round(o_totalprice * 100) as bigint) as c from orders
  where o_orderstatus = 'F' and o_orderdate >= (select max(o_orderdate) from orders) - interval 30 days) group by d""")
def daily_revenue(t):
    latest = t.orders.agg(F.max("o_orderdate")).scalar()
    recent = t.orders.where((col("o_orderstatus") == "F") & (col("o_orderdate") >= latest - F.expr("interval 30 days")))
    return recent.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(commerce.cents(col("o_totalprice"))).alias("c")).select(
        F.date_format("d", "yyyy-MM-dd").alias("day"), (col("c") / 100).alias("revenue"))


_AFF = """select user_id, clicks, conversions, c / 100 as earnings, case when clicks = 0 then 0.0 else cast(conversions as double) * 100.0 / clicks end as conversion_rate,
  case when conversions = 0 then 0.0 else cast(c as double) * 0.01 / conversions end as average_commission from (select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'purchase') as conversions,
  coalesce(sum(cast(round(value * 100) as bigint)) filter (where event_type = 'purchase'), 0) as c from events where ts >= timestamp '2024-01-01' group by user_id)"""


@query("b25_affiliate_stats", _AFF)
def affiliate_stats(t):
    kind = col("event_type")
    recent = t.events.where(col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz"))
    return commerce.affiliate_stats(recent, "user_id", kind == "click", kind == "purchase", col("value"))


@query("b23_json_array_contains", "select event_id, json_contains(cast('[' || cast(json_extract(props, '$.k') as varchar) || ',' || user_id || ',\"x\"]' as json), '7') as has_seven from events")
def json_array_contains(t):
    text = F.format_string('[%s,%d,"x"]', F.get_json_object("props", "$.k"), col("user_id"))
    return t.events.select("event_id", relations.json_contains(text, 7).alias("has_seven"))


@query("b24_keys_in_both", "select l_orderkey as k from lineitem where l_quantity > 45 intersect select o_orderkey from orders where o_orderstatus = 'O'")
def keys_in_both(t):
    return relations.in_both(t.lineitem.where("l_quantity > 45").select(col("l_orderkey").alias("k")), t.orders.where("o_orderstatus = 'O'").select(col("o_orderkey").alias("k")), ["k"])


@query("b24_keys_left_over", "select l_orderkey as k from lineitem except all select o_orderkey from orders")
def keys_left_over(t):
    return relations.without(t.lineitem.select(col("l_orderkey").alias("k")), t.orders.select(col("o_orderkey").alias("k")), ["k"])
