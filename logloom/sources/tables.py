"""The given tables, and the log, control and statistics views derived from them.

Every view is a projection (plus, where said, one grouping) over a whole table, so
column pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint_of
from ..session import configure

AS_OF = "2024-01-31T00:00:00.000Z"


def spread(table: DataFrame) -> DataFrame:
    """Use all cores on a table stored in fewer splits than there are cores; else unchanged.

    For scans that feed expensive expressions. Filters and column pruning pass through.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


class Tables:
    def __init__(self, spark: SparkSession, directory: str, spread_scans: bool = False):
        self.spark = configure(spark)
        self.directory = directory.rstrip("/")
        self.spread_scans = spread_scans

    @property
    def heavy(self) -> Tables:
        """The same views for CPU-bound queries."""
        return Tables(self.spark, self.directory, spread_scans=True)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return spread(table) if self.spread_scans else table

    # -- the log ---------------------------------------------------------------

    def log_entries(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        uid, eid, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
        text = lambda c: c.cast("string")
        fmt = F.format_string
        level = (
            F.when(kind == "error", F.element_at(
                F.lit(["error", "critical", "alert", "emergency"]), (eid % 4 + 1).cast("int")))
            .when(kind == "purchase", "warning").when(kind == "signup", "notice")
            .when(kind == "click", "info").otherwise("debug"))
        message = (
            F.when(kind == "error", fmt("charge for sub_%d declined after %d retries", eid + 10000, k))
            .when(kind == "purchase", fmt("order %d paid by User%d@Example.com", eid, uid))
            .when(kind == "signup", fmt("timeout connecting to 10.0.%d.%d:5432", uid % 256, k))
            .when(kind == "click", fmt("GET /api/orders/%d took %dms", eid, k))
            .otherwise("cache warm"))
        channel = F.when(uid % 4 == 0, "billing").when(uid % 4 == 1, "queue").when(uid % 4 == 2, "http")
        return self.events.select(
            F.concat(F.lit("e"), text(eid)).alias("id"),
            F.concat(F.lit("proj-"), text(uid % 5)).alias("project_id"),
            level.alias("level"),
            message.alias("message"),
            channel.alias("channel"),
            F.when(uid % 10 == 0, "staging").otherwise("production").alias("environment"),
            F.concat(F.lit("app@2."), text(F.floor((F.day("ts") - 1) / 7).cast("int"))).alias("release"),
            F.lit(None).cast("string").alias("framework"),
            F.concat(F.lit("host-"), text(uid % 3)).alias("host"),
            F.lit(None).cast("string").alias("sdk"),
            F.col("props").alias("context"),
            F.concat(F.lit('{"id":'), text(uid), F.lit("}")).alias("user_context"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
            F.when(eid % 3 == 0, F.md5(F.concat(text(uid), F.lit("/"), text(F.day("ts"))))).alias("trace_id"),
            F.when(eid % 5 == 0, F.concat(F.lit("req-"), text(F.floor(eid / 10).cast("bigint")))).alias("request_id"),
        )

    def raw_requests(self) -> DataFrame:
        """Hostile mixed batches from ``events`` (four entries each) and one bare entry per document."""
        eid, uid = F.col("event_id"), F.col("user_id")
        fmt = F.format_string
        element = (
            F.when(eid % 7 == 0, "null").when(eid % 7 == 1, "{}").when(eid % 7 == 2, "5")
            .when(eid % 7 == 3, fmt('{"message":"m%d","level":"ERROR","traceId":"t%d"}', eid, uid))
            .when(eid % 7 == 4, fmt('{"message":%d,"level":"error","user":{"id":%d}}', eid, uid))
            .otherwise(fmt('{"message":"m%d","level":"warning","context":{"k":1,"user":{"id":%d}}}', eid, uid)))
        batches = (
            self.events.select(F.floor(eid / 4).cast("bigint").alias("b"), eid, uid, element.alias("e"),
                               F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("received_at"))
            # four rows a group by construction of the key
            .groupBy("b").agg(
                F.array_sort(F.collect_list(F.struct("event_id", "e"))).alias("es"),
                F.min("received_at").alias("received_at"), F.min("user_id").alias("uid"))
            .select(
                F.concat(F.lit("b"), F.col("b").cast("string")).alias("request_id"),
                F.concat(F.lit('{"logs":['), F.array_join(F.transform("es", lambda x: x.e), ","), F.lit("]}")).alias("body"),
                F.concat(F.lit("proj-"), ((F.col("uid") % 6)).cast("string")).alias("header_project"),
                F.col("uid").alias("n"), "received_at"))
        single = self.documents.select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"),
            F.to_json(F.struct(
                F.col("text").alias("message"), F.col("source").alias("channel"),
                F.struct(F.col("lang"), F.col("n_chars")).alias("context"),
                F.lit("2024-01-15T08:00:00.000Z").alias("timestamp"),
            )).alias("body"),
            F.lit(None).cast("string").alias("header_project"),
            F.col("doc_id").alias("n"),
            F.lit("2024-01-15T08:00:01.000Z").alias("received_at"))
        both = batches.unionByName(single)
        cores = self.spark.sparkContext.defaultParallelism
        if self.spread_scans and Tables(self.spark, self.directory).documents.rdd.getNumPartitions() < cores:
            # a small input, whose grouping leaves few partitions behind
            both = both.repartition(cores)
        project = F.coalesce(F.col("header_project"), F.concat(F.lit("proj-"), (F.col("n") % 5).cast("string")))
        names = F.lit(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
        number = F.substring(project, 6, 1).cast("int")
        good = F.concat(F.lit("key_"), F.md5(F.try_element_at(names, number + 1)))
        return both.select(
            "request_id", "body", "header_project",
            F.when(F.col("n") % 11 == 0, F.lit(None)).when(F.col("n") % 11 == 1, "key_wrong").otherwise(good).alias("header_key"),
            F.concat(F.lit("203.0.113."), (F.col("n") % 50).cast("string"), F.lit(", 10.0.0."), (F.col("n") % 9).cast("string")).alias("forwarded_for"),
            F.lit("192.0.2.1").alias("real_ip"), F.lit("192.0.2.2").alias("direct_ip"), "received_at")

    # -- control tables --------------------------------------------------------

    def projects(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.region.select(
            F.concat(F.lit("proj-"), key.cast("string")).alias("id"),
            F.col("r_name").alias("name"),
            F.lit("javascript").alias("platform"),
            F.concat(F.lit("key_"), F.md5("r_name")).alias("ingest_key"),
            (key + 1).cast("bigint").alias("owner_id"),
            (key != 4).alias("is_active"),
            F.when(key != 3, F.concat(F.lit("2024-01-0"), (key + 1).cast("string"), F.lit(" 00:00:00"))).alias("created_at"))

    def users(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("User"), F.col("c_custkey").cast("string"), F.lit("@Example.com")).alias("email"),
            F.concat(F.lit("cus_"), F.substring(F.md5("c_name"), 1, 14)).alias("stripe_id"),
            F.when(F.col("c_acctbal") < 0, F.concat(F.lit("https://img.example.com/"), F.col("c_custkey").cast("string"))).alias("avatar"))

    def _people(self, segment: str, prefix: str) -> DataFrame:
        key = F.col("c_custkey")
        email = F.concat(F.lit("User"), key.cast("string"), F.lit("@Example.com"))
        return self.customer.where(F.col("c_mktsegment") == segment).select(
            F.concat(F.lit(prefix), key.cast("string")).alias("id"),
            F.concat(F.lit("proj-"), (key % 5).cast("string")).alias("project_id"),
            F.when(key % 2 == 0, F.lower(email)).otherwise(F.upper(email)).alias("email"),
            F.when(F.col("c_nationkey") > 3, F.format_string("2024-01-%02d 00:00:00", F.col("c_nationkey"))).alias("created_at"))

    def project_members(self) -> DataFrame:
        return self._people("BUILDING", "mem_").withColumn("role", F.lit("member"))

    def project_invites(self) -> DataFrame:
        """Invites go to one market segment, a few of them to unregistered addresses."""
        stranger = F.concat(F.lit("guest"), F.regexp_extract("id", r"(\d+)", 1), F.lit("@example.org"))
        return (self._people("MACHINERY", "inv_")
                .withColumn("token", F.md5("id"))
                .withColumn("email", F.when(F.col("created_at").isNull(), stranger).otherwise(F.col("email"))))

    def alert_channels(self) -> DataFrame:
        n, name = F.col("n_nationkey"), F.col("n_name")
        return self.nation.select(
            F.concat(F.lit("ch_"), n.cast("string")).alias("id"),
            F.concat(F.lit("proj-"), F.col("n_regionkey").cast("string")).alias("project_id"),
            F.when(n % 2 == 0, "slack").otherwise("discord").alias("type"),
            F.when(n % 5 == 4, "http://intranet.example.com/x")
            .when(n % 2 == 0, F.concat(F.lit("https://hooks.slack.com/services/"), name))
            .otherwise(F.concat(F.lit("https://discord.com/api/webhooks/"), name)).alias("webhook_url"),
            (n % 3 != 0).alias("enabled"))

    def email_suppressions(self) -> DataFrame:
        """Addresses that bounced: customers in debt."""
        return self.customer.where(F.col("c_acctbal") < 0).select(
            F.upper(F.concat(F.lit("User"), F.col("c_custkey").cast("string"), F.lit("@Example.com"))).alias("email"),
            F.when(F.col("c_acctbal") < -500, "complaint").otherwise("bounce").alias("type"))

    # -- derived activity ------------------------------------------------------

    def fix_runs(self) -> DataFrame:
        """One analysis run per error or purchase entry, its state from a hash of the id."""
        entries = self.log_entries().where(F.col("level").isin("warning", "error", "critical", "alert", "emergency"))
        # value is not part of the log row, so the state hashes the id instead
        state = F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") % 8
        stamp = F.replace(F.substring("timestamp", 1, 19), F.lit("T"), F.lit(" "))
        return entries.select(
            F.concat(F.lit("run_"), "id").alias("id"), "project_id",
            F.col("id").alias("log_entry_id"),
            fingerprint_of(F.col("level"), F.col("channel"), F.col("message")).alias("fingerprint"),
            F.when(state == 0, "queued").when(state == 1, "running").when(state <= 3, "failed").otherwise("completed").alias("status"),
            stamp.alias("created_at"),
            F.when(state == 7, "not json").when(state > 3, F.concat(
                F.lit('{"summary":"s '), F.col("id"),
                F.lit('","rootCause":"r","confidence":"low","suspects":[{"location":"a.b","reason":"x"}],'
                      '"steps":[{"title":"t","detail":"d"},{"title":"t2","detail":"d2"}],"patch":"","verification":["v1","v2"]}'),
            )).alias("analysis"))

    def run_events(self) -> DataFrame:
        """Lifecycle events of runs: five consecutive events belong to one run."""
        kind = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "failed")
                .when(F.col("event_type") == "purchase", "completed").otherwise("running"))
        return self.events.select(
            F.concat(F.lit("run_"), F.floor(F.col("event_id") / 5).cast("bigint").cast("string")).alias("run_id"),
            "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), kind.alias("kind"))

    def subscription_events(self) -> DataFrame:
        """Lifecycle events keyed by subscription; the customer is the acting user, some unknown."""
        kind, uid = F.col("event_type"), F.col("user_id")
        name = F.concat(F.lit("Customer#"), F.lpad(uid.cast("string"), 9, "0"))
        return self.events.select(
            "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"),
            F.concat(F.lit("sub_"), uid.cast("string")).alias("provider_id"),
            F.when(uid % 13 == 0, "cus_unknown").otherwise(F.concat(F.lit("cus_"), F.substring(F.md5(name), 1, 14))).alias("customer"),
            F.when(kind == "signup", "created").when(kind == "error", "deleted").otherwise("updated").alias("kind"),
            F.when(kind == "purchase", "active").when(kind == "click", "past_due").otherwise("trialing").alias("status"),
            F.concat(F.lit("price_"), (F.col("event_id") % 3).cast("string")).alias("price_id"),
            F.floor(F.col("value") * 100).cast("bigint").alias("unit_price"),
            F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 4).cast("int")).alias("quantity"))

    def query_logs(self) -> DataFrame:
        order, qty = F.col("l_orderkey"), F.col("l_quantity")
        return self.lineitem.select(
            F.concat_ws("-", F.concat(F.lit("q"), order.cast("string")), F.col("l_linenumber").cast("string"),
                        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
            F.when(F.col("l_linestatus") == "O", F.concat(
                F.lit("select * from orders where id = "), order.cast("string"), F.lit(" and flag = '"), F.col("l_returnflag"), F.lit("'")))
            .otherwise(F.concat(
                F.lit("UPDATE parts SET qty = "), qty.cast("int").cast("string"), F.lit(" WHERE id IN ("),
                F.col("l_partkey").cast("string"), F.lit(", "), F.col("l_suppkey").cast("string"), F.lit(")"))).alias("query"),
            (qty * 4).alias("duration"),
            F.when(F.col("l_linestatus") == "O", "primary").otherwise("replica").alias("connection"),
            F.when(F.col("l_returnflag") == "R", "boom").alias("error"),
            F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("executed_at"),
            order.cast("string").alias("transaction_id"))
