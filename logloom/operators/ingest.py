"""From untrusted JSON request bodies to bounded, fully accounted log rows.

All of it is row-local: one parse of the body, one generator, one projection, and no
shuffle. Accounting reads the parsed arrays, so it needs no regrouping of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels, text
from ..schema import LOG_COLUMNS
from .lineage import cut
from .quota import BUDGETS, rate_limit

# Request limits.
MAX_BATCH = 500
MAX_BODY_BYTES = 512 * 1024

# Fields that are stored as plain text; Spark hands back compact JSON for non-strings.
_SCALARS = ["level", "message", "channel", "environment", "release", "framework", "host", "timestamp",
            "trace_id", "traceId", "request_id", "requestId"]
_JSON = ["context", "sdk", "user"]
_ENTRY = ", ".join(f"{f} string" for f in _SCALARS + _JSON)


def _present(node: Column) -> Column:
    """Neither missing nor JSON null."""
    return node.isNotNull() & ~F.coalesce(F.is_variant_null(node), F.lit(False))


def _usable(entry: Column) -> Column:
    return F.coalesce(_present(F.try_variant_get(entry, "$.message", "variant")), F.lit(False))


def parse_bodies(requests: DataFrame) -> DataFrame:
    """Add ``nodes`` (variants) and ``texts`` (raw JSON), the entries of each body by position.

    ``logs`` wins when it is an array, else a body with a non-null ``message`` is one
    entry, else there are none. ``malformed`` marks bodies that are not JSON.
    """
    tree = F.try_parse_json("body")
    logs = F.try_variant_get("tree", "$.logs", "array<variant>")
    raw = F.from_json("body", "logs array<string>")["logs"]
    bare = F.coalesce(_usable(F.col("tree")), F.lit(False))
    return (
        requests.withColumn("tree", tree)
        .withColumn("malformed", F.col("body").isNull() | F.col("tree").isNull())
        .withColumn("batch", logs)
        .withColumn("nodes", F.when(F.col("batch").isNotNull(), F.col("batch"))
                    .when(bare, F.array("tree")).otherwise(F.array().cast("array<variant>")))
        .withColumn("texts", F.when(F.col("batch").isNotNull(), raw)
                    .when(bare, F.array("body")).otherwise(F.array().cast("array<string>")))
        .drop("batch")
    )


def accounting(requests: DataFrame) -> DataFrame:
    """``n = stored + dropped + skipped`` per request, computed in place."""
    seen = F.slice("nodes", 1, MAX_BATCH)
    return (
        parse_bodies(requests)
        .withColumn("n", F.size("nodes"))
        .withColumn("stored", F.size(F.filter(seen, _usable)))
        .withColumn("dropped", F.greatest(F.lit(0), F.col("n") - MAX_BATCH))
        .withColumn("skipped", F.col("n") - F.col("stored") - F.col("dropped"))
        .drop("tree", "nodes", "texts")
    )


def quarantine(requests: DataFrame) -> DataFrame:
    """Requests that yield no entry: broken JSON or nothing usable in shape."""
    return (
        parse_bodies(requests)
        .where(F.col("malformed") | (F.size("nodes") == 0))
        .withColumn("reason", F.when(F.col("malformed"), "malformed").otherwise("no log entries"))
        .drop("tree", "nodes", "texts", "malformed")
    )


def outcomes(requests: DataFrame) -> DataFrame:
    """Every stored entry (``kind`` entry) and every request that yields none (``quarantine``, with body and reason) from one parse of the bodies.

    Stateless, so it serves streams as well. Log columns are null in quarantine; entries of a request that are unusable or over the batch limit give no row.
    """
    entries = (
        parse_bodies(requests)
        .select("*", F.posexplode_outer(F.arrays_zip("nodes", "texts")).alias("at", "entry"))
        .withColumn("kind", F.when(F.col("at").isNull(), "quarantine").otherwise("entry"))
        .withColumn("reason", F.when(F.col("at").isNull(), F.when(F.col("malformed"), "malformed").otherwise("no log entries")))
        .withColumn("body", F.when(F.col("at").isNull(), F.col("body")))
        .withColumn("source_request", F.col("request_id"))
        .select("*", F.coalesce("at", F.lit(0)).alias("pos"), F.col("entry.nodes").alias("node"), F.col("entry.texts").alias("text"))
        .withColumn("usable", _usable(F.col("node")) | F.col("at").isNull())
        .drop("tree", "nodes", "texts", "entry", "malformed"))
    kept = {c: F.col(c) for c in ("kind", "source_request", "received_at", "reason", "body")}
    shaped = normalize_entries(entries, F.col("header_project"), F.col("received_at"), F.col("request_id"), kept)
    own = ("kind", "source_request", "received_at", "reason", "body")
    return shaped.select(*[F.when(F.col("kind") == "entry", F.col(c)).alias(c) for c in LOG_COLUMNS], *own)


def extract_entries(requests: DataFrame) -> DataFrame:
    """One row per examined or dropped entry, position kept."""
    return (
        parse_bodies(requests)
        .select("*", F.posexplode(F.arrays_zip("nodes", "texts")).alias("pos", "entry"))
        .withColumn("node", F.col("entry.nodes"))
        .withColumn("text", F.col("entry.texts"))
        .withColumn("usable", _usable(F.col("node")))
        .drop("tree", "nodes", "texts", "entry", "malformed", "body")
    )


def json_text(node: Column, raw: Column, limit: int = text.MAX_CONTEXT) -> Column:
    """Stored text of a JSON object or array; NULL for anything else or when empty.

    ``node`` tells objects from strings that look like one; ``raw`` keeps key order.
    """
    shape = F.schema_of_variant(node)
    holder = shape.startswith("OBJECT<") | shape.startswith("ARRAY<")
    kept = F.when(holder & ~raw.isin("{}", "[]"), raw)
    return F.when(text.longer_than(kept, limit), F.lit(text.OVERSIZED_JSON)).otherwise(kept)


def normalize_entries(entries: DataFrame, project: Column, received_at: Column, row_key: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Shape usable entries into log rows, with ``extra`` columns behind them. ``entries`` has ``text``, ``node`` and ``pos``.

    The id hashes the row key and the position, so a retried task writes the same ids.
    """
    field = F.from_json("text", _ENTRY)
    shaped = entries.where(F.col("usable") & (F.col("pos") < MAX_BATCH)).withColumn("f", field)
    f = F.col("f")

    def node(path: str) -> Column:
        return F.try_variant_get("node", f"$.{path}", "variant")

    # the node path finds nothing below a context that is only a string, whatever its text says
    user = F.when(_present(node("user")), json_text(node("user"), f["user"])).otherwise(
        json_text(node("context.user"), F.get_json_object(f["context"], "$.user")))
    columns = {
        "id": F.substring(F.sha2(F.concat_ws("|", row_key, F.col("pos").cast("string")), 256), 1, 36),
        "project_id": project,
        "level": levels.normalize_level(f["level"]),
        "message": text.clip(f["message"], text.MAX_MESSAGE),
        "channel": text.col255(f["channel"]),
        "context": json_text(node("context"), f["context"]),
        "environment": text.col255(F.coalesce(f["environment"], F.lit("production"))),
        "release": text.col255(f["release"]),
        "framework": text.col255(f["framework"]),
        "host": text.col255(f["host"]),
        "sdk": json_text(node("sdk"), f["sdk"], text.MAX_SDK),
        "user_context": user,
        "timestamp": F.coalesce(text.col255(f["timestamp"]), received_at),
        "trace_id": text.col64(F.coalesce(f["trace_id"], f["traceId"])),
        "request_id": text.col64(F.coalesce(f["request_id"], f["requestId"])),
    }
    return shaped.select(*[columns[c].alias(c) for c in LOG_COLUMNS], *[c.alias(n) for n, c in (extra or {}).items()])


def normalize_requests(requests: DataFrame, project: Column | None = None) -> DataFrame:
    """Requests to log rows in one stateless select; works on streams as well."""
    entries = extract_entries(requests)
    return normalize_entries(entries, project if project is not None else F.col("header_project"),
                             F.col("received_at"), F.col("request_id"))


# Verdicts in the order they are decided.
VERDICTS = {
    413: "payload too large",
    400: "no log entries",
    429: "rate limited",
    404: "unknown project",
    403: "project inactive",
    401: "invalid ingest key",
}
NO_KEY = "project has no ingest key"


def measured(requests: DataFrame) -> DataFrame:
    """Size, entry counts and what the request says of its project; bodies over the size limit are not parsed, and none is kept."""
    sized = requests.withColumn("bytes", F.octet_length("body")).withColumn("body", F.when(F.col("bytes") <= MAX_BODY_BYTES, F.col("body")))
    tree = F.try_parse_json("body")

    def from_body(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(tree, p, "string") for p in paths])

    return (
        accounting(sized)
        .withColumn("provided_key", F.coalesce(F.col("header_key"), from_body("$.key")))
        .withColumn("asked", F.nullif(F.coalesce(F.col("header_project"), from_body("$.project", "$.p")), F.lit("")))
        .drop("body", "malformed")
    )


def admission(requests: DataFrame, projects: DataFrame, ip_rejected: DataFrame | None = None) -> DataFrame:
    """Status and error per request, everything but the project quota.

    A request naming a project is looked up by id, else by its key; an unknown key
    alone is 404. ``ip_rejected`` holds the request ids over their address quota.
    Projects are joined without a hint: the optimizer broadcasts them when they are small.
    """
    return judged(measured(requests), projects, ip_rejected)


def judged(body: DataFrame, projects: DataFrame, ip_rejected: DataFrame | None = None) -> DataFrame:
    """``admission`` of requests that are measured already."""
    # ids and keys in one lookup table, so that a single equi-join serves both kinds of request
    project = [F.col("id").alias("pid"), F.col("ingest_key").alias("pkey"), F.col("is_active").alias("active")]
    known = projects.select(F.lit("id").alias("by"), F.col("id").alias("value"), *project).unionByName(
        projects.where("ingest_key is not null").select(F.lit("key").alias("by"), F.col("ingest_key").alias("value"), *project))
    probe = body.withColumn("by", F.when(F.col("asked").isNotNull(), "id").otherwise("key")).withColumn(
        "value", F.coalesce("asked", "provided_key"))
    found = probe.join(known, ["by", "value"], "left")
    limited = F.lit(False)
    if ip_rejected is not None:
        found = found.join(ip_rejected.select("request_id", F.lit(True).alias("over_ip")), "request_id", "left")
        limited = F.coalesce(F.col("over_ip"), F.lit(False))
    status = (
        F.when(F.col("bytes") > MAX_BODY_BYTES, 413)
        .when(F.col("n") == 0, 400)
        .when(limited, 429)
        .when(F.col("pid").isNull(), 404)
        .when(~F.coalesce(F.col("active"), F.lit(True)), 403)
        .when(F.coalesce(F.col("pkey"), F.lit("")) == "", 403)
        .when(~F.coalesce(F.col("provided_key") == F.col("pkey"), F.lit(False)), 401)
        .otherwise(201)
    )
    reasons = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    no_key = (F.col("status") == 403) & F.coalesce(F.col("active"), F.lit(True))
    return (
        found.withColumn("status", status)
        .withColumn("error", F.when(no_key, F.lit(NO_KEY)).otherwise(F.try_element_at(reasons, F.col("status"))))
        .withColumn("project_id", F.when(F.col("status") == 201, F.col("pid")))
        .withColumn("charge", F.when(F.col("status") == 201, F.least(F.col("n"), F.lit(MAX_BATCH))))
        .select("request_id", "project_id", "status", "error", "n", "stored", "dropped", "skipped", "charge", "received_at")
    )


def admit(requests: DataFrame, projects: DataFrame, ip: Column, at_ms: Column, ip_budget: tuple[int, int] = BUDGETS["ip"],
          project_budget: tuple[int, int] = BUDGETS["project"], mode: str = "memory") -> DataFrame:
    """The final verdict of every request, in the order of ``VERDICTS``: size, entries, the quota of its address ``ip``, project and key, the project's quota.

    Only requests that pass the size and entry tests count against their address, and only admitted ones against their project, with
    one point an entry. ``at_ms`` is the arrival. Bodies are parsed once.
    """
    body = cut(measured(requests.withColumn("ip", ip).withColumn("at_ms", at_ms)))
    fit = (F.col("bytes") <= MAX_BODY_BYTES) & (F.col("n") > 0)
    by_ip = body.where(fit).select(F.col("request_id").alias("hit_id"), F.concat(F.lit("ip:"), "ip").alias("key"), F.col("at_ms").alias("ms"), F.lit(1).cast("bigint").alias("charge"))
    over_ip = rate_limit(by_ip, *ip_budget, mode).where(~F.col("ok")).select(F.col("hit_id").alias("request_id"))
    verdicts = cut(judged(body, projects, over_ip))
    admitted = verdicts.where("status = 201").join(body.select("request_id", "at_ms"), "request_id")
    by_project = admitted.select(F.col("request_id").alias("hit_id"), F.concat(F.lit("proj:"), "project_id").alias("key"), F.col("at_ms").alias("ms"), F.col("charge").cast("bigint").alias("charge"))
    over_project = rate_limit(by_project, *project_budget, mode).where(~F.col("ok")).select(F.col("hit_id").alias("request_id"))
    return settle(verdicts, over_project)


def settle(verdicts: DataFrame, project_rejected: DataFrame) -> DataFrame:
    """Turn admitted requests over their project quota into 429 and clear their counts."""
    over = project_rejected.select("request_id", F.lit(True).alias("over"))
    late = F.coalesce(F.col("over"), F.lit(False)) & (F.col("status") == 201)
    kept = F.when(late, 429).otherwise(F.col("status"))
    return (
        verdicts.join(over, "request_id", "left")
        .withColumn("error", F.when(late, VERDICTS[429]).otherwise(F.col("error")))
        .withColumn("status", kept)
        .withColumn("stored", F.when(F.col("status") == 201, F.col("stored")))
        .withColumn("dropped", F.when(F.col("status") == 201, F.col("dropped")))
        .withColumn("skipped", F.when(F.col("status") == 201, F.col("skipped")))
        .withColumn("project_id", F.when(F.col("status") == 201, F.col("project_id")))
        .withColumn("charge", F.when(F.col("status") == 201, F.col("charge")))
        .drop("over")
    )
