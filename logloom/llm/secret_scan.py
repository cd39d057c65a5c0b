"""Secret scanning with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, for each blob, the rule versions that
have been run on it and what they found. An increment scans only the pairs of blob and rule version that the ledger lacks, each
once however many paths share the blob, and appends its findings. Findings are then joined back to all paths and versions.

Texts are shuffled once, by blob, and copies are merged before the shuffle. The ledger is Parquet in a shared folder; a lost executor repeats
its own tasks, and an increment that dies before its files are committed is simply run again.

Defined results: a null text is scanned as an empty one, without findings. Repeated rows and paths get the same findings each.
Offsets count code points, the end is exclusive. Findings are ordered by start, then by rule as listed. Extra columns are kept out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .flat import tidy
from .langid import remainder
from .registry import query, table
from .shared import shared_folder

# kind: (version, pattern, least length of the group, group). Kinds in the order of the findings.
RULES: dict[str, tuple[int, str, int, int]] = {
    "assign": (1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    "access": (1, r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (1, r"[0-9a-f]+", 16, 0),
    "github": (1, r"gh[opsur]_[A-Za-z0-9]+", 40, 0),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, 0),
    "private_key": (1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1, 0),
}
BASE = ("assign", "access", "hex")
# A text without any of these (in lower case) has no finding of the kind; None: always search.
HINTS: dict[str, tuple[str, ...] | None] = {
    "assign": ("passw", "secret", "token", "api"), "access": ("akia",), "hex": None, "github": ("gh",), "jwt": ("eyj",), "private_key": ("-----begin",),
}
FINDINGS = "array<struct<kind: string, version: int, start: int, end: int>>"


def rule_ids(rules: dict[str, tuple[int, str, int, int]]) -> list[str]:
    return [f"{kind}@{rule[0]}" for kind, rule in rules.items()]


def blob_of(text: Column) -> Column:
    """Content address of a text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scanned(text: Column, wanted: Column, rules: dict[str, tuple[int, str, int, int]]) -> Column:
    """What the rules whose ids are in ``wanted`` find in a whole text."""

    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # A run of one class is matched whole, so a short one can be passed over in the search already.
        compiled = {f"{kind}@{r[0]}": (kind, r[0], re.compile(re.sub(r"^(\[[^\]]+\])\+$", rf"\1{{{r[2]},}}", r[1]), re.ASCII), r[2], r[3], HINTS.get(kind)) for kind, r in rules.items()}
        order = {kind: i for i, kind in enumerate(rules)}

        def one(t: str, ids: list[str]) -> list[dict]:
            found, low = [], t.lower()
            for i in ids:
                kind, version, pattern, least, group, hints = compiled[i]
                if hints is None or any(h in low for h in hints):
                    found += [(m.start(), order[kind], kind, version, m.end()) for m in pattern.finditer(t) if len(m.group(group)) >= least]
            return [{"kind": k, "version": v, "start": s, "end": e} for s, _, k, v, e in sorted(found)]

        kind = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts, ids in batches:
            yield pa.array([one(t.as_py() or "", i.as_py()) for t, i in zip(texts, ids, strict=True)], kind)
        tidy()

    scan.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(scan, FINDINGS)(text, wanted)


def increment(versions: DataFrame, ledger: DataFrame | None, text_column: str = "text", rules: dict[str, tuple[int, str, int, int]] | None = None) -> DataFrame:
    """New ledger rows: ``blob``, ``rules`` run on it now, ``findings``. ``ledger`` None: nothing has been scanned yet."""
    rules = RULES if rules is None else rules
    every = F.array(*(F.lit(i) for i in rule_ids(rules)))
    text = F.coalesce(F.col(text_column), F.lit(""))
    blobs = versions.select(blob_of(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        unseen = blobs.withColumn("rules", every)
    else:
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        left = F.array_except(every, F.coalesce("known", F.array().cast("array<string>")))
        unseen = blobs.join(known, "blob", "left").select("blob", "text", left.alias("rules")).filter(F.size("rules") > 0)
    return unseen.select("blob", "rules", scanned(F.col("text"), F.col("rules"), rules).alias("findings"))


def update_ledger(versions: DataFrame, path: str, text_column: str = "text", rules: dict[str, tuple[int, str, int, int]] | None = None, first: bool = False) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, and return the whole ledger. ``first``: there is no ledger yet."""
    spark = versions.sparkSession
    increment(versions, None if first else spark.read.parquet(path), text_column, rules).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def findings_by_blob(ledger: DataFrame, rules: dict[str, tuple[int, str, int, int]] | None = None) -> DataFrame:
    """``blob`` and the ``findings`` of the current rule versions, in order, for blobs that have any."""
    rules = RULES if rules is None else rules
    order = F.create_map(*(F.lit(x) for i, k in enumerate(rule_ids(rules)) for x in (k, i)))
    found = ledger.filter(F.size("findings") > 0).select("blob", F.explode(F.array_distinct("findings")).alias("f")).withColumn("at", order[F.concat_ws("@", "f.kind", "f.version")])
    found = found.filter(F.col("at").isNotNull()).distinct()
    listed = F.array_sort(F.collect_list(F.struct("f.start", "at", "f.kind", "f.version", "f.end")))
    kept = F.transform(listed, lambda x: F.struct(x["kind"].alias("kind"), x["version"].alias("version"), x["start"].alias("start"), x["end"].alias("end")))
    return found.groupBy("blob").agg(kept.alias("findings"))


def findings_of(versions: DataFrame, ledger: DataFrame, keys: list[str], text_column: str = "text", rules: dict[str, tuple[int, str, int, int]] | None = None) -> DataFrame:
    """Every row of ``versions`` by its ``keys``, with its ``blob`` and ``findings``."""
    rows = versions.select(*keys, blob_of(F.col(text_column)).alias("blob"))
    none = F.array().cast(FINDINGS)
    return rows.join(findings_by_blob(ledger, rules), "blob", "left").select(*keys, "blob", F.coalesce("findings", none).alias("findings"))


def masked(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with ``mark`` in place of what was found; overlapping findings are one."""

    def mask(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for t, found in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
                if t is None or not found:
                    out.append(t)
                    continue
                parts, at, inside = [], 0, False
                for f in sorted(found, key=lambda f: (f["start"], f["end"])):
                    if f["start"] >= at or not inside:
                        parts += [t[at: f["start"]], mark]
                    at, inside = max(at, f["end"]), True
                out.append("".join([*parts, t[at:]]))
            yield pa.array(out, pa.string())
        tidy()

    mask.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(mask, "string")(text, findings)


def _joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


@query("op5_secrets")
def op5_secrets(spark: SparkSession, directory: str) -> DataFrame:
    """Secrets of every document, from a ledger that starts empty and is brought up in two increments, the second without the blobs of the first."""
    docs, path = table(spark, directory, "documents"), shared_folder(spark, "secret-ledger")
    late = remainder("doc_id", 2) == 1
    update_ledger(docs.filter(~late), path, first=True)
    ledger = update_ledger(docs.filter(late), path)
    rows = findings_of(docs, ledger, ["doc_id"])
    found = F.col("findings")
    count = lambda kind: F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")
    base = F.filter(found, lambda f: f["kind"].isin(*BASE))
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(found).alias("spans"))


ship_by_value(__name__)
