"""Benchmark decontamination as a prefix-filtered join.

An item's windows are its runs of ``WINDOW`` words (the whole item if it has fewer), and a window's tokens are its word shingles.
A document holds a window exactly if it holds all its tokens in place, so one token a window is a sufficient prefix: the rarest,
counted over all documents. Documents are read once. Their shingles are tested against a bit field of all item tokens,
whose size is fixed (a fuller field lets more through, it loses nothing); what passes is kept as hits with the words around
them. Hits on prefix tokens are joined with the windows by token, cut by the positions that length and place allow, and verified
word by word.

Texts are not shuffled; copies of a text are searched once from the join on. Skewed tokens are split by the adaptive join.

Defined results: a null or empty text has no words and no hits; an empty benchmark hits nothing. Equal items count under each of
their ids; rows of one id are one item. An item without id marks words but is not counted. Repeated documents get equal rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..shipping import ship_by_value
from .flat import ALPHANUMERIC, LOWER, Hasher, Words, pieces, runs_of, tidy, words_of
from .registry import query, table

WINDOW = 10
SHINGLE = 5
# The bit field of item tokens has 2 ** BITS bits, 2 MB.
BITS = 24


def _words(data: np.ndarray, borders: np.ndarray, hasher: Hasher) -> tuple[Words, np.ndarray, np.ndarray]:
    low = LOWER[data]
    w = words_of(low, borders, ALPHANUMERIC)
    return w, hasher.ranges(hasher.sums(low), w.start, w.end), low


def _plain(low: np.ndarray, w: Words, a: int, b: int) -> list[str]:
    raw = low.tobytes() if len(low) < 4096 else None
    cutter = (lambda s, e: raw[s:e]) if raw is not None else (lambda s, e: low[s:e].tobytes())
    return [cutter(s, e).decode() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]


def item_windows(text: str | Column, window: int = WINDOW, shingle: int = SHINGLE) -> Column:
    """Windows of an item: ``words`` (joined by spaces), ``n`` of them, ``tokens`` (shingle hashes in place), ``length`` of a shingle."""

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        kind = pa.list_(pa.struct([("words", pa.string()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("length", pa.int32())]))
        for batch in batches:
            out = []
            for _, _, data, borders in pieces(batch):
                w, hashes, low = _words(data, borders, hasher)
                for i, count in enumerate(w.counts):
                    n = min(window, int(count))
                    length = min(shingle, n)
                    first = int(w.first[i])
                    words = _plain(low, w, first, first + int(count))
                    tokens = runs_of(hashes[first: first + count], np.array([0, count]), length)[0].view(np.int64).tolist() if n else []
                    out.append([{"words": " ".join(words[j: j + n]), "n": n, "tokens": tokens[j: j + n - length + 1], "length": length} for j in range(int(count) - n + 1)] if n else [])
            yield pa.array(out, kind)

    make.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(make, "array<struct<words: string, n: int, tokens: array<bigint>, length: int>>")(text)


def bit_field(tokens: DataFrame, column: str) -> np.ndarray:
    """Bits of the leading ``BITS`` bits of hashes; at most 2 ** BITS / 64 words come to the driver."""
    bit = F.shiftrightunsigned(F.col(column), 64 - BITS)
    words = tokens.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - BITS}) % 64 as int))").alias("bit"))
    field = np.zeros(1 << (BITS - 6), np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        field[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return field


def scan(text: str | Column, field: np.ndarray, lengths: list[int], window: int = WINDOW) -> Column:
    """``n_words`` of a whole text and ``runs``: stretches of words around hits, from word ``at`` on, with ``place`` and ``token`` of each hit."""

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        hit = pa.struct([("place", pa.int32()), ("token", pa.int64())])
        kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.string()), ("hits", pa.list_(hit))]))
        for batch in batches:
            counts, out = [], []
            for _, _, data, borders in pieces(batch):
                w, hashes, low = _words(data, borders, hasher)
                found: dict[int, list[tuple[int, int]]] = {}
                for length in lengths:
                    tokens, full = runs_of(hashes, w.first, length)
                    bit = tokens >> np.uint64(64 - BITS)
                    at = np.flatnonzero(full & ((field[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool))
                    texts = np.searchsorted(w.first, at, "right") - 1
                    for t, p, k in zip(texts.tolist(), (at - w.first[texts]).tolist(), tokens[at].view(np.int64).tolist(), strict=True):
                        found.setdefault(t, []).append((p, k))
                rows: list[list[dict]] = [[] for _ in range(len(borders) - 1)]
                for t, hits in found.items():
                    n, first = int(w.counts[t]), int(w.first[t])
                    runs: list[list] = []
                    for p, k in sorted(hits):
                        a, b = max(0, p - window + 1), min(n, p + window)
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(b, runs[-1][1])
                            runs[-1][2].append({"place": p, "token": k})
                        else:
                            runs.append([a, b, [{"place": p, "token": k}]])
                    rows[t] = [{"at": a, "words": " ".join(_plain(low, w, first + a, first + b)), "hits": h} for a, b, h in runs]
                counts.append(w.counts)
                out += rows
            n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(out, kind)], ["n_words", "runs"])
        tidy()

    search.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(search, "n_words long, runs array<struct<at: int, words: string, hits: array<struct<place: int, token: bigint>>>>")(text)


def occurrences(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (key, ``content``, ``n_words``), exact occurrences (``content``, ``start``, ``n``, ``words``) and items by window (``words``, ``item``)."""
    listed = items.select(F.col(item_id).cast("string").alias("item"), F.explode(item_windows(F.col(item_text), window, shingle)).alias("w")).select("item", "w.*")
    windows = cut(listed.groupBy("words").agg(F.first("n").alias("n"), F.first("length").alias("length"), F.first("tokens").alias("tokens")))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most ``shingle`` values
    tokens = windows.select("words", "n", F.posexplode("tokens").alias("offset", "token"))
    field = bit_field(tokens, "token")

    text = F.col(text_column)
    held = cut(docs.select(F.col(id_column), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content"), scan(text, field, lengths, window).alias("s")).select(id_column, "content", "s.*"))
    runs = held.filter(F.size("runs") > 0).groupBy("content").agg(F.first("runs").alias("runs")).select("content", F.posexplode("runs").alias("run", "r"))
    hits = runs.select("content", "run", F.explode("r.hits").alias("h")).select("content", "run", "h.*")
    rarity = hits.groupBy("token").agg(F.count("*").alias("found"))
    # A window whose tokens do not all occur can occur nowhere.
    ranked = tokens.join(rarity, "token", "left").groupBy("words", "n").agg(
        F.min(F.coalesce("found", F.lit(0))).alias("least"), F.min_by(F.struct("offset", "token"), F.struct("found", "token", "offset")).alias("rarest"))
    prefix = ranked.filter(F.col("least") > 0).select(F.col("words").alias("window"), "n", "rarest.offset", "rarest.token")
    near = hits.join(prefix, "token").filter(F.col("place") >= F.col("offset")).select("content", "run", F.struct((F.col("place") - F.col("offset")).alias("start"), "n", "window").alias("c"))
    candidates = near.groupBy("content", "run").agg(F.collect_set("c").alias("cs"))
    words = runs.select("content", "run", F.col("r.at").alias("at"), F.split("r.words", " ").alias("ws"))
    fits = lambda c: (c["start"] >= F.col("at")) & (c["start"] + c["n"] <= F.col("at") + F.size("ws"))
    same = lambda c: F.array_join(F.slice("ws", c["start"] - F.col("at") + 1, c["n"]), " ") == c["window"]
    verified = candidates.join(words, ["content", "run"]).select("content", F.explode(F.filter(F.filter("cs", fits), same)).alias("c"))
    found = cut(verified.select("content", "c.start", "c.n", F.col("c.window").alias("words")).distinct())
    return held.select(id_column, "content", "n_words"), found, listed.select("words", "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", **columns: str | int) -> DataFrame:
    """One row per document: key, ``n_words``, ``n_hit`` words inside occurring windows, ``items`` whose windows occur
    (ids as sorted strings), ``longest`` stretch of hit words, ``contaminated``."""
    held, found, items_of = occurrences(docs, items, id_column, **columns)
    end = F.col("start") + F.col("n")
    before = Window.partitionBy("content").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("content", "start", "n").distinct().withColumn("reached", F.max(end).over(before))
    hit = spans.groupBy("content").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("reached", "start")))).alias("n_hit"), F.max("n").alias("longest"))
    listed = found.select("content", "words").distinct().join(items_of, "words").filter(F.col("item").isNotNull()).select("content", "item").distinct()
    listed = listed.groupBy("content").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = hit.join(listed, "content", "left")
    rows = held.join(marks, "content", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(id_column, "content", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"), (n_hit > 0).alias("contaminated"))


# The given benchmark and documents in SQL; windows are compared as text.
OP4_SQL = r"""
with iw as (select item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from (select item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from benchmark)),
dw as (select doc_id, coalesce(regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
       from (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
win as (select distinct item_id, array_to_string(w[i: i + n - 1], ' ') as k, n
        from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from iw where len(w) > 0)),
sizes as (select distinct n from win),
grams as (select doc_id, n, i, array_to_string(w[i: i + n - 1], ' ') as k
          from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
found as (select g.doc_id, g.i, g.n, win.item_id from grams g join win on g.k = win.k and g.n = win.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(s, ',' order by s) as l
        from (select distinct doc_id, item_id, item_id::varchar as s from found) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join hit using (doc_id) left join its using (doc_id)
"""


@query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """All documents against all benchmark items."""
    rows = decontaminate(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ship_by_value(__name__)
