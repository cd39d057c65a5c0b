"""Periodic runs of words, by minimizers at several scales.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical), at least ``LEAST`` words and
``TIMES`` periods long, that no neighbouring word extends keeping period ``q``. All runs of a text are found:

* Periods under ``DIRECT`` are scanned lag by lag. A run of period ``q`` holds at least ``max(LEAST, TIMES * q) - q`` successive words that
  equal the word ``q`` further on, so one word in so many is looked at.
* Periods of ``Q`` to ``2Q``, for ``Q`` = ``DIRECT`` and its doublings: hashes of ``Q/4`` words at every place, the minima of all windows of
  ``Q/4`` places. Inside a run windows a period apart hold the same hashes, so minima repeat at the distance of the period. Equal
  minima that follow each other within ``Q/8`` belong to a shorter period; only the first of such a row (its head) counts. A run of three
  periods is long enough for two heads at the distance ``q`` that see nothing from outside the run: 2 windows + 1 hash + Q/8 < Q.
  Heads of a hash stand more than ``Q/8`` apart, so each has at most 16 partners closer than ``2Q``.
* Every such pair is a seed. It is extended both ways as far as words at its distance agree, by bisection over rolling hashes. A stretch of
  a multiple of the smallest period has the borders of the run itself, so of equal borders the least distance is the run.

Work is local to a row, in pieces of about 1 MB or one text (see ``flat``), so memory is bounded by a piece. Words are known by 64-bit hashes.

Defined results: a null text has no words, hence no runs and an empty collapsed text. Blanks around words are dropped from the collapsed text of every
document. Repeated rows are treated alike, each on its own; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .flat import BLANK_SEPARATED, Hasher, mixed, pieces, tidy, words_of
from .registry import query, table

LEAST, TIMES = 24, 3
DIRECT = 32

RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"
WORDS = r"[^\x20\x09-\x0D]+"


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + count[0] - 1, start[1], ..."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


class Sequence:
    """Hashes of word ranges of the texts of a piece."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, hasher: Hasher):
        n = len(ids)
        hasher.grow(n + 1)
        self.ids, self.first, self.counts, self.down = ids, first, np.diff(first), hasher.down
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ids * hasher.up[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on agree, or before them if ``back``; at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            half = (low[open_] + high[open_] + 1) >> 1
            shift = half if back else 0
            same = self.hashes(a[open_] - shift, half) == self.hashes(b[open_] - shift, half)
            low[open_[same]] = half[same]
            high[open_[~same]] = half[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def _near(s: Sequence, q: int) -> np.ndarray:
    """Places of which at least one lies in every run of the period ``q``, besides others."""
    ids, last = s.ids, len(s.ids) - 1 - q
    at = np.arange(0, last + 1, max(LEAST, TIMES * q) - q)
    at = at[(ids[at] == ids[at + q]) & (s.text[at] == s.text[at + q])]
    up, down = np.minimum(at + 1, last), np.maximum(at - 1, 0)
    return at[(ids[up] == ids[up + q]) | (ids[down] == ids[down + q])]


def _far(s: Sequence, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, distance) of equal minima, of which at least one lies in every run of a period from ``scale`` to its double."""
    size = window = scale // 4
    held = np.flatnonzero(s.counts >= TIMES * scale)
    at = spread(s.first[held], s.counts[held])
    end = s.first[s.text[at] + 1]
    hashes = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    whole = at + size <= end
    hashes[whole] = mixed(s.hashes(at[whole], size))
    least, step = hashes, 1
    while step < window:
        least = np.concatenate([np.minimum(least[:-step], least[step:]), least[-step:]])
        step *= 2
    most, step = np.where(at + size + window - 1 <= end, least, np.uint64(0)), 1
    while step < window:
        most = np.concatenate([most[:step], np.maximum(most[step:], most[:-step])])
        step *= 2
    chosen = np.flatnonzero((hashes == most) & (most > 0))
    at = at[chosen]
    keys = hashes[chosen] ^ mixed(s.text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    head = np.ones(len(at), bool)
    head[1:] = (keys[1:] != keys[:-1]) | (at[1:] - at[:-1] > scale // 8)
    keys, at = keys[head], at[head]
    places, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in range(1, len(at)):
        apart = at[t:] - at[:-t]
        close = (keys[t:] == keys[:-t]) & (apart < 2 * scale) & (s.text[at[t:]] == s.text[at[:-t]])
        if not close.any():
            break
        pair = np.flatnonzero(close & (apart >= scale))
        places.append(at[pair])
        distances.append(apart[pair])
    return np.concatenate(places), np.concatenate(distances)


def runs_of_texts(ids: np.ndarray, first: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period; ``first[i]:first[i + 1]`` are the words of text ``i``."""
    s = Sequence(ids, first, hasher)
    seeds = [(at, np.full(len(at), q, np.int64)) for q in range(1, DIRECT) for at in [_near(s, q)]]
    longest, scale = int(s.counts.max()) if len(s.counts) else 0, DIRECT
    while TIMES * scale <= longest:
        seeds.append(_far(s, scale))
        scale *= 2
    at, period = (np.concatenate(x) for x in zip(*seeds, strict=True))
    text = s.text[at] if len(ids) else np.zeros(0, np.int64)
    begin, stop = s.first[text], s.first[text + 1]
    start = at - s.agree(at, at + period, at - begin, back=True)
    end = at + period + s.agree(at, at + period, stop - at - period)
    held = end - start >= np.maximum(LEAST, TIMES * period)
    text, start, end, period = (x[held] for x in (text, start, end, period))
    order = np.lexsort((period, end, start))
    text, start, end, period = (x[order] for x in (text, start, end, period))
    new = np.ones(len(text), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text, start, end, period = (x[new] for x in (text, start, end, period))
    order = np.lexsort((period, start))
    text, start, end, period = (x[order] for x in (text, start, end, period))
    return text, start - s.first[text], end - start, period


def _piece(data: np.ndarray, borders: np.ndarray, hasher: Hasher) -> pa.StructArray:
    w = words_of(data, borders, BLANK_SEPARATED)
    ids = hasher.ranges(hasher.sums(data), w.start, w.end)
    text, start, length, period = runs_of_texts(ids, w.first, hasher)

    # A run's first period stays; marks where dropping begins and ends are summed up along the words.
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, w.first[text] + start + period, 1)
    np.add.at(marks, w.first[text] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
    size = w.end[kept] - w.start[kept] + 1
    out = np.append(data, np.uint8(0x20))[spread(w.start[kept], size)]
    out[np.cumsum(size) - 1] = 0x20
    per_text = np.searchsorted(kept, w.first)
    ends = np.concatenate([[0], np.cumsum(size)])[per_text]
    # The blank after a text's last word goes.
    filled = np.diff(ends) > 0
    bytes_held = np.ones(len(out), bool)
    bytes_held[ends[1:][filled] - 1] = False
    offsets = ends - np.concatenate([[0], np.cumsum(filled)])
    collapsed = pa.Array.from_buffers(pa.large_string(), len(borders) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[bytes_held])])

    found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(borders))), pa.int32()), found)
    return pa.StructArray.from_arrays([pa.array(w.counts, pa.int64()), lists, collapsed.cast(pa.string())], ["n_words", "runs", "collapsed"])


def periodic_runs(text: str | Column = "text") -> Column:
    """Struct of ``n_words``, ``runs`` (start, length and period in words, by start and period) and ``collapsed``: the words that no run
    holds behind its first period, joined by one blank."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        empty = _piece(np.zeros(0, np.uint8), np.zeros(1, np.int64), hasher)
        for batch in batches:
            yield pa.concat_arrays([empty, *(_piece(data, borders, hasher) for _, _, data, borders in pieces(batch))])
        tidy()

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, f"n_words long, runs {RUN_TYPE}, collapsed string")(text)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equals the one of least start, then period. Null if there is none."""

    def ahead(a: Column, b: Column) -> Column:
        more, less = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(more > less, -1).when(more < less, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort(runs, ahead), F.lit(0))


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: key, ``n_words``, ``runs`` and the ``collapsed`` text."""
    return docs.select(F.col(id_column), periodic_runs(F.col(text_column)).alias("r")).select(id_column, "r.*")


def planted(key: Column, text: Column) -> Column:
    """The text the contract asks for: of one document in ten, as a hash of its key says, the tail repeats its first words.
    A null key leaves the text as it is."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
    # Whole periods side by side, cut to the words the text had: the words are found a fixed number of times, not once per word.
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(WORDS)), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Runs of all documents after planting; the strongest run, and digests of all runs and of the collapsed text."""
    docs = table(spark, directory, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    rows = find_runs(docs).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


ship_by_value(__name__)
