"""Quality rules from repetition coverage.

Rolling hashes of several n-gram lengths are taken over the words of many texts at once; a text's coverage for
a length is the share of its word characters that lie inside n-grams found twice or more in it (all occurrences,
the first included). Lines are treated alike. The work is local to a row: no shuffle, and memory is bounded by the
piece of a batch (see ``flat``).

Defined results: a null or empty text has no words, so every count and share is 0 and the text fails the base rule
(too few words). Repeated rows and ids are measured each on its own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .flat import BLANK_SEPARATED, Hasher, mixed, pieces, repeated, runs_of, sums_between, tidy, words_of
from .registry import query, table

# Largest share of characters inside repeated n-grams, by n-gram length, and inside repeated lines.
MOST_COVERED = {5: 0.15, 10: 0.10}
MOST_IN_LINES = 0.20
LEAST_WORDS = 50
WINDOW = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _measure(data: np.ndarray, borders: np.ndarray, lengths: tuple[int, ...], hasher: Hasher) -> dict[str, np.ndarray]:
    w = words_of(data, borders, BLANK_SEPARATED)
    point = (data & 0xC0) != 0x80
    blank = ~BLANK_SEPARATED[data]
    sums = hasher.sums(data)
    words, texts = hasher.ranges(sums, w.start, w.end), w.texts()
    salt = mixed(np.arange(1, len(borders), dtype=np.uint64))
    out = {
        "n_words": w.counts, "word_chars": sums_between(point & ~blank, borders),
        "n_symbols": sums_between(_SYMBOL[data], borders),
    }
    points = np.concatenate([[0], np.cumsum(point)])
    chars = points[w.end] - points[w.start]

    def inside(n: int) -> np.ndarray:
        hashes, full = runs_of(words, w.first, n)
        found = np.zeros(len(words), bool)
        found[full] = repeated(hashes[full] ^ salt[texts[full]])
        covered = found.copy()
        for j in range(1, n):
            covered[j:] |= found[:-j]
        return covered

    out["n_repeat_words"] = sums_between(inside(WINDOW), w.first)
    for n in lengths:
        out[f"chars_{n}"] = sums_between(np.where(inside(n), chars, 0), w.first)

    # Lines: from a text's start or after a line feed, to the next line feed or the text's end.
    feeds = np.flatnonzero(data == 0x0A)
    start = np.concatenate([borders[:-1], feeds + 1])
    text = np.concatenate([np.arange(len(borders) - 1), np.searchsorted(borders, feeds, "right") - 1])
    order = np.lexsort((start, text))
    start, text = start[order], text[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.flatnonzero(np.diff(text, append=len(borders)))
    end[last] = borders[1:]
    in_line = np.concatenate([[0], np.cumsum(~blank & point)])
    held = in_line[end] - in_line[start]
    start, end, text, held = (x[held > 0] for x in (start, end, text, held))
    keys = hasher.ranges(sums, start, end) ^ salt[text]
    _, earliest = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[earliest] = False
    n = len(borders) - 1
    out["n_dup_lines"] = np.bincount(text[later], minlength=n)
    twice = repeated(keys)
    out["chars_lines"] = np.bincount(text[twice], weights=held[twice], minlength=n).astype(np.int64)
    return out


def repetition(text: str | Column = "text", lengths: tuple[int, ...] = tuple(MOST_COVERED)) -> Column:
    """Counts of a text as a struct: words, characters in words, symbols, repeated lines and words, and the characters
    inside repeated n-grams (``chars_<n>``) and lines (``chars_lines``)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"chars_{n}" for n in lengths), "chars_lines"]

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        for batch in batches:
            parts = [_measure(data, borders, lengths, hasher) for _, _, data, borders in pieces(batch)]
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        tidy()

    measure.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(measure, ", ".join(f"{k} long" for k in names))(text)


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_covered: dict[int, float] | None = None, most_in_lines: float = MOST_IN_LINES) -> DataFrame:
    """One row per document: counts, covered shares (``share_<n>``, ``share_lines``), ``base_failed`` and ``kept``."""
    most = MOST_COVERED if most_covered is None else most_covered
    found = docs.select(F.col(id_column), repetition(F.col(text_column), tuple(most)).alias("r")).select(id_column, "r.*")
    share = lambda c: F.when(F.col("word_chars") > 0, F.col(c) / F.col("word_chars")).otherwise(F.lit(0.0))
    found = found.select("*", *(share(f"chars_{n}").alias(f"share_{n}") for n in most), share("chars_lines").alias("share_lines"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.col("share_lines") <= most_in_lines
    for n, limit in most.items():
        fine &= F.col(f"share_{n}") <= limit
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def _sql() -> str:
    """The query in SQL: words by position, n-grams as text."""
    grams = "".join(f"""
g{n} as (select r, i, count(*) over (partition by r, k) as c from (select r, i, array_to_string(w[i: i + {n} - 1], ' ') as k from (select r, w, unnest(range(1, len(w) - {n} + 2)) as i from d where len(w) >= {n}))),
in{n} as (select d.r, count(*) as words, cast(sum(length(d.w[p.p])) as bigint) as chars from (select distinct r, unnest(range(i, i + {n})) as p from g{n} where c > 1) p join d on d.r = p.r group by d.r),""" for n in (WINDOW, *MOST_COVERED))
    shares = ", ".join(f"case when word_chars > 0 then coalesce(in{n}.chars, 0)::double / word_chars else 0.0::double end as share_{n}" for n in MOST_COVERED)
    fine = " and ".join(f"share_{n} <= {limit}" for n, limit in MOST_COVERED.items())
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),{grams}
l as (select r, x, count(*) over (partition by r, x) as c, row_number() over (partition by r, x) as k, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) as n
      from (select r, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]')),
ls as (select r, count(*) filter (where k > 1) as n_dup_lines, cast(coalesce(sum(n) filter (where c > 1), 0) as bigint) as chars from l group by r),
b as (select r, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols from d),
m as (select b.*, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(in{WINDOW}.words, 0)::bigint as n_repeat_words, {shares},
        case when word_chars > 0 then coalesce(ls.chars, 0)::double / word_chars else 0.0::double end as share_lines
      from b left join ls using (r) {" ".join(f"left join in{n} using (r)" for n in (WINDOW, *MOST_COVERED))}),
f as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {fine} and share_lines <= {MOST_IN_LINES} as kept,
  {", ".join(f"share_{n}" for n in MOST_COVERED)}, share_lines from f
"""


@query("op7_quality_rules", _sql())
def op7_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Quality rules over all documents."""
    return quality_rules(table(spark, directory, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *(f"share_{n}" for n in MOST_COVERED), "share_lines")


ship_by_value(__name__)
