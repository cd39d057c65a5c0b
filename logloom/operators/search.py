"""Search over text tables as scans: matching, typos, ranking, facets, highlights, distance.

The documented engine leaves most semantics open; ours stand in the docstrings. Every
score is an expression on its own row. Documents never meet each other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shortest words that may hold one and two typos.
ONE_TYPO = 5
TWO_TYPOS = 9

_WORD_GAP = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), _WORD_GAP, " "), " "), lambda w: w != "")


def query_terms(query: str, stop_words: set[str] | None = None) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    return [w for w in words if w not in (stop_words or set())] or words


def allowed_typos(term: str, exempt: set[str] | None = None) -> int:
    if term in (exempt or set()) or len(term) < ONE_TYPO:
        return 0
    return 2 if len(term) >= TWO_TYPOS else 1


def term_search(df: DataFrame, text: str, query: str, words: Column | None = None) -> DataFrame:
    """Rows containing every term as a whole word."""
    wanted = F.lit(query_terms(query))
    have = words if words is not None else tokens(F.col(text))
    return df.where(F.size(F.array_except(wanted, have)) == 0)


def total_hits(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total_hits"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for all columns in one pass over the hits."""
    values = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(values)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def highlight(text: Column, terms: list[str], pre: str = "<em>", post: str = "</em>") -> Column:
    """Wrap whole-word matches, whatever their case."""
    either = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", f"{pre}$1{post}")


def crop(text: Column, term: str, length: int, marker: str = "…") -> Column:
    """``length`` characters around the first occurrence, with markers where text was cut."""
    at = F.locate(term, F.lower(text))
    start = F.greatest(F.lit(1), F.when(at > 0, at).otherwise(1) - length // 2)
    head = F.when(start > 1, marker).otherwise("")
    tail = F.when(start + length <= F.length(text), marker).otherwise("")
    return F.concat(head, F.substring(text, start, F.lit(length)), tail)


def _cost(word: Column, term: str, typos: int) -> Column:
    """Edits between a word and a term, NULL beyond ``typos``; lengths are compared first."""
    if typos == 0:
        return F.when(word == term, F.lit(0))
    near = F.abs(F.length(word) - len(term)) <= typos
    return F.when(word == term, F.lit(0)).when(near, F.nullif(F.levenshtein(word, F.lit(term), typos), F.lit(-1)))


def term_cost(words: Column, term: str, typos: int) -> Column:
    """Fewest edits of any word, NULL when no word is near enough."""
    return F.array_min(F.transform(words, lambda w: _cost(w, term, typos)))


def fuzzy_search(df: DataFrame, text: str, query: str, exempt: set[str] | None = None) -> DataFrame:
    """Rows matching every term within its typo allowance, with the summed ``typos``.

    Exploding the one-element cost drops rows without a match and keeps the optimizer
    from computing the cost again in a pushed-down filter.
    """
    out = df.withColumn("_words", F.array_distinct(tokens(F.col(text))))
    costs = []
    for i, term in enumerate(query_terms(query)):
        cost = term_cost(F.col("_words"), term, allowed_typos(term, exempt))
        out = out.select("*", F.explode(F.array_compact(F.array(cost))).alias(f"_t{i}"))
        costs.append(F.col(f"_t{i}"))
    return out.withColumn("typos", sum(costs[1:], costs[0])).drop("_words", *[f"_t{i}" for i in range(len(costs))])


def expand(terms: list[str], synonyms: dict[str, list[str]]) -> list[list[str]]:
    """Each term with its synonyms."""
    return [sorted({t, *synonyms.get(t, [])}) for t in terms]


def synonym_search(df: DataFrame, text: str, query: str, synonyms: dict[str, list[str]], stop_words: set[str] | None = None) -> DataFrame:
    """Rows with at least one spelling of every term that is not a stop word."""
    out = df.withColumn("_words", tokens(F.col(text)))
    for spellings in expand(query_terms(query, stop_words), synonyms):
        out = out.where(F.arrays_overlap("_words", F.lit(spellings)))
    return out.drop("_words")


def distinct_attribute(hits: DataFrame, attribute: str, order: list[Column]) -> DataFrame:
    """Best hit per attribute value; the rank filter prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(attribute).orderBy(*order))
    return hits.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def positions(words: Column, term: str) -> Column:
    """Places of a term among the words, from 1, in order."""
    at = F.filter(F.transform(words, lambda w, i: F.when(w == term, i + 1)), lambda p: p.isNotNull())
    return F.coalesce(at, F.array().cast("array<int>"))


def smallest_window(lists: list[Column]) -> Column:
    """Words in the smallest stretch that holds a place of each list; empty lists are left out, NULL when all are empty.

    One walk over all places in order: the stretch that ends at a place begins at the earliest of the lists' last places up to
    it, so the work follows the occurrences, not their combinations.
    """
    def marked(at: Column, number: int) -> Column:
        return F.transform(at, lambda p: F.struct(p.alias("at"), F.lit(number).alias("list")))

    places = F.array_sort(F.flatten(F.array(*[marked(at, i) for i, at in enumerate(lists)])))
    needed = sum((F.size(at) > 0).cast("int") for at in lists)
    names = [f"l{i}" for i in range(len(lists))]
    none = F.lit(None).cast("int")

    def step(state: Column, place: Column) -> Column:
        last = [F.when(place["list"] == i, place["at"]).otherwise(state[n]) for i, n in enumerate(names)]
        seen = F.array_compact(F.array(*last))
        width = F.when(F.size(seen) == needed, place["at"] - F.array_min(seen) + 1)
        return F.struct(*[c.alias(n) for c, n in zip(last, names)], F.least(state["best"], width).alias("best"))

    start = F.struct(*[none.alias(n) for n in names], none.alias("best"))
    return F.aggregate(places, start, step, lambda state: state["best"])


def rank_columns(costs: list[Column], lists: list[Column]) -> dict[str, Column]:
    """Ranking keys in rule order, from the cost and the exact places of each term.

    words: terms found (more is better); typo: summed edits; proximity: words in the smallest stretch that holds every term that is
    found exactly, less the number of these terms (0: they stand side by side; NULL, last: fewer than two are there);
    attribute: first exact place (NULL, last: none); exactness: terms found without edits (more is better). Texts are read whole.
    """
    found = [c.isNotNull().cast("int") for c in costs]
    edits = [F.coalesce(c, F.lit(0)) for c in costs]
    exact = [F.coalesce((c == 0).cast("int"), F.lit(0)) for c in costs]
    held = sum((F.size(at) > 0).cast("int") for at in lists)
    return {
        "words": sum(found[1:], found[0]),
        "typo": sum(edits[1:], edits[0]),
        "proximity": F.when(held > 1, smallest_window(lists) - held),
        "attribute": F.array_min(F.transform(F.array(*lists), lambda at: F.get(at, 0))),
        "exactness": sum(exact[1:], exact[0]),
    }


def ranked(df: DataFrame, text: str, query: str, limit: int, sort: list[Column], tie: str) -> DataFrame:
    """Rows with at least one term, by words, typo, proximity, attribute, sort, exactness.

    Rows without a term sort last, so they are dropped after the cut to ``limit``; before
    it, the filter would be pushed down and score every row twice.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    words = df.withColumn("_words", tokens(F.col(text))).withColumn("_uniq", F.array_distinct("_words"))
    measured = words.select(
        *df.columns, *[term_cost(F.col("_uniq"), t, allowed_typos(t)).alias(f"_c{i}") for i, t in enumerate(terms)],
        *[positions(F.col("_words"), t).alias(f"_p{i}") for i, t in enumerate(terms)])
    keys = rank_columns([F.col(f"_c{i}") for i in range(len(terms))], [F.col(f"_p{i}") for i in range(len(terms))])
    order = [F.desc("words"), F.asc("typo"), F.asc_nulls_last("proximity"), F.asc_nulls_last("attribute"), *sort, F.desc("exactness"), F.asc(tie)]
    return measured.select(*df.columns, *[v.alias(k) for k, v in keys.items()]).orderBy(*order).limit(limit).where("words > 0")


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def tf_idf(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Sum over terms of tf * ln(1 + N / df). The corpus figures are one scalar subquery."""
    terms = query_terms(query)
    counts = [f"_c{i}" for i in range(len(terms))]
    counted = df.select(key, tokens(F.col(text)).alias("w")).select(key, *[_occurrences(F.col("w"), t).alias(c) for t, c in zip(terms, counts)])
    corpus = counted.agg(F.struct(F.count("*").alias("n"), *[F.count_if(F.col(c) > 0).alias(c) for c in counts])).scalar()
    parts = [F.when(F.col(c) > 0, F.col(c) * F.log(1 + corpus["n"] / corpus[c])).otherwise(0.0) for c in counts]
    return counted.select(key, sum(parts[1:], parts[0]).alias("score")).where("score > 0")


def multi_search(indexes: dict[str, tuple[DataFrame, str, str]], query: str) -> DataFrame:
    """Term search over several tables: name → (table, key column, text column)."""
    out = None
    for name, (df, key, text) in indexes.items():
        part = term_search(df, text, query).select(F.lit(name).alias("index"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


# Fixed value: mean earth radius in metres.
EARTH_M = 6371000.0


def distance_m(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance in metres (haversine)."""
    dlat, dlon = F.radians(lat - lat0) / 2, F.radians(lon - lon0) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within_radius(df: DataFrame, lat: str, lon: str, lat0: float, lon0: float, metres: float) -> DataFrame:
    """Rows within the radius and their distance; a latitude band is tested first and reaches the scan."""
    band = metres / EARTH_M * 57.29577951308232 + 1e-9
    near = df.where(F.col(lat).between(lat0 - band, lat0 + band))
    return near.withColumn("distance_m", distance_m(F.col(lat), F.col(lon), lat0, lon0)).where(F.col("distance_m") <= metres)
