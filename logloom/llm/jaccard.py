"""N-gram Jaccard join: documents whose word shingle sets are similar, as a grouped prefix join.

Two sets of Jaccard similarity ``t`` or more share a token among their first ``n - ceil(t * n) + 1`` tokens in any common order.
With tokens ordered by rarity that prefix meets few other documents.

1. *Setting aside.* A document with a whole prefix of tokens found nowhere else links with nothing. To prove it cheaply, tokens
   below a fixed part of the hash range are counted over all documents, repeated ones are marked in a bit field of fixed size, and
   documents with enough unmarked tokens are set aside. A full field sets fewer aside and loses nothing.
2. *Order.* The others are reduced to one per distinct set; their tokens are counted and ordered by count.
   Tokens of one set only can't be shared; they take their places in the prefix and are dropped.
3. *Groups.* Sets of equal size and equal prefix form a group. Members are compared with the group's leader, and groups with a
   hub of each token they share: candidates grow with the rows, not with the square of a token's group.
4. *Rest.* What the verified links connect already needs no more comparison. At the tokens that sets of several components share, a few hubs settle
   all sets whose further tokens lie in the hub (see ``_covered``). All other pairs that share a prefix token pass the size and position
   filters and are verified; so no link between separate components is missed.

``similar_documents`` gives the components, ``similar_pairs`` every link: pairs of groups are filtered, expanded and verified, those inside a
component too.

Links are verified on whole sets. Copies are never expanded into pairs. Sets are known by 64-bit hashes of their tokens and of the whole.

Defined results: null and empty texts have no tokens and are components of their own. Texts of fewer words than a shingle have
one token, the whole sequence. Equal sets always share a component, whose id is the least key in it (null keys are passed over).
Repeated rows are equal sets. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..shipping import ship_by_value
from .components import least_labels
from .flat import BLANK_SEPARATED, LOWER, Hasher, mixed, pieces, repeated, shingles_of, tidy, words_of
from .registry import query, table

SHINGLE = 5
PERCENT = 80
# The counted part of the hash range, in 256ths, and the bit field's size: 2 ** BITS bits are 16 MB.
COUNTED = 80
BITS = 27
# Hubs a token gets before the sets that none of them covers are compared with each other.
ROUNDS = 2


def _sets(data: np.ndarray, borders: np.ndarray, shingle: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each text and their borders."""
    low = LOWER[data]
    w = words_of(low, borders, BLANK_SEPARATED)
    tokens, first = shingles_of(hasher.ranges(hasher.sums(low), w.start, w.end), w.first, shingle)
    text = np.repeat(np.arange(len(borders) - 1), np.diff(first))
    again = np.flatnonzero(repeated(tokens ^ mixed(text.astype(np.uint64) + np.uint64(1))))
    if len(again):
        order = again[np.lexsort((tokens[again], text[again]))]
        same = (tokens[order[1:]] == tokens[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        held = np.ones(len(tokens), bool)
        held[order[1:][same]] = False
        tokens, first = tokens[held], np.concatenate([[0], np.cumsum(held)])[first]
    return tokens, first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def counted_tokens(text: str | Column, shingle: int = SHINGLE) -> Column:
    """Tokens of a whole text that lie in the counted part of the hash range."""

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, most = Hasher(), np.uint64(COUNTED << 56)
        for batch in batches:
            values, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, _, data, borders in pieces(batch):
                tokens, first = _sets(data, borders, shingle, hasher)
                low = tokens < most
                values.append(tokens[low])
                counts.append(np.diff(np.concatenate([[0], np.cumsum(low)])[first]))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values).view(np.int64)))
        tidy()

    make.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(make, "array<bigint>")(text)


def bit_field(tokens: DataFrame) -> np.ndarray:
    """Bits for the column ``token``; at most 2 ** BITS / 64 words come to the driver."""
    bit = F.pmod("token", F.lit(1 << BITS))
    words = tokens.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(token, {1 << BITS}) % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(1 << (BITS - 6), np.uint64)
    field[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return field


def described(text: str | Column, field: np.ndarray | None, shingle: int = SHINGLE, percent: int = PERCENT) -> Column:
    """``n`` (set size) and ``node`` (the set's hash) of a whole text, and its ``tokens`` unless the bit field proves that it
    links with nothing. Within a batch, copies carry them once. Without a field no tokens are given."""

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, most, mask = Hasher(), np.uint64(COUNTED << 56), np.uint64((1 << BITS) - 1)
        for batch in batches:
            ns, nodes, values, counts, given = [], [], [np.zeros(0, np.uint64)], [], []
            for _, _, data, borders in pieces(batch):
                tokens, first = _sets(data, borders, shingle, hasher)
                n = np.diff(first)
                node = mixed(_sums(mixed(tokens + np.uint64(0x51)), first) + n.astype(np.uint64))
                ns.append(n)
                nodes.append(node)
                if field is None:
                    continue
                bit = tokens & mask
                alone = (tokens < most) & ((field[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) == 0)
                unique = np.diff(np.concatenate([[0], np.cumsum(alone)])[first])
                kept = (unique < n - (percent * n + 99) // 100 + 1) & (n > 0)
                values.append(tokens[np.repeat(kept, n)])
                counts.append(np.where(kept, n, 0))
                given.append(kept)
            node = np.concatenate([np.zeros(0, np.uint64), *nodes]).view(np.int64)
            n = np.concatenate([np.zeros(0, np.int64), *ns])
            columns, names, flat = [pa.array(n), pa.array(node)], ["n", "node"], np.concatenate(values)
            if field is not None:
                kept, size = np.concatenate([np.zeros(0, bool), *given]), np.concatenate([np.zeros(0, np.int64), *counts])
                at = np.flatnonzero(kept)
                first_of = at[np.unique(node[at], return_index=True)[1]]
                once = np.zeros(len(n), bool)
                once[first_of] = True
                flat = flat[np.repeat(once, size)]
                offsets = np.concatenate([[0], np.cumsum(np.where(once, size, 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)), mask=pa.array(~once))
                columns, names = [*columns, lists], [*names, "tokens"]
            yield pa.StructArray.from_arrays(columns, names)
        tidy()

    make.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Declared nondeterministic, so that no filter on a field is pushed below and evaluates it again.
    return F.arrow_udf(make, "n long, node long" + (", tokens array<bigint>" if field is not None else "")).asNondeterministic()(text)


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Least number of shared tokens of linked sets of these sizes."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _fits(a: str, b: str, percent: int) -> Column:
    """Sizes and places of a shared token let the sets be linked."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (left >= _least_overlap(n_a, n_b, percent))


def _spots(rows: DataFrame, node: str) -> DataFrame:
    """A row for each prefix token of a set, with its place."""
    more = ["members"] if "members" in rows.columns else []
    return rows.select(F.col(node).alias("node"), "n", "alone", *more, F.posexplode("prefix").alias("at", "token")).withColumn("place", F.col("at") + F.col("alone"))


def prefixed_sets(docs: DataFrame, text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Distinct sets that may have links: ``node``, ``n``, ``alone`` (tokens no other set has), ``tokens`` (the others by rarity), ``prefix``."""
    text = F.col(text_column)
    counted = docs.select(F.explode(counted_tokens(text, shingle)).alias("token")).groupBy("token").agg(F.count("*").alias("found"))
    field = bit_field(counted.filter(F.col("found") > 1))
    sets = docs.select(described(text, field, shingle, percent).alias("s")).select("s.*").filter(F.col("tokens").isNotNull())
    sets = cut(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    rows = sets.select("node", F.explode("tokens").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("found")).filter(F.col("found") > 1)
    ranked = rows.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("found", "token"))).alias("ranked"))
    sets = sets.select("node", "n").join(ranked, "node").select("node", "n", (F.col("n") - F.size("ranked")).alias("alone"), F.col("ranked.token").alias("tokens"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100) - F.lit(1e-9)) + 1 - F.col("alone")
    return cut(sets.withColumn("length", length.cast("int")).filter(F.col("length") > 0).select("node", "n", "alone", "tokens", F.slice("tokens", F.lit(1), F.col("length")).alias("prefix")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("t_a", "t_b")))
    return cut(both.filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b"))


def _covered(spots: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of sets to hubs of their tokens, and the spots whose pairs these links don't settle.

    In each of ``ROUNDS`` rounds the set with the least share of tokens of its own is a token's hub ``h``, and all others are compared with it. Let ``x`` and ``y`` be
    similar, the token the first they share, and all they share lie in ``h``, which is so if the tokens of ``x`` behind the token do: ``x`` is
    *covered*. Then ``y`` shares no less with ``h`` than with ``x``. So

    - ``y`` is similar to ``h`` if ``h`` is no larger than ``x``. If ``x`` is similar to ``h`` too, the hub connects the pair;
    - if ``x`` is smaller, that holds for all ``y`` that are similar to ``h``. Those that are not, but share enough for some set of the token's sizes, are
      *loose*; where a token has none, the hub connects all pairs of ``x``;
    - if ``x`` itself shares too little with ``h`` for any size (it is *weak*), it has no partner at the token.

    Such spots of ``x`` need no other partner, and neither do spots with too few tokens left. In a group of near copies one hub settles nearly all
    spots, in time that grows with the spots.
    """
    alive, found = spots, None
    for _ in range(ROUNDS):
        hubs = alive.groupBy("token").agg(F.min_by(F.struct("node", "n"), F.struct(F.col("place") - F.col("at"), "n", "node")).alias("hub"), F.min("n").alias("low"))
        near = alive.join(hubs, "token").filter(F.col("node") != F.col("hub.node"))
        need = _least_overlap(F.col("n"), F.greatest(F.col("low"), F.ceil(F.col("n") * F.lit(percent) / F.lit(100) - F.lit(1e-9))), percent)
        near = cut(near.withColumn("need", need).filter(F.col("n") - F.col("place") >= F.col("need")))
        sized = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
        pairs = near.filter(sized).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
        side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("t_a", "t_b"))).withColumn("other", F.array_except("t_a", "t_b"))
        # the place, from 0, of the last token that the hub lacks
        seen = cut(both.select("a", "b", "shared", (100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("linked"),
                               F.when(F.size("other") > 0, F.array_position("t_a", F.element_at("other", -1)) - 1).otherwise(F.lit(-1)).alias("last")))
        links = seen.filter("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = links if found is None else found.unionByName(links)
        of = seen.select(F.col("a").alias("node"), F.col("b").alias("hub_node"), "shared", "linked", "last")
        judged = near.withColumn("hub_node", F.col("hub.node")).join(of, ["node", "hub_node"], "left")
        covered, weak = F.col("last") < F.col("at"), F.col("shared") < F.col("need")
        judged = cut(judged.select(*spots.columns, F.coalesce(covered & (weak | (F.col("linked") & (F.col("n") >= F.col("hub.n")))), F.lit(False)).alias("settled"),
                                   F.coalesce(covered & F.col("linked"), F.lit(False)).alias("smaller"), F.coalesce(~F.col("linked") & ~weak, F.lit(True)).alias("loose")))
        open_ = judged.filter(~F.col("settled"))
        loose = judged.filter("loose").select("token", F.lit(True).alias("some_loose")).distinct()
        alive = cut(open_.join(loose, "token", "left").filter(~F.col("smaller") | F.col("some_loose").isNotNull()).select(*spots.columns))
    return found.distinct(), alive


def linked_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node`` and ``label`` of all sets that have links; labels are equal exactly where similar pairs connect the sets."""
    groups = sets.groupBy("n", "alone", "prefix").agg(F.min("node").alias("leader"), F.count("*").alias("members"))
    groups = cut(groups)
    inside = sets.join(groups, ["n", "alone", "prefix"]).filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b"))

    spots = _spots(groups, "leader")
    # Two hubs a token: the set with the least share of tokens of its own, and the leader of most members. Of the hubs that a leader's
    # tokens offer it takes two, so links grow with the sets; what they leave apart is the rest's.
    one = F.struct("node", "n", "place", (F.col("alone") / F.col("n")).alias("own"))
    hubs = spots.groupBy("token").agg(F.min_by(one, F.struct(F.col("alone") / F.col("n"), F.col("node"))).alias("plain"), F.max_by(one, F.struct("members", "node")).alias("large"), F.count("*").alias("found"))
    hubs = hubs.filter(F.col("found") > 1).select("token", "found", F.explode(F.array_distinct(F.array("plain", "large"))).alias("hub"))
    across = spots.select("token", F.struct("node", "n", "place").alias("spot")).join(hubs, "token").filter((F.col("hub.node") != F.col("spot.node")) & _fits("hub", "spot", percent))
    across = across.groupBy(F.col("spot.node").alias("node")).agg(F.min_by("hub.node", F.struct("hub.own", "hub.node")).alias("plain"), F.max_by("hub.node", F.struct("found", "hub.node")).alias("common"))
    across = across.select("node", F.explode(F.array_distinct(F.array("plain", "common"))).alias("hub")).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    first = verified(inside.unionByName(across).distinct(), sets, percent)

    known = least_labels(first)
    members = _spots(sets.select("node", "n", "alone", "prefix"), "node").join(known, "node", "left").select("token", "node", "n", "at", "place", F.coalesce("label", "node").alias("label"))
    members = cut(members)
    sizes = members.groupBy("token", "label").agg(F.count("*").alias("found"))
    main = sizes.groupBy("token").agg(F.max_by("label", F.struct("found", "label")).alias("main"), F.count("*").alias("labels")).filter(F.col("labels") > 1).select("token", "main")
    links, alive = _covered(members.join(main, "token"), sets, percent)
    few = alive.filter(F.col("label") != F.col("main")).select("token", F.struct("node", "n", "place", "label").alias("x"))
    every = alive.select("token", F.struct("node", "n", "place", "label").alias("y"))
    rest = few.join(every, "token").filter((F.col("x.label") != F.col("y.label")) & _fits("x", "y", percent))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    # What the rest connects are components already, so their labels take the place of the sets.
    late = verified(rest, sets, percent).unionByName(links)
    of = lambda x: known.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    named = late.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b"))
    joined = least_labels(named.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    ends = named.select(F.col("a").alias("node"), F.col("label_a").alias("label")).unionByName(named.select(F.col("b").alias("node"), F.col("label_b").alias("label")))
    return known.unionByName(ends).distinct().join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("label"))


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, ``n_shingles``, ``class_id`` (least key of the same set), ``component_id`` (least key that links reach)."""
    key = F.col(id_column)
    held = cut(docs.select(key, described(F.col(text_column), None, shingle).alias("s")).select(id_column, F.col("s.n").alias("n_shingles"), F.col("s.node").alias("node")))
    found = linked_sets(prefixed_sets(docs, text_column, shingle, percent), percent)
    classes = held.filter(F.col("n_shingles") > 0).groupBy("node").agg(F.min(id_column).alias("class_id"))
    linked = classes.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = linked.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = linked.join(least, "label").select("node", "class_id", "component_id")
    rows = held.join(named, "node", "left")
    own = F.col("n_shingles") == 0
    return rows.select(id_column, "n_shingles", F.when(own, key).otherwise(F.col("class_id")).alias("class_id"), F.when(own, key).otherwise(F.col("component_id")).alias("component_id"))


def linked_pairs(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every similar pair of distinct sets (``a`` < ``b``): pairs of groups that share a prefix token are filtered by size and place,
    expanded to their members and verified."""
    groups = cut(sets.groupBy("n", "alone", "prefix").agg(F.min("node").alias("leader"), F.count("*").alias("members")))
    members = cut(sets.join(groups, ["n", "alone", "prefix"]).select("leader", "node"))
    spots = _spots(groups, "leader")
    side = lambda x: spots.select("token", F.struct("node", "n", "place", "members").alias(x))
    near = side("x").join(side("y"), "token").filter((F.col("x.node") <= F.col("y.node")) & _fits("x", "y", percent))
    near = near.filter((F.col("x.node") != F.col("y.node")) | (F.col("x.members") > 1)).select(F.col("x.node").alias("g"), F.col("y.node").alias("h")).distinct()
    of = lambda group, x: members.select(F.col("leader").alias(group), F.col("node").alias(x))
    pairs = near.join(of("g", "x"), "g").join(of("h", "y"), "h").filter((F.col("g") != F.col("h")) | (F.col("x") < F.col("y")))
    return verified(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), sets, percent)


def similar_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per link of two distinct sets: ``class_a`` < ``class_b``, their least keys. Copies are not linked here, they share a class.
    The rows grow with the links, of which a large group of near copies has the square of its sets. A class whose keys are all null is named null, and stands as ``class_a``;
    a key that stands with several different texts names several classes."""
    held = docs.select(F.col(id_column).alias("id"), described(F.col(text_column), None, shingle).alias("s")).filter(F.col("s.n") > 0)
    classes = cut(held.groupBy(F.col("s.node").alias("node")).agg(F.min("id").alias("class_id")))
    of = lambda x: classes.select(F.col("node").alias(x), F.col("class_id").alias(f"class_{x}"))
    links = linked_pairs(prefixed_sets(docs, text_column, shingle, percent), percent).join(of("a"), "a").join(of("b"), "b")
    some = F.col("class_a").isNull() | F.col("class_b").isNull()
    return links.select(F.when(~some, F.least("class_a", "class_b")).alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))


# The query in SQL: shingles as text, all pairs that share one, and reachability.
OP8_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i: i + {SHINGLE - 1}], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= {PERCENT} * (x.n + y.n - o)),
ways as (select a, b from e union all select b, a from e),
reach as (select doc_id, doc_id as other from d union select r.doc_id, t.b from reach r join ways t on t.a = r.other),
c as (select doc_id, min(other) as component_id from reach group by doc_id),
f as (select doc_id, md5(string_agg(k, chr(10) order by k)) as f from s group by doc_id),
cl as (select doc_id, min(doc_id) over (partition by f) as class_id from f)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, coalesce(cl.class_id, d.doc_id) as class_id
from d left join n using (doc_id) join c using (doc_id) left join cl using (doc_id)
"""


@query("op8_ngram_jaccard", OP8_SQL)
def op8_ngram_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    """Components of similar documents."""
    return similar_documents(table(spark, directory, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


@query("op8_similar_pairs")
def op8_similar_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Every pair of similar classes of documents."""
    return similar_pairs(table(spark, directory, "documents"))


ship_by_value(__name__)
