"""Prefix trie of conversations by union-find over sorted neighbours.

Turns are known by 16-byte digests of role and text, a conversation by the bytes of its turns' digests in order: its key. Distinct keys are sorted by
ranges; the longest common prefixes (LCP) of neighbours, in turns, are edges. In a sorted partition they are taken in descending depth: joining two
components makes the node at that depth, or hangs one under the other's node of the same depth. What is not joined by an edge above is a chain of
nodes with a single child.

Partitions are merged across their borders by the LCP of the last key before and the first key behind a border. Only prefixes of a partition's first and
last key down to that depth stand in several partitions: these *open* nodes are all that is left of a partition's forest after
contraction, and they are added up by key. Every count is made to be additive: a node belongs to the first partition
in which it appears, which alone subtracts its one needed copy and counts it as a child.

How it runs: copies are counted before they are shuffled, so thousands of equal conversations are one key. A task holds the keys of its own partition
(16 bytes and a size a turn, no texts). The driver gets two depths a partition. The conversations that end at a node are joined to texts
of up to 4,096 ids (``IDS``), which a task streams through SHA-256 in order and never holds together.

Defined results: rows without a conversation id belong to no conversation and are left out. Turns are ordered by ``turn`` (null first), of equals by
digest; repeated rows are turns of their own. A null role or text is empty. A conversation without turns is a member of the root. No conversation, no
node. Other columns are not read, whatever their names. Role and text are told apart: a digest also takes the role's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..shipping import ship_by_value
from .registry import query, table

DIGEST = 16
# Ids that differ in the last so many bits only are joined to one text.
IDS = 12

NODE = ("open boolean, part int, key binary, parent_key binary, end_key binary, conv_id long, depth long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long")


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``, the digests and UTF-8 sizes of its turns in order."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(":", F.octet_length(r).cast("string"), r, t)))
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        # An array is sorted by its structs' fields in order, nulls first.
        F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns"))


def keyed(seqs: DataFrame) -> DataFrame:
    """``conv_id``, ``key`` (the digests side by side) and ``sizes``."""
    joined = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), ""))
    return seqs.select("conv_id", joined.alias("key"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    n = min(len(a), len(b)) // DIGEST * DIGEST
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


class Forest:
    """Nodes of sorted distinct keys: the first ``n`` are the keys' own, the others were made by joining components."""

    def __init__(self, keys: list[bytes], counts: list[int], least: list[int]):
        n = len(keys)
        self.depth = [len(k) // DIGEST for k in keys]
        self.parent: list[int] = [-1] * n
        self.count, self.least = list(counts), list(least)
        self.low, self.high = list(range(n)), list(range(n))
        links = [common(a, b) for a, b in zip(keys, keys[1:], strict=False)]
        leader, top, size = list(range(n)), list(range(n)), [1] * n

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        # Equal depths from left to right, so that only the left component can have a node at the edge's depth.
        for i in sorted(range(n - 1), key=lambda i: -links[i]):
            a, b = find(i), find(i + 1)
            left, right, depth = top[a], top[b], links[i]
            if self.depth[left] != depth:
                self.parent[left] = node = self.add(left, depth)
            else:
                node = left
            self.parent[right] = node
            self.count[node] += self.count[right]
            self.least[node] = min(self.least[node], self.least[right])
            self.high[node] = self.high[right]
            if size[a] < size[b]:
                a, b = b, a
            leader[b] = a
            size[a] += size[b]
            top[a] = node

    def add(self, child: int, depth: int) -> int:
        """A node above ``child``, so far with its members only."""
        for values in (self.count, self.least, self.low, self.high):
            values.append(values[child])
        self.depth.append(depth)
        self.parent.append(-1)
        return len(self.depth) - 1


def forest_rows(part: int, keys: list[bytes], sizes: list[list[int]], counts: list[int], least: list[int], left: int, right: int) -> Iterator[tuple]:
    """Rows of ``NODE`` for a partition. ``left`` and ``right`` are the LCP with the neighbours' nearest keys, -1 where there is none."""
    n = len(keys)
    f = Forest(keys, counts, least)
    nodes = len(f.depth)
    children, leaves, saved = [0] * nodes, [0] * nodes, [0] * nodes
    inner = set(f.parent)
    # Deeper nodes first, so children are complete before their parents.
    for x in sorted(range(nodes), key=lambda x: -f.depth[x]):
        up, key = f.parent[x], f.low[x]
        last, first = f.high[x] == n - 1, f.low[x] == 0
        above = f.depth[up] if up >= 0 else -1
        if x not in inner and not (last and right >= f.depth[x]):
            leaves[x] = 1
        total, own = saved[x], sizes[key]
        below = children[x]
        at_end = keys[x] if x < n else None
        for depth in range(f.depth[x], above, -1):
            size = own[depth - 1] if depth else 0
            mine = not (first and depth <= left)
            total += f.count[x] * size - (size if mine else 0)
            open_ = not mine or (last and depth <= right)
            open_above = depth > 0 and ((first and depth - 1 <= left) or (last and depth - 1 <= right))
            if depth - 1 > above or up < 0:
                parent = f.least[x] if depth else None
            else:
                parent = f.least[up]
                # The parent may be open although this node does not reach the partition's border.
                open_above = (f.low[up] == 0 and depth - 1 <= left) or (f.high[up] == n - 1 and depth - 1 <= right)
            yield (open_, part, keys[key][:DIGEST * depth] if open_ else None, keys[key][:DIGEST * (depth - 1)] if open_above else None,
                   at_end, f.least[x], depth, None if open_above else parent, f.count[x], below, leaves[x], total)
            below, at_end = int(mine), None
        if up >= 0:
            children[up] += below
            leaves[up] += leaves[x]
            saved[up] += total


def _digest(keys: list[bytes | None]) -> pa.Array:
    return pa.array([None if k is None else hashlib.md5(k).digest() for k in keys], pa.binary())


def _forests(borders: dict[int, tuple[int, int]]):
    """Sorted keys of a partition to its nodes' rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        keys, sizes, counts, least = (whole.column(c).to_pylist() for c in ("key", "sizes", "n", "least"))
        part = whole.column("part")[0].as_py()
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            is_open, parts, key, parent_key, end_key, *numbers = zip(*out, strict=True)
            columns = [pa.array(is_open, pa.bool_()), pa.array(parts, pa.int32()), _digest(key), _digest(parent_key), _digest(end_key),
                       *(pa.array(x, pa.int64()) for x in numbers)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODE.split(", ")])

        for row in forest_rows(part, keys, sizes, counts, least, *borders[part]):
            out.append(row)
            if len(out) == 10_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return build


def _borders(keys: DataFrame) -> dict[int, tuple[int, int]]:
    """LCP with the keys before and behind each partition that holds any; two numbers a partition."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, low, high, before, behind = (b.column(i).to_pylist() for i in range(5))
            left = [-1 if x is None else common(x, y) for x, y in zip(before, low, strict=True)]
            right = [-1 if x is None else common(x, y) for x, y in zip(behind, high, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["part", "l", "r"])

    ends = keys.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # One row a partition, so this window is as short as the list of partitions.
    order = Window.orderBy("part")
    near = ends.select("part", "low", "high", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("behind"))
    return {r["part"]: (r["l"], r["r"]) for r in near.mapInArrow(shared, "part int, l int, r int").collect()}


def _ends(members: DataFrame) -> DataFrame:
    """``end_key`` and ``ends_sha256``, over the ids of all conversations of that key in ascending order, comma-joined."""
    ranges = members.select(F.unhex(F.md5("key")).alias("end_key"), F.shiftright("conv_id", IDS).alias("range"), "conv_id")
    texts = ranges.groupBy("end_key", "range").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for b in batches:
            done: list[tuple] = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["end_key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["end_key", "ends_sha256"])

    ordered = texts.repartition("end_key").sortWithinPartitions("end_key", "range").select("end_key", "ids")
    return ordered.mapInArrow(fold, "end_key binary, ends_sha256 string")


def prefix_trie(members: DataFrame) -> DataFrame:
    """One row per node of the trie of ``members`` (``conv_id``, ``key``, ``sizes``; see ``keyed``).

    ``conv_id`` is the smallest member; ``parent_conv_id`` the parent's; ``n_convs`` members; ``n_children``; ``n_leaves`` childless nodes of the subtree;
    ``saved_tokens`` the UTF-8 bytes that the subtree's nodes save by being stored once; ``ends_sha256`` over the members that end here.
    """
    members = cut(members)
    distinct = members.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("sizes").alias("sizes"))
    ordered = distinct.repartitionByRange("key").sortWithinPartitions("key")
    keys = cut(ordered.withColumn("part", F.spark_partition_id()))
    found = cut(keys.select("part", "key", "sizes", "n", "least").mapInArrow(_forests(_borders(keys)), NODE))

    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    opened = found.filter("open")
    merged = cut(opened.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        F.max("end_key").alias("end_key"), *(F.sum(c).alias(c) for c in sums)))
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    upper = merged.join(names, "parent_key", "left")
    # Nodes below an open one look it up by their own partition, so that the root's many children are spread.
    local = opened.select("part", F.col("key").alias("parent_key")).join(names, "parent_key").withColumnRenamed("parent_conv_id", "above")
    lower = found.filter("not open").join(local, ["part", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "end_key"]
    nodes = lower.select(*columns).unionByName(upper.select(*columns))
    nothing = hashlib.sha256().hexdigest()
    # Most nodes are no end; they pass the join by keys of their own.
    ending = nodes.filter(F.col("end_key").isNotNull()).join(_ends(members), "end_key", "left")
    inner = nodes.filter(F.col("end_key").isNull()).withColumn("ends_sha256", F.lit(nothing))
    out = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    return ending.select(*out).unionByName(inner.select(*out))


def grafted(seqs: DataFrame) -> DataFrame:
    """Conversations as the contract rebuilds them: the first turns of conversation ``c - c % 5``, as many as a hash of ``c`` says, then the own ones."""
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    heads = seqs.select(F.col("conv_id").alias("head"), F.slice("turns", 1, 8).alias("of_head"))
    rows = seqs.withColumn("head", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", h.cast("int")).join(heads, "head", "left")
    start = F.when(F.col("h") > 0, F.slice(F.coalesce("of_head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(start, own).alias("turns"))


SQL = r"""
with recursive bits as (select i::bigint as i, i::bigint as c, 0 as k from range(256) t(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc_table as (select i, c from bits where k = 8),
ids as (select distinct conv_id as c, cast(conv_id as varchar) as s from conversations where conv_id is not null),
crc as (select c, s, 4294967295::bigint as v, 0 as k from ids
  union all select r.c, r.s, xor(r.v >> 8, t.c), r.k + 1 from crc r join crc_table t on t.i = xor(r.v, ascii(substr(r.s, r.k + 1, 1))) & 255 where r.k < length(r.s)),
heads as (select c, xor(v, 4294967295) % 9 as h from crc where k = length(s)),
turns as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as t,
  row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) as i from conversations where conv_id is not null),
rebuilt as (select h.c, t.i, t.r, t.t from heads h join turns t on t.c = h.c - h.c % 5 and t.i <= h.h
  union all select h.c, t.i, t.r, t.t from heads h join turns t on t.c = h.c and t.i > h.h),
placed as (select c, row_number() over (partition by c order by i) as d, r, t from rebuilt),
sequences as (select i.c, coalesce(list({'r': p.r, 't': p.t} order by p.d) filter (where p.d is not null), []) as q from ids i left join placed p on p.c = i.c group by i.c),
members as (select c, u.d as d, q[1:u.d] as k, len(q) as n from sequences, lateral (select unnest(range(0, len(q) + 1)) as d) u),
numbered as (select c, d, n, k, min(c) over (partition by d, k) as node, count(*) over (partition by d, k) as convs from members),
nodes as (select node, d, any_value(k) as k, any_value(convs) as convs, list(c order by c) filter (where n = d) as ends from numbered group by node, d),
own as (select node, d, convs, case when d = 0 then 0 else (convs - 1) * strlen(k[d].t) end as saved, coalesce(ends, []) as ends from nodes),
parents as (select o.*, m.node as parent from own o left join numbered m on m.c = o.node and m.d = o.d - 1),
leaves as (select p.*, (select count(*) from parents x where x.parent = p.node and x.d = p.d + 1) as children from parents p),
subtree as (select m.node, m.d, sum(l.saved) as saved, count(*) filter (where l.children = 0) as leaves from leaves l join numbered m on m.c = l.node and m.d <= l.d group by m.node, m.d)
select l.node as conv_id, l.d::bigint as depth, l.parent as parent_conv_id, l.convs as n_convs, l.children as n_children, s.leaves as n_leaves,
  s.saved::bigint as saved_tokens, sha256(array_to_string(l.ends, ',')) as ends_sha256
from leaves l join subtree s on s.node = l.node and s.d = l.d
"""


@query("op13_prefix_trie", SQL)
def op13_prefix_trie(spark: SparkSession, directory: str) -> DataFrame:
    """Prefix trie of all conversations after grafting."""
    return prefix_trie(keyed(grafted(sequences(table(spark, directory, "conversations")))))


ship_by_value(__name__)
