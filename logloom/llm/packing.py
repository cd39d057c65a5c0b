"""Packing token ids into windows of a fixed length, with the mixture of sources under control.

Every source is a queue of its documents' ids. Windows are filled by deficit round-robin: a round adds to each queue's deficit its share of the window,
in exact integers; a queue serves as many ids as its deficit has whole ones; what rounding leaves open goes to the queues of the
largest deficits, which then owe it. A queue that runs dry leaves its share to the others and its deficit is void. So every window has the target
mixture as closely as whole ids allow, as long as the queues last.

No task walks through all windows. The same rounds are run on a tree: the corpus is dealt to spans of ``64^k`` windows, each span's ids to its spans of
``64^(k-1)``, down to windows. A span gets exactly the ids its parent dealt to it, so deficits are carried across the spans of a node and what a
span starts with is known from the path above. A task derives only the nodes that its own documents fall into.

A position in a queue, and so a window and a place in it, follows from three numbers: ids of the queue in earlier tasks, ids of the queue earlier in the task,
and the place in the document. Encoded rows are written once to the shared folder, with the number of the task that wrote them; retried tasks read the same
rows. The totals by task and queue are at most ``TOTALS`` numbers, as there are at most ``QUEUES`` queues and inputs in more splits are coalesced;
they are broadcast. No ids are shuffled.

Ids that fill no whole window are cut into windows of powers of two, the only shorter ones that need no padding. So nothing is padded.

Defined results: a null text is an empty one, of the end id alone. A null source is a queue of its own. If there are more than ``QUEUES`` sources, the most
frequent ones (ties by name) have queues and the rest shares one. Repeated rows are packed each on its own. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .bpe import Encoder, load, text_groups, word_vocabulary
from .flat import tidy
from .registry import query, table
from .shared import shared_folder

WINDOW = 4096
END_ID = 2
QUEUES = 64
TOTALS = 1 << 20
FAN = 64
# Numbers of the tree that a task remembers.
KNOWN = 1 << 18

PIECE_TYPE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def deal(stock: list[int], weights: list[int], sizes: list[int]) -> list[list[int]]:
    """Ids that each queue serves to each span, by deficit round-robin; the spans' ``sizes`` add up to the stock."""
    left, debt, scale, out = list(stock), [0] * len(stock), 0, []
    for size in sizes:
        served, room = [0] * len(stock), size
        while room:
            live = [s for s, n in enumerate(left) if n]
            share = {s: weights[s] for s in live}
            if not any(share.values()):
                # Only queues without a target are left; they go by what they hold.
                share = {s: left[s] for s in live}
            total = sum(share.values())
            if total != scale:
                # Deficits count in parts of 1/total of an id.
                debt = [d * total // scale if scale else 0 for d in debt]
                scale = total
            granted, dry = room, False
            for s in live:
                debt[s] += granted * share[s]
                n = min(left[s], room, max(0, debt[s] // total))
                served[s], left[s], debt[s], room = served[s] + n, left[s] - n, debt[s] - n * total, room - n
                if not left[s]:
                    debt[s], dry = 0, True
            if dry:
                continue
            for s in cycle(sorted(live, key=lambda s: (-debt[s], s))):
                if not room:
                    break
                if left[s] and share[s]:
                    served[s], left[s], debt[s], room = served[s] + 1, left[s] - 1, debt[s] - total, room - 1
                elif not any(left[x] and share[x] for x in live):
                    break
        out.append(served)
    return out


class Schedule:
    """Where each id of each queue goes."""

    def __init__(self, totals: list[int], weights: list[int], window: int = WINDOW):
        self.weights, self.window, self.queues = weights, window, len(totals)
        self.windows, rest = divmod(sum(totals), window)
        self.full, tail = deal(totals, weights, [self.windows * window, rest])
        self.levels = 1
        while FAN ** self.levels < self.windows:
            self.levels += 1
        self.known: OrderedDict[tuple[int, int], list[list[int]]] = OrderedDict()
        self.tail_sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail = self.borders(self.full, deal(tail, weights, self.tail_sizes))
        # The window a queue is in: (its first id, the id behind its last one, window, place of the first id, window's length).
        self.at = [(0, 0, 0, 0, 0)] * self.queues

    def borders(self, start: list[int], dealt: list[list[int]]) -> list[list[int]]:
        """Positions in each queue where the spans begin, and where the last one ends."""
        out = [start]
        for row in dealt:
            out.append([a + n for a, n in zip(out[-1], row, strict=True)])
        return out

    def spans(self, level: int, number: int) -> list[list[int]]:
        """Borders of the spans below a node; a node of level 1 holds windows."""
        found = self.known.get((level, number))
        if found is not None:
            self.known.move_to_end((level, number))
            return found
        if level == self.levels:
            start, stock = [0] * self.queues, self.full
        else:
            above = self.spans(level + 1, number // FAN)
            start, end = above[number % FAN], above[number % FAN + 1]
            stock = [b - a for a, b in zip(start, end, strict=True)]
        first, each = number * FAN ** level, FAN ** (level - 1)
        last = min(self.windows, first + FAN ** level)
        sizes = [min(each, last - w) * self.window for w in range(first, last, each)]
        self.known[level, number] = found = self.borders(start, deal(stock, self.weights, sizes))
        if len(self.known) * (FAN + 1) * self.queues > KNOWN:
            self.known.popitem(last=False)
        return found

    @staticmethod
    def span_of(borders: list[list[int]], queue: int, position: int) -> int:
        """The last span that begins at or before a position; empty ones before it are passed over."""
        low, high = 0, len(borders) - 2
        while low < high:
            half = (low + high + 1) // 2
            if borders[half][queue] <= position:
                low = half
            else:
                high = half - 1
        return low

    def place(self, queue: int, position: int) -> tuple[int, int, int, int]:
        """(window, place in it, ids of the queue from here to the window's end, the window's length) of an id."""
        begin, end, window, place, length = self.at[queue]
        if not begin <= position < end:
            if position >= self.full[queue]:
                borders = self.tail
                n = self.span_of(borders, queue, position)
                window, length = self.windows + n, self.tail_sizes[n]
            else:
                number = 0
                for level in range(self.levels, 0, -1):
                    borders = self.spans(level, number)
                    n = self.span_of(borders, queue, position)
                    number = number * FAN + n
                window, length = number, self.window
            begin, end = borders[n][queue], borders[n + 1][queue]
            place = sum(borders[n + 1][s] - borders[n][s] for s in range(queue))
            self.at[queue] = begin, end, window, place, length
        return window, place + position - begin, end - position, length


def _queue_names(keys: DataFrame) -> list[str]:
    """Keys of the queues but for the shared one, which is there if these are not all; at most ``QUEUES`` rows come to the driver."""
    found = [r["key"] for r in keys.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(QUEUES + 1).collect()]
    return sorted(found if len(found) <= QUEUES else found[:QUEUES - 1])


def _encoding(vocabulary: Broadcast, queues: int, end_id: int):
    """Rows of (id, queue, text) to rows of (id, part, queue, before, n, ids): little-endian 32-bit ids, and the ids of the queue earlier in the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder(pickle.loads(vocabulary.value)), TaskContext.get().partitionId(), np.zeros(queues, np.int64)
        for b in batches:
            row = 0
            for group in text_groups(b.column("text").to_pylist()):
                ids, counts = encoder.encode_all(group)
                ends = np.cumsum(counts + 1)
                flat = np.full(int(ends[-1]), end_id, "<u4")
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = ids
                own = b.slice(row, len(group))
                queue, n = own.column("queue").to_numpy(), counts + 1
                earlier = np.zeros(len(group), np.int64)
                for q in np.unique(queue):
                    mine = queue == q
                    sums = before[q] + np.cumsum(n[mine])
                    earlier[mine] = sums - n[mine]
                    before[q] = sums[-1]
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int64)
                held = pa.Array.from_buffers(pa.large_binary(), len(group), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())
                columns = [own.column("id"), pa.array(np.full(len(group), part, np.int32)), own.column("queue"), pa.array(earlier), pa.array(n), held]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "queue", "before", "n", "ids"])
                row += len(group)
        tidy()

    return encode


def _cutting(starts: Broadcast, totals: list[int], weights: list[int], window: int):
    """Encoded rows to pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, first = Schedule(totals, weights, window), starts.value
        for b in batches:
            out: list[tuple] = []
            rows: list[int] = []
            part, queue, before, n = (b.column(c).to_numpy().tolist() for c in ("part", "queue", "before", "n"))
            ids = b.column("ids")
            for i, size in enumerate(n):
                q = queue[i]
                position, at, held = int(first[part[i], q]) + before[i], 0, memoryview(ids[i].as_buffer())
                while at < size:
                    sequence, offset, room, length = schedule.place(q, position + at)
                    end = min(size, at + room)
                    out.append((at, end - at, zlib.crc32(held[4 * at: 4 * end]), size, sequence, offset, length))
                    rows.append(i)
                    at = end
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), *columns], names=["id", *(c.split()[0] for c in PIECE_TYPE.split(", "))])

    return pieces


def pack(docs: DataFrame, vocabulary: Broadcast, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
         targets: dict[str | None, float] | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: key, ``start`` and ``length`` in the document's ids, ``ids_crc32``, ``doc_tokens``, the window ``sequence_id``, the place ``offset``
    in it and its length ``sequence_length``.

    ``targets`` are the sources' shares of a window; sources without one come when the others have run dry. By default the
    shares of all ids, so that all queues last to the end. ``window`` is a power of two.
    """
    spark = docs.sparkSession
    key = F.when(F.col(source_column).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_column).cast("string")))
    names = _queue_names(docs.select(key.alias("key")))
    queues = len(names) + 1
    number = F.array_position(F.array(*(F.lit(x) for x in names)), key) if names else F.lit(0)
    rows = docs.select(F.col(id_column).alias("id"), F.when(number > 0, number - 1).otherwise(queues - 1).cast("int").alias("queue"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    folder = shared_folder(spark, "packing")
    encoded = rows.coalesce(TOTALS // queues).mapInArrow(_encoding(vocabulary, queues, end_id), f"id {id_type}, part int, queue int, before long, n long, ids binary")
    encoded.write.option("compression", "zstd").parquet(folder)
    held = spark.read.parquet(folder)

    sums = held.groupBy("part", "queue").agg(F.sum("n").alias("n")).toPandas()
    by_part = np.zeros((int(sums["part"].max()) + 1 if len(sums) else 1, queues), np.int64)
    by_part[sums["part"], sums["queue"]] = sums["n"]
    totals = [int(x) for x in by_part.sum(axis=0)]
    shares = totals
    if targets is not None:
        most = max(targets.values())
        wanted = {"n" if k is None else f"s{k}": round((1 << 30) * v / most) for k, v in targets.items()}
        shares = [wanted.get(x, 0) for x in names] + [0]
    starts = spark.sparkContext.broadcast(np.cumsum(by_part, axis=0) - by_part)
    found = held.mapInArrow(_cutting(starts, totals, shares, window), f"id {id_type}, {PIECE_TYPE}")
    return found.withColumnRenamed("id", id_column)


@query("op11_packing")
def op11_packing(spark: SparkSession, directory: str) -> DataFrame:
    """All documents packed into windows of 4096 ids in the mixture of the corpus."""
    return pack(table(spark, directory, "documents"), load(spark, word_vocabulary()))


ship_by_value(__name__)
