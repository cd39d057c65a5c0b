"""BPE encoding and decoding: speculate, verify, repair.

Texts are cut into words (letters, single digits, other signs, a few contractions) with vector operations over code points.
Each distinct word of a task is encoded once:

1. speculate: greedy longest match from the left proposes tokens;
2. verify: a token sequence is what merging gives if every token alone merges to itself and every two neighbours are
   compatible, that is, no merge crosses the border between them. All distinct neighbours of a batch are tested together;
3. repair: only words that fail are merged pair by pair.

Compatibility is decided by going back in time from the two finished tokens: as long as nothing crosses the border, the pieces
that touch it are nodes on the right edge of the left token's merge tree and on the left edge of the right one's. A
crossing merge would have to join two such pieces while both exist.

The work is local to a row: no shuffle. The vocabulary is broadcast (its size is fixed by the tokenizer). The table of known
words is emptied when it holds ``KNOWN_WORDS``; this bounds memory and changes no result.

Defined results: a null text is encoded as an empty one, to no ids; null ids are decoded to null, no ids to an empty text. Ids
that the vocabulary lacks are left out of a decoded text. Special tokens that stand in a text are kept whole, as the
tokenizer's own library does by default. Repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .flat import STEP, Hasher, mixed, powers, sums_between, tidy
from .registry import query, table

KNOWN_WORDS = 500_000
TEXT_PIECE = 500_000
# Words of more bytes are merged one by one with a heap.
LONG_WORD = 48
END = "</w>"
END_MARK = np.uint64(0x5851F42D4C957F2D)

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
# Ranges that the tokenizer's library holds for letters and digits, assigned after Unicode 15.1.
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
LATER_DIGITS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# Ranges of later capitals in that library, and how far their small letters are.
LATER_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27)]
_SMALL = {chr(c): chr(c + far) for a, b, far in LATER_CAPITALS for c in range(a, b + 1)}
_CAPITAL = re.compile(f"[{''.join(_SMALL)}]")
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def _kinds() -> np.ndarray:
    """Kind of every code point."""
    first = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = SPACE
    for kind, ranges in ((LETTER, LATER_LETTERS), (DIGIT, LATER_DIGITS)):
        for a, b in ranges:
            out[a: b + 1] = kind
    return out


def _byte_names() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(others)) for b in range(256)]


class Table:
    """Numbers by distinct 64-bit hashes, looked up many at a time; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two keys share a hash")
        self.bits, self.used = max(4, int(4 * len(keys)).bit_length()), 0
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in the table yet."""
        self.used += len(keys)
        if 2 * self.used > 1 << self.bits:
            held = self.values >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self.bits = int(4 * self.used).bit_length()
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        at = self.place(keys)
        while len(at):
            free = self.values[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        out = self.values[at]
        off = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            out[off] = self.values[at[off]]
            off = off[(out[off] >= 0) & (self.keys[at[off]] != keys[off])]
        return out


class Vocabulary:
    """Tables of a word-end BPE tokenizer in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.ids: dict[str, int] = vocab
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = [None] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        n = len(self.names)
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            self.merged.setdefault((x, y), (r, i))
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = r, x, y
        self.by_rank = np.full(len(pairs), -1, np.int64)
        for r, i in self.merged.values():
            self.by_rank[r] = i
        keys = np.array([x * n + y for x, y in self.merged], np.uint64)
        self.pairs = Table(mixed(keys + np.uint64(1)), np.array([r for r, _ in self.merged.values()], np.int64))
        self.byte_names = _byte_names()
        self.atoms = np.array([vocab[c] for c in self.byte_names], np.int64)
        self.last_atoms = np.array([vocab[c + END] for c in self.byte_names], np.int64)
        self.hasher = Hasher()
        byte_of = {c: b for b, c in enumerate(self.byte_names)}
        names = [(bytes(byte_of[c] for c in k.removesuffix(END)), k.endswith(END) and k != END) for k in vocab]
        self.by_bytes = dict(zip(names, vocab.values(), strict=True))
        borders = np.concatenate([[0], np.cumsum([len(b) for b, _ in names])])
        sums = self.hasher.sums(np.frombuffer(b"".join(b for b, _ in names), np.uint8))
        ends = np.array([e for _, e in names])
        self.tokens = Table(self.hasher.ranges(sums, borders[:-1], borders[1:]) + np.where(ends, END_MARK, np.uint64(0)), np.array([*vocab.values()], np.int64))
        self.longest = int(np.diff(borders).max())
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(n, bool)
        sound[made] = self.untouched(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        self.sound = sound
        self.kinds = _kinds()

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens, -1 if there is none."""
        return self.pairs.get(mixed((x * len(self.names) + y).astype(np.uint64) + np.uint64(1)))

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """Token ids by hash of their bytes, -1 where there is none."""
        return self.tokens.get(hashes)

    def untouched(self, x: np.ndarray, y: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge of a rank under ``until`` crosses the border between tokens ``x`` and ``y``."""
        fine = np.ones(len(x), bool)
        at = np.arange(len(x))
        x_until, y_until = until.copy(), until.copy()
        while len(at):
            q = self.pair_rank(x, y)
            rx, ry = self.rank[x], self.rank[y]
            # At equal ranks the leftmost pair goes first.
            crossed = (q > np.maximum(rx, ry)) & (q < x_until) & (q <= y_until) & (q < until)
            fine[at[crossed]] = False
            back = ~crossed & (np.maximum(rx, ry) >= 0)
            at, x, y, x_until, y_until, until, rx, ry = (v[back] for v in (at, x, y, x_until, y_until, until, rx, ry))
            undo_x = rx > ry
            x_until, y_until = np.where(undo_x, rx, x_until), np.where(undo_x, y_until, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return fine

    def greedy(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest tokens from the left for all words at once: a token id at the byte where each starts, else -1; and the
        words that no tokens cover. ``first`` are the words' borders in ``data``."""
        out, lost = np.full(len(data), -1, np.int64), []
        for i in np.flatnonzero(np.diff(first) > LONG_WORD):
            self.greedy_long(data[first[i]: first[i + 1]].tobytes(), out[first[i]: first[i + 1]])
        word = np.flatnonzero(np.diff(first) <= LONG_WORD)
        at, end = first[:-1][word], first[1:][word]
        sums = self.hasher.sums(data)
        size = np.minimum(end - at, self.longest)
        while len(word):
            stop = at + size
            found = self.ids_of(self.hasher.ranges(sums, at, stop) + np.where(stop == end, END_MARK, np.uint64(0)))
            hit = found >= 0
            out[at[hit]] = found[hit]
            at = np.where(hit, stop, at)
            size = np.where(hit, np.minimum(end - at, self.longest), size - 1)
            lost.append(word[(size == 0) & (at < end)])
            go = size > 0
            word, at, end, size = word[go], at[go], end[go], size[go]
        return out, np.concatenate([np.zeros(0, np.int64), *lost])

    def greedy_long(self, word: bytes, out: np.ndarray) -> None:
        """As ``greedy`` for one long word; single bytes are always tokens."""
        at, n = 0, len(word)
        while at < n:
            stop = next(j for j in range(min(n, at + self.longest), at, -1) if (word[at:j], j == n) in self.by_bytes)
            out[at] = self.by_bytes[word[at:stop], stop == n]
            at = stop

    def merge(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Merge the best pair of every word, the leftmost of equals, until none is left. A token id where each starts, else -1."""
        out = np.full(len(tokens), -1, np.int64)
        place, word = np.arange(len(tokens)), np.repeat(np.arange(len(first) - 1), np.diff(first))
        none = np.int64(1 << 60)

        def ranks(at: np.ndarray) -> np.ndarray:
            found = np.full(len(at), none)
            inner = np.flatnonzero(at + 1 < len(tokens))
            inner = inner[word[at[inner]] == word[at[inner] + 1]]
            r = self.pair_rank(tokens[at[inner]], tokens[at[inner] + 1])
            found[inner] = np.where(r < 0, none, r)
            return found

        rank = ranks(np.arange(len(tokens)))
        while len(tokens):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            open_ = best < none
            if not open_.all():
                out[place[~open_]] = tokens[~open_]
                tokens, place, word, rank, best = (v[open_] for v in (tokens, place, word, rank, best))
                if not len(tokens):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.diff(word[at], prepend=-1) != 0]
            tokens[at] = self.by_rank[rank[at]]
            held = np.ones(len(tokens), bool)
            held[at + 1] = False
            tokens, place, word, rank = (v[held] for v in (tokens, place, word, rank))
            at = at - np.arange(len(at))
            rank[at] = ranks(at)
            before = at[(at > 0)] - 1
            before = before[word[before] == word[before + 1]]
            rank[before] = ranks(before)
        return out

    def merge_long(self, tokens: list[int]) -> list[int]:
        """As ``merge`` for one word of any length, in time n log n."""
        n, merged = len(tokens), self.merged
        tokens, after, before = list(tokens), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merged[p][0], i, p) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in merged]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != pair[0] or j >= n or tokens[j] != pair[1]:
                continue
            tokens[i], tokens[j] = merged[pair][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (tokens[x], tokens[y]) in merged:
                    heapq.heappush(heap, (merged[tokens[x], tokens[y]][0], x, (tokens[x], tokens[y])))
        return [t for t in tokens if t >= 0]

    def encode_words(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of each word's ids. ``first``: the words' borders in ``data``."""
        n = len(first) - 1
        word = np.repeat(np.arange(n), np.diff(first))
        out, lost = self.greedy(data, first)
        failed = np.zeros(n, bool)
        failed[lost] = True
        at = np.flatnonzero(out >= 0)
        failed[word[at[~self.sound[out[at]]]]] = True
        next_to = np.flatnonzero(word[at[1:]] == word[at[:-1]])
        key, back = np.unique(out[at[next_to]] * len(self.names) + out[at[next_to + 1]], return_inverse=True)
        fine = self.untouched(key // len(self.names), key % len(self.names), np.full(len(key), len(self.by_rank) + 1))
        failed[word[at[next_to[~fine[back]]]]] = True

        atoms = self.atoms[data]
        atoms[first[1:] - 1] = self.last_atoms[data[first[1:] - 1]]
        long = failed & (np.diff(first) > LONG_WORD)
        short = (failed & ~long)[word]
        borders = np.concatenate([[0], np.cumsum(np.diff(first)[failed & ~long])])
        out[short] = self.merge(atoms[short], borders)
        for i in np.flatnonzero(long):
            ids = self.merge_long(atoms[first[i]: first[i + 1]].tolist())
            out[first[i]: first[i + 1]] = -1
            out[first[i]: first[i] + len(ids)] = ids
        at = out >= 0
        return out[at], sums_between(at, first)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + count[0] - 1, start[1], ..."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - count), count)


class Encoder:
    """Encodes texts and remembers words; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.up = self.down = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.slots, self.known = Table(np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, hashes: np.ndarray, points: np.ndarray, size: np.ndarray) -> None:
        """Encode new words; ``points`` are their code points one after the other, ``size`` the number of each word's."""
        data = np.frombuffer(points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        width = sums_between(width, np.concatenate([[0], np.cumsum(size)]))
        flat, counts = self.v.encode_words(data, np.concatenate([[0], np.cumsum(width)]))
        n, k = self.known, len(size)
        while len(self.start) < n + k:
            self.start, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.count))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used: self.used + len(flat)] = flat
        self.start[n: n + k] = self.used + np.cumsum(counts) - counts
        self.count[n: n + k] = counts
        self.used += len(flat)
        self.slots.add(hashes, np.arange(n, n + k))
        self.known += k

    def words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the words among code points."""
        kind = self.v.kinds[points]
        opens = np.ones(len(points), bool)
        opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(points))
        held = kind[start] != SPACE
        start, end = start[held], end[held]
        # 's 't 'm 'd 're 've 'll at the start of a run of signs are words.
        lone = np.flatnonzero((points[start] == 0x27) & (end - start == 1))
        if len(lone):
            padded = np.append(points, [0, 0])
            a, b = padded[start[lone] + 1], padded[start[lone] + 2]
            pair = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
            two = np.isin(pair, [ord(s[0]) << 32 | ord(s[1]) for s in ("re", "ve", "ll")])
            taken = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, np.where(two, 2, 0))
            grown = lone[taken > 0]
            if len(grown):
                end[grown] += taken[taken > 0]
                start[grown + 1] = end[grown]
                held = start < end
                start, end = start[held], end[held]
        return start, end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids. Special tokens don't stand in them."""
        lowered = []
        for t in texts:
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")
                t = _CAPITAL.sub(lambda m: _SMALL[m[0]], t)
            lowered.append(t.lower())
        joined = "\n".join(lowered)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        borders = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        start, end = self.words(points)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(points) >= len(self.up):
            self.up, self.down = powers(_BASE, len(points) + 1), powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * self.up[: len(points)], out=sums[1:])
        hashes = mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * STEP)
        if self.known > KNOWN_WORDS:
            self.forget()
        slot = self.slots.get(hashes)
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            new, at = np.unique(hashes[lost], return_index=True)
            s, size = start[lost[at]], (end - start)[lost[at]]
            self.learn(new, points[_ranges(s, size)], size)
            slot[lost] = self.slots.get(hashes[lost])
        count = self.count[slot]
        ids = self.flat[_ranges(self.start[slot], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.searchsorted(start, borders)])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts in which special tokens may stand."""
        special = self.v.special
        if not any(s in t for t in texts for s in special):
            return self.encode(texts)
        cut = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
        parts, owner = [], []
        for i, t in enumerate(texts):
            at = 0
            for m in cut.finditer(t):
                parts += [t[at: m.start()], m.group()]
                owner += [i, i]
                at = m.end()
            parts.append(t[at:])
            owner.append(i)
        plain = [k for k, p in enumerate(parts) if p not in special]
        ids, counts = self.encode([parts[k] for k in plain])
        pieces = dict(zip(plain, np.split(ids, np.cumsum(counts)[:-1]), strict=True))
        held = [pieces[k] if k in pieces else np.array([special[p]], np.int32) for k, p in enumerate(parts)]
        return np.concatenate(held), np.bincount(owner, weights=[len(h) for h in held], minlength=len(texts)).astype(np.int64)


def text_groups(texts: list[str], most: int = TEXT_PIECE) -> Iterator[list[str]]:
    """Successive texts of about ``most`` characters together; a longer one alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def load(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for ``encoded`` and ``decoded``; a few MB whatever the data. Pickled by value, see ``shipping``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(Vocabulary(path)))


def _id_lists(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for group in text_groups(texts.fill_null("").to_pylist()):
        i, c = encoder.encode_all(group)
        ids.append(i)
        counts.append(c)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))


def _texts(lists: pa.ListArray, names: pa.Array) -> pa.Array:
    flat = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names))), False)
    tokens = names.take(pc.if_else(known, flat, pa.scalar(None, pa.int32())))
    own = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), tokens)
    text = pc.binary_join(own, " ") if not tokens.null_count else pa.array([" ".join(t for t in x if t is not None) for x in own.to_pylist()], pa.string())
    return pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string()))


def encoded(text: str | Column, vocabulary: Broadcast) -> Column:
    """Ids of a whole text."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(pickle.loads(vocabulary.value))
        for batch in batches:
            yield _id_lists(encoder, batch)
        tidy()

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<int>")(text)


def decoded(ids: str | Column, vocabulary: Broadcast) -> Column:
    """Text of ids: the tokens' names with a space between them, as the tokenizer has no decoder of its own."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array(pickle.loads(vocabulary.value).names, pa.string())
        for batch in batches:
            yield _texts(batch, names)
        tidy()

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "string")(ids)


def there_and_back(text: str | Column, vocabulary: Broadcast) -> Column:
    """Struct of ``ids`` and ``decoded`` of a whole text."""

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(pickle.loads(vocabulary.value))
        names = pa.array(encoder.v.names, pa.string())
        for batch in batches:
            lists = _id_lists(encoder, batch)
            yield pa.StructArray.from_arrays([lists, _texts(lists, names)], ["ids", "decoded"])
        tidy()

    both.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(both, "ids array<int>, decoded string")(text)


def round_trip(docs: DataFrame, vocabulary: Broadcast, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: key, ``ids`` of its whole text, and ``decoded``, the text of these ids. Both in one Python worker."""
    return docs.select(F.col(id_column), there_and_back(F.col(text_column), vocabulary).alias("b")).select(id_column, "b.*")


def word_vocabulary() -> str:
    """Where the public tokenizer of the registered query lies."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_bpe")
def op2_bpe(spark: SparkSession, directory: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and text."""
    rows = round_trip(table(spark, directory, "documents"), load(spark, word_vocabulary()))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


ship_by_value(__name__)
