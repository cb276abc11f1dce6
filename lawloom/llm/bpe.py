"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

1. Spark counts the pre-tokens of all documents; the most frequent ones, with
   their token ids, are compiled into a minimal acyclic automaton whose states
   share suffixes.  Walking a word adds up the words that come before it, and
   that number addresses the word's ids.
2. The automaton is one flat file, shipped with ``SparkContext.addFile`` and
   memory-mapped by every Python worker.
3. Words outside the lexicon are merged exactly, by rank, with a heap.
"""

from __future__ import annotations

import atexit
import heapq
import json
import mmap
import os
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Frequent words that the lexicon takes; it bounds what the driver gathers and ships.
LEXICON_WORDS = 60_000
#: Distinct words that a worker counts, and words that it remembers, before it starts afresh.
COUNTED_WORDS, MEMO_WORDS = 150_000, 250_000
#: Rows whose ids are turned into text in one vector pass.
ROWS_DECODED = 500


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level BPE file."""

    NONE = (1 << 31) - 1

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bytes_of = byte_alphabet()
        tokens = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(tokens[a], tokens[b]): (i, tokens[a + b]) for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (max([*tokens.values(), *self.special.values()]) + 1)
        for t, i in tokens.items():
            self.bytes_of[i] = bytes(bytes_of[c] for c in t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.single = [0] * 256
        for c, b in bytes_of.items():
            self.single[b] = tokens[c]

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one word: the leftmost pair of lowest rank is merged until none is left."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank = self.rank
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, new, ids[k], r[1]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, ids[h], new, r[1]))
        return tuple(t for t in ids if t >= 0)

    def pair_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Ranks for many lookups at once: byte pairs as a square, all pairs by open addressing; and what each rank's pair becomes."""
        if not hasattr(self, "_table"):
            keys = np.array([x << 32 | y for x, y in self.rank], np.int64)
            ranks = np.array([r for r, _ in self.rank.values()], np.int32)
            news = np.zeros(ranks.max(initial=0) + 2, np.int32)
            news[ranks] = [n for _, n in self.rank.values()]
            size = 1 << (16 * max(1, len(keys))).bit_length()
            places, values = np.full(size, -1, np.int64), np.full(size, self.NONE, np.int32)
            left, probes = np.arange(len(keys)), 0
            while len(left):
                at = (self._place(keys[left], size) + probes) % size
                first = np.zeros(len(left), bool)
                first[np.unique(at, return_index=True)[1]] = True
                free = first & (places[at] < 0)
                places[at[free]], values[at[free]] = keys[left[free]], ranks[left[free]]
                left, probes = left[~free], probes + 1
            single = np.array(self.single, np.int64)
            self._table = None, places, values, news, probes
            square = self._find(np.repeat(single, 256), np.tile(single, 256)).reshape(256, 256)
            self._table = square, places, values, news, probes
        return self._table

    @staticmethod
    def _place(key: np.ndarray, size: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NONE`` where no merge has it."""
        _, places, values, _, probes = self._table
        key = a.astype(np.int64) << 32 | b
        at = self._place(key, len(places))
        out = np.where(places[at] == key, values[at], self.NONE)
        for _ in range(1, probes):
            at = (at + 1) % len(places)
            out = np.where(places[at] == key, values[at], out)
        return out

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words: all ids after one another, and how many each has; words of up to 32 bytes go step by step together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 18), (18, 32)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(rows), 8192):
                some = rows[k : k + 8192]
                ids = self._merge_rows([words[i] for i in some.tolist()], sizes[some], high)
                counts[some] = (ids >= 0).sum(1)
                parts.append((some, ids))
        long = np.flatnonzero(sizes > 32).tolist()
        merged = [self.merge(words[i]) for i in long]
        counts[long] = [len(m) for m in merged]
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for some, ids in parts:
            r, c = np.nonzero(ids >= 0)
            flat[starts[some[r]] + c] = ids[r, c]
        for i, m in zip(long, merged, strict=True):
            flat[starts[i] : starts[i] + len(m)] = m
        return flat, counts

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        flat, counts = self.merge_flat(words)
        flat, ends = flat.tolist(), np.cumsum(counts).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        """Ids of each word from the left, -1 behind them."""
        square, _, _, news, _ = self.pair_table()
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        columns = np.arange(width)
        ids = np.where(columns < sizes[:, None], np.array(self.single, np.int32)[raw], np.int32(-1))
        rank = np.full((len(words), width), self.NONE, np.int32)
        rank[:, :-1] = np.where(columns[1:] < sizes[:, None], square[raw[:, :-1], raw[:, 1:]], self.NONE)
        out = np.full((len(words), width), -1, np.int32)
        row = np.arange(len(words))
        while len(row):
            each = np.arange(len(row))
            at = rank.argmin(1)
            best = rank[each, at]
            more = best < self.NONE
            if not more.all():
                out[row[~more]] = ids[~more]
                row, at, best, ids, rank = row[more], at[more], best[more], ids[more], rank[more]
                each = each[: len(row)]
            # What follows the pair moves one place to the left.
            behind = columns > at[:, None]
            ids = np.where(behind, np.concatenate((ids[:, 1:], np.full((len(row), 1), -1, np.int32)), 1), ids)
            rank = np.where(behind, np.concatenate((rank[:, 1:], np.full((len(row), 1), self.NONE, np.int32)), 1), rank)
            ids[each, at] = news[best]
            for x in (at - 1, at):
                k = each[(x >= 0) & (x < width - 1)]
                c = x[k]
                b = ids[k, c + 1]
                rank[k, c] = np.where(b >= 0, self._find(ids[k, c], np.maximum(b, 0)), self.NONE)
            rank[each[at == width - 1], width - 1] = self.NONE
        return out


class Lexicon:
    """A minimal acyclic transducer from words to token ids, in one flat buffer."""

    HEAD = struct.Struct("<4q")

    @classmethod
    def compile(cls, entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
        """``entries`` in any order, words distinct and not empty."""
        entries = sorted(entries)
        # A state is [final, {byte: state}]; equal right languages become one state as the sorted words pass.
        root: list = [False, {}]
        path: list[list] = [root]
        known: dict[tuple, list] = {}
        last = b""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                key = (state[0], tuple((b, id(t)) for b, t in state[1].items()))
                path[-1][1][last[len(path) - 1]] = known.setdefault(key, state)

        for word, _ in entries:
            same = len(os.path.commonprefix([last, word]))
            settle(same)
            last = word
            for b in word[same:]:
                state: list = [False, {}]
                path[-1][1][b] = state
                path.append(state)
            path[-1][0] = True
        settle(0)

        order: dict[int, int] = {id(root): 0}
        states = [root]
        for s in states:
            for t in s[1].values():
                if id(t) not in order:
                    order[id(t)] = len(states)
                    states.append(t)
        below: dict[int, int] = {}

        def count(s: list) -> int:
            stack = [s]
            while stack:
                x = stack[-1]
                todo = [t for t in x[1].values() if id(t) not in below]
                if todo:
                    stack.extend(todo)
                else:
                    below[id(x)] = x[0] + sum(below[id(t)] for t in x[1].values())
                    stack.pop()
            return below[id(s)]

        count(root)
        first, labels, targets, skips, final = [0], bytearray(), [], [], bytearray()
        for s in states:
            before = int(s[0])
            for b, t in s[1].items():
                labels.append(b)
                targets.append(order[id(t)])
                skips.append(before)
                before += below[id(t)]
            first.append(len(labels))
            final.append(s[0])
        ends = np.cumsum([0, *(len(ids) for _, ids in entries)]).astype("<i4")
        flat = np.array([i for _, ids in entries for i in ids], "<i4")
        head = cls.HEAD.pack(len(states), len(labels), len(entries), len(flat))
        arrays = [np.array(x, "<i4").tobytes() for x in (first, targets, skips)]
        return head + b"".join(arrays) + ends.tobytes() + flat.tobytes() + bytes(final) + bytes(labels)

    def __init__(self, buffer):
        self.buffer = buffer
        n, arcs, words, ids = self.HEAD.unpack_from(buffer, 0)
        at = self.HEAD.size

        def take(count: int) -> memoryview:
            nonlocal at
            at += 4 * count
            return memoryview(buffer)[at - 4 * count : at].cast("i")

        self.first, self.targets, self.skips = take(n + 1), take(arcs), take(arcs)
        self.ends, self.ids = take(words + 1), take(ids)
        self.final = memoryview(buffer)[at : at + n]
        self.labels = at + n
        self.n_states, self.n_words = n, words
        # A state's arcs stand in the order of their bytes, so state and byte together ascend.
        self.arcs = np.repeat(np.arange(n) << 8, np.diff(np.asarray(self.first))) | np.frombuffer(buffer, np.uint8, arcs, self.labels)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> tuple[int, ...] | None:
        """The word's ids, or None if it isn't in the lexicon."""
        state = number = 0
        first, labels, find = self.first, self.labels, self.buffer.find
        for i in range(len(word)):
            arc = find(word[i : i + 1], labels + first[state], labels + first[state + 1]) - labels
            if arc < 0:
                return None
            number += self.skips[arc]
            state = self.targets[arc]
        if not self.final[state]:
            return None
        return tuple(self.ids[self.ends[number] : self.ends[number + 1]])

    def find_all(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, by which ``ends`` has its ids, or -1: all walk through the automaton together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        targets, skips, final = np.asarray(self.targets), np.asarray(self.skips), np.frombuffer(self.final, np.uint8)
        out = np.full(len(words), -1, np.int64)
        row = np.flatnonzero(sizes > 0) if len(self.arcs) else starts[:0]
        state, number = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        step = 0
        while len(row):
            key = state << 8 | raw[starts[row] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            known = self.arcs[arc] == key
            row, arc, number = row[known], arc[known], number[known]
            state, number = targets[arc].astype(np.int64), number + skips[arc]
            step += 1
            done = sizes[row] == step
            ended = done & (final[state] > 0)
            out[row[ended]] = number[ended]
            row, state, number = row[~done], state[~done], number[~done]
        return out


class _Memo:
    """Ids of the words met lately, by two 64-bit hashes of each: from the lexicon, else merged."""

    def __init__(self, lexicon: Lexicon | None, vocabulary: Vocabulary):
        self.lexicon, self.vocabulary = lexicon, vocabulary
        self.clear()

    def clear(self) -> None:
        self.keys = self.checks = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.flat: list[np.ndarray] = [np.zeros(0, np.int32)]

    def ids(self, keys: np.ndarray, checks: np.ndarray, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids kept, and where those of each key start and how many they are; ``word`` gives the bytes of keys by their places."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = (self.keys[at] == keys) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) + len(keys) > MEMO_WORDS:
                self.clear()
                known[:] = False
            self._learn(keys[~known], checks[~known], word(np.flatnonzero(~known)))
            at = np.searchsorted(self.keys, keys)
        return self.flat[0], self.starts[at], self.sizes[at]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[bytes]) -> None:
        number = self.lexicon.find_all(words) if self.lexicon else np.full(len(words), -1)
        unseen = np.flatnonzero(number < 0)
        merged, counts = self.vocabulary.merge_flat([words[i] for i in unseen.tolist()])
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        base = len(self.flat[0])
        starts[unseen], sizes[unseen] = base + np.cumsum(counts) - counts, counts
        parts = [self.flat[0], merged]
        if self.lexicon:
            hit = np.flatnonzero(number >= 0)
            ends, ids = np.asarray(self.lexicon.ends), np.asarray(self.lexicon.ids)
            first = ends[number[hit]].astype(np.int64)
            sizes[hit] = ends[number[hit] + 1] - first
            starts[hit] = base + len(merged) + np.cumsum(sizes[hit]) - sizes[hit]
            parts.append(gathered(ids, first, sizes[hit]))
        self.flat = [np.concatenate(parts)]
        # A key that another word has too is taken anew by whoever comes last.
        at = np.searchsorted(self.keys, keys)
        clash = at[: len(at) * bool(len(self.keys))]
        clash = clash[(clash < len(self.keys)) & (self.keys[np.minimum(clash, len(self.keys) - 1)] == keys)] if len(clash) else clash
        order = np.argsort(keys)
        fields = ("keys", keys), ("checks", checks), ("starts", starts), ("sizes", sizes)
        old = {name: np.delete(getattr(self, name), clash) if len(clash) else getattr(self, name) for name, _ in fields}
        places = np.searchsorted(old["keys"], keys[order])
        for name, new in fields:
            setattr(self, name, np.insert(old[name], places, new[order]))


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` after one another."""
    to = np.cumsum(sizes)
    return values[np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - sizes), sizes)]


OTHER, LETTER, NUMBER, SPACE = range(4)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point, as the pre-token pattern's \\p{L}, \\p{N} and \\s have it."""
    if not _classes:
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every = "".join(map(chr, points))
        out = np.zeros(0x110000, np.uint8)
        for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(name, every):
                out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        _classes.append(out)
    return _classes[0]


def pre_tokens(pieces: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All pieces as one string, the starts of their pre-tokens (and its end), and the first pre-token of each piece.

    The split is that of byte-level BPE: English contractions, or letters, or
    numbers, or other signs, each with one space before; else white space, of
    which the last character before a word stays out.
    """
    joined = "".join(pieces)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    offsets = np.cumsum([0, *map(len, pieces)])
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    kind = classes()[points]
    start = begins.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    inner = ~begins[1:n]
    space = kind == SPACE
    last = space[:-1] & ~space[1:] & inner
    start[: n - 1][last] = True
    start[1:n][last & (points[:-1] == 32)] = False
    quotes = np.flatnonzero(start[:n] & (points == 39))
    if len(quotes):
        room = np.searchsorted(offsets, quotes, "right")
        room = offsets[room] - quotes
        padded = np.concatenate((points, np.zeros(3, np.uint32)))
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = (room > 1) & np.isin(a, [ord(c) for c in "stmd"])
        two = (room > 2) & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
        for found, size in ((quotes[one], 2), (quotes[two], 3)):
            start[found + 1] = False
            start[found + size] = True
    at = np.flatnonzero(start)
    return joined, at if len(at) and at[-1] == n else np.append(at, n), np.searchsorted(at, offsets)


def distinct(joined: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct pre-tokens, two hashes and the number of one; and each pre-token's place among them."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashes = common.Rolling(points).ranges(at[:-1], at[1:]) + np.diff(at).astype(np.uint64)
    place, found = pd.factorize(hashes)
    first = np.empty(len(found), np.int64)
    first[place[::-1]] = np.arange(len(place))[::-1]
    return found, common.Rolling(points, common.BASES[1]).ranges(at[first], at[first + 1]), first, place


def spelled(joined: str, at: np.ndarray, which: np.ndarray) -> list[str]:
    """The pre-tokens of these numbers."""
    return [joined[a:b] for a, b in zip(at[which].tolist(), at[which + 1].tolist(), strict=True)]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def pieces_of(texts: Iterable[str | None], special: dict[str, int]) -> tuple[list[str], list[int], list[int]]:
    """Texts cut at special tokens: the pieces, each piece's text, and its special id or -1."""
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    pieces, owner, token = [], [], []
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        if cut and any(s in text for s in special):
            for m in cut.finditer(text):
                pieces += [text[at : m.start()], m[0]]
                owner += [i, i]
                token += [-1, special[m[0]]]
                at = m.end()
        pieces.append(text[at:])
        owner.append(i)
        token.append(-1)
    return pieces, owner, token


def word_counts(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """(word, n): how often each pre-token occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = vocabulary(vocab_path).special
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return batch

        for batch in common.slices(batches, text):
            pieces, _, token = pieces_of(batch.column(0).to_pylist(), special)
            joined, at, _ = pre_tokens([p for p, t in zip(pieces, token, strict=True) if t < 0])
            _, _, first, place = distinct(joined, at)
            seen.update(dict(zip(spelled(joined, at, first), np.bincount(place, minlength=len(first)).tolist(), strict=True)))
            if len(seen) > COUNTED_WORDS:
                yield flush()
        yield flush()

    partial = docs.select(F.col(text).cast("string").alias(text)).mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocab_path: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words, at most ``size``; returns the name under which every worker finds the file."""
    spark = docs.sparkSession
    counts = common.cut(word_counts(docs, vocab_path, text).where("n > 1").withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    # The lowest level of frequency from which on no more than ``size`` words are left.
    lowest, left = 1 << 30, size
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r.level):
        left -= r["count"]
        if left < 0:
            break
        lowest = r.level
    frequent = counts.where(F.col("level") >= lowest).select("word")
    vocab = vocabulary(vocab_path)
    found = [r.word.encode() for r in frequent.collect()]
    data = Lexicon.compile(zip(found, vocab.merge_all(found), strict=True))
    fd, path = tempfile.mkstemp(suffix=".lexicon")
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))
    return os.path.basename(path)


_memos: dict[tuple[str | None, str], _Memo] = {}


def _memo(lexicon: str | None, vocab_path: str) -> _Memo:
    """The worker's memo, which later tasks of the same lexicon find again."""
    if (lexicon, vocab_path) not in _memos:
        _memos.clear()
        _memos[lexicon, vocab_path] = _Memo(Lexicon.mapped(SparkFiles.get(lexicon)) if lexicon else None, vocabulary(vocab_path))
    return _memos[lexicon, vocab_path]


def encode(docs: DataFrame, lexicon: str | None, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int) added or replaced.

    A null or empty text has no ids.  Special tokens in a text become their id,
    as the tokenizers library has it by default.  All rows and columns stay,
    repeated rows too; texts of any length are encoded whole.
    """
    docs = docs.drop(ids)
    schema = docs.select("*", F.array(F.lit(0)).alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        memo = _memo(lexicon, vocab_path)
        for batch in common.slices(batches, text):
            pieces, owner, token = pieces_of(batch.column(text).to_pylist(), vocab.special)
            token = np.array(token)
            joined, at, first = pre_tokens(["" if t >= 0 else p for p, t in zip(pieces, token.tolist(), strict=True)])
            keys, checks, one, place = distinct(joined, at)
            table, starts, sizes = memo.ids(keys, checks, lambda which, j=joined, a=at, o=one: [w.encode() for w in spelled(j, a, o[which])])
            length = sizes[place]
            flat = gathered(table, starts[place], length)
            upto = np.concatenate(([0], np.cumsum(length)))[first]
            if (token >= 0).any():
                spots = upto[:-1][token >= 0]
                flat = np.insert(flat, spots, token[token >= 0])
                upto = upto + np.concatenate(([0], np.cumsum(token >= 0)))
            lasts = np.flatnonzero(np.diff([*owner, -1]))
            bounds = np.concatenate(([0], upto[lasts + 1])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` added or replaced; special tokens are kept, null ids give ''.

    Bytes that are no UTF-8 become U+FFFD.
    """
    df = df.drop(text)
    schema = df.select("*", F.lit("").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = vocabulary(vocab_path).bytes_of
        sizes = np.array([len(b) for b in bytes_of])
        starts = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(bytes_of), np.uint8)
        for batch in batches:
            for part in (batch.slice(i, ROWS_DECODED) for i in range(0, batch.num_rows, ROWS_DECODED)):
                column = part.column(ids)
                bounds = np.cumsum([0, *(len(x.values) if x.is_valid else 0 for x in column)])
                tokens = column.flatten().to_numpy(zero_copy_only=False)
                length = sizes[tokens]
                to = np.concatenate(([0], np.cumsum(length)))
                raw = table[np.arange(to[-1]) + np.repeat(starts[tokens] - to[:-1], length)].tobytes()
                ends = to[bounds].tolist()
                out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, text])

    return df.mapInArrow(run, schema)


def default_vocabulary() -> str:
    """The public vocabulary's path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_vocabulary()
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, build_lexicon(docs, path), path).drop("text")
    return decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
