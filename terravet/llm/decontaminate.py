"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A benchmark item leaks into a document where some stretch of its words is within
``(100 - percent)`` percent word edits of the item.  Windows of the size of an item are
embedded by the CGK random walk: step j copies the current word and then stays or moves
on, as a random bit of (j, word) says.  Edit distance becomes Hamming distance, so a few
sampled steps of the walk form a bucket key.  The number of repetitions is set for each
class of item sizes by simulation: copies of its items with as many edits as the bound
allows are embedded, and the repetitions must find ``RECALL`` of them on average and
``LEAST_RECALL`` of the worst.  Windows and items in one bucket are then compared exactly.

Windows that cannot be within the bound are not embedded: an edit destroys at most three
word triples, so a leak of an item of n words with d edits holds at least n - 2 - 3d word
triples of the benchmark (a lossless count filter).  Words are compared in lower case.

Items of fewer than ``MIN_WORDS`` words, and sizes for which ``MOST_TABLES`` repetitions are
not enough, take an exact way: of the d + 1 equal parts of an item one is untouched by d
edits, so every stretch with such a part is compared.

The benchmark is a stated query set against all rows: it is read in blocks of at most
``BLOCK_WORDS`` words, and each block goes over all documents.

Defined results: null or empty texts leak nothing; very long texts are read whole; null and
wordless items are left out, an item with a null item_id is searched and reported with it;
repeated rows give repeated results; ties between stretches go to the smaller distance, then
the earlier one; an empty benchmark leaks nothing.  ``leaks`` searches items of any length;
``without_leaks`` takes items of ``least_words`` words or more, as one or two words are no
evidence.  A kept column named ``leaks`` is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names, per_text, plain_names, read
from .shingles import BASE, U, mix, words

MIN_WORDS = 8
SAMPLES = 2
RECALL, LEAST_RECALL = 0.996, 0.96
#: Copies and tables of a simulation; items of sizes within a factor share their repetitions.
COPIES, MOST_TABLES, SIZE_CLASS = 40, 192, 1.15
BLOCK_WORDS = 2_000_000
LANES = 200_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PAD = U(0x5BD1E9955BD1E995)


def walk_keys(symbols: np.ndarray, start: np.ndarray, limit: np.ndarray, size: np.ndarray, table: np.ndarray,
              steps: np.ndarray) -> np.ndarray:
    """Bucket key of each lane: the sampled steps of its CGK walk.

    A lane is a window (``start``, at most ``limit`` words, padded to ``size`` words) in one
    ``table``; ``steps`` holds its ``SAMPLES`` sampled steps in ascending order.
    """
    key = mix(table.astype(U) * BASE + size.astype(U))
    at = np.zeros(len(start), np.int64)
    salt = mix(table.astype(U) + U(1))
    for j in range(int(steps.max(initial=-1)) + 1):
        symbol = np.where(at < limit, symbols[np.minimum(start + at, len(symbols) - 1)], PAD)
        for k in range(steps.shape[1]):
            hit = steps[:, k] == j
            if hit.any():
                key[hit] = mix(key[hit] * BASE + symbol[hit])
        move = mix(symbol ^ (salt + mix(np.array([j], U)))) >> U(63)
        at += (move == 1) & (at < size)
    return key


def sample_steps(size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sampled steps of the walk of 3n steps, by (item size, table)."""
    draws = [mix(size.astype(U) * U(1_000_003) + table.astype(U) * BASE + U(k)) % (3 * size).astype(U)
             for k in range(SAMPLES)]
    return np.sort(np.stack(draws, 1).astype(np.int64), 1)


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    row = item.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(row))), int(rng.integers(3))
        new = int(rng.integers(1 << 63))
        if kind == 0:
            row[at] = new
        elif kind == 1:
            row.insert(at, new)
        elif len(row) > 1:
            del row[at]
    return np.array(row, U)


@dataclass
class Items:
    """One block of the benchmark, ready to meet documents."""

    ids: list
    rows: list[np.ndarray]
    percent: int

    def __post_init__(self):
        sizes = np.array([len(r) for r in self.rows])
        count = self._repetitions(sizes)
        # Repetitions by item size; 0 is the exact way.
        self.tables = np.zeros(int(sizes.max()) + 1, np.int64)
        self.tables[sizes] = count
        self.embedded = np.flatnonzero(count > 0)
        self._anchor(np.flatnonzero(count == 0))
        if len(self.embedded):
            self._embed([self.rows[i] for i in self.embedded], sizes[self.embedded])

    def _embed(self, rows: list[np.ndarray], sizes: np.ndarray) -> None:
        # Word triples with the sizes of the items that hold them.
        made = [triple_hashes(r) for r in rows]
        held = np.unique(np.stack([np.concatenate(made), np.repeat(sizes, [len(m) for m in made])
                                   .astype(U)], 1), axis=0)
        self.triples, first = np.unique(held[:, 0], return_index=True)
        self.first, self.held_sizes = np.append(first, len(held)), held[:, 1].astype(np.int64)
        keys, lane_item = self._keys(rows, sizes, self.tables[sizes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], self.embedded[lane_item[order]]

    def _anchor(self, items: np.ndarray) -> None:
        """Hashes of the parts of the items that are searched exactly, by length of the part."""
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for i in items.tolist():
            row = self.rows[i]
            n, count = len(row), int(self.edits(len(row))) + 1
            cuts = [k * n // count for k in range(count + 1)]
            for low, high in zip(cuts, cuts[1:]):
                parts.setdefault(high - low, []).append((int(grams(row[low:high], high - low)[0]), i, low))
        self.parts = {}
        for length, found in parts.items():
            found.sort()
            self.parts[length] = (np.array([h for h, _, _ in found], U), np.array([[i, low] for _, i, low in found], np.int64))

    def edits(self, size):
        return size * (100 - self.percent) // 100

    @staticmethod
    def _keys(rows: list[np.ndarray], sizes: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of every repetition of every row."""
        first = np.cumsum([0, *map(len, rows)])[:-1]
        lane, table = repeated(tables)
        limit = np.minimum(np.array([len(r) for r in rows])[lane], sizes[lane])
        return walk_keys(np.concatenate(rows), first[lane], limit, sizes[lane], table, sample_steps(sizes[lane], table)), lane

    def _repetitions(self, sizes: np.ndarray) -> np.ndarray:
        """Repetitions of each item, alike for a class of sizes; 0 where it is searched exactly."""
        rng = np.random.default_rng(3)
        kinds = np.floor(np.log(np.maximum(sizes, 1)) / np.log(SIZE_CLASS)).astype(int)
        out = np.zeros(len(sizes), np.int64)
        for kind in np.unique(kinds[sizes >= MIN_WORDS]).tolist():
            mine = np.flatnonzero((kinds == kind) & (sizes >= MIN_WORDS))
            some = [self.rows[i] for i in rng.choice(mine, COPIES)]
            size, many = np.array([len(r) for r in some]), np.full(COPIES, MOST_TABLES)
            own, _ = self._keys(some, size, many)
            copy, _ = self._keys([edited(r, int(self.edits(len(r))), rng) for r in some], size, many)
            rate = (own == copy).reshape(COPIES, MOST_TABLES).mean(1)
            missed = np.power.outer(1 - rate, np.arange(1, MOST_TABLES + 1))
            enough = np.flatnonzero((missed.mean(0) <= 1 - RECALL) & (missed.max(0) <= 1 - LEAST_RECALL))
            out[mine] = enough[0] + 1 if len(enough) else 0
        return out

    def windows(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(start, size) of the windows that pass the count filter."""
        if not len(self.embedded):
            return np.zeros((0, 2), np.int64)
        triple = triple_hashes(symbols)
        at = np.searchsorted(self.triples, triple)
        at[at == len(self.triples)] = 0
        where = np.flatnonzero((self.triples[at] == triple) & (owner[2:] == owner[:-2]))
        low, n = self.first[at[where]], self.first[at[where] + 1] - self.first[at[where]]
        sizes = self.held_sizes[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        where = np.repeat(where, n)
        out = [np.zeros((0, 2), np.int64)]
        for size in np.unique(sizes).tolist():
            hits = where[sizes == size]
            edits = self.edits(size)
            need, span = max(size - 2 - 3 * edits, 1), size + edits
            if len(hits) < need:
                continue
            low = np.maximum(hits[need - 1:] + 3 - span, 0)
            high = hits[:len(hits) - need + 1]
            fits = low <= high
            # Starts from low to high cover these hits; ranges may overlap.
            low, n = low[fits], (high - low + 1)[fits]
            start = np.unique(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            out.append(np.stack([start, np.full(len(start), size)], 1))
        return np.concatenate(out)

    def candidates(self, symbols: np.ndarray, owner: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Distinct (start, item) that share a bucket."""
        found = [np.zeros((0, 2), np.int64)]
        windows = self.windows(symbols, owner)
        lanes = np.cumsum(self.tables[windows[:, 1]]) // LANES
        for part in np.split(windows, np.flatnonzero(np.diff(lanes)) + 1) if len(windows) else []:
            lane, table = repeated(self.tables[part[:, 1]])
            start, size = part[lane, 0], part[lane, 1]
            limit = np.minimum(size, end[owner[start]] - start)
            keys = walk_keys(symbols, start, limit, size, table, sample_steps(size, table))
            found.append(np.unique(self._hits(self.keys, keys, start, self.owners[:, None]), axis=0))
        for length, (hashes, held) in self.parts.items():
            seen = grams(symbols, length)
            inside = np.flatnonzero(owner[length - 1:] == owner[:len(seen)]) if len(seen) else np.zeros(0, np.int64)
            hits = self._hits(hashes, seen[inside], inside, held)
            # The item begins that far before its part, if its text does.
            begin = np.maximum(hits[:, 0] - hits[:, 2], end[owner[hits[:, 0]]] - np.bincount(owner, minlength=len(end))[owner[hits[:, 0]]])
            found.append(np.unique(np.stack([begin, hits[:, 1]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    @staticmethod
    def _hits(sorted_keys: np.ndarray, keys: np.ndarray, start: np.ndarray, held: np.ndarray) -> np.ndarray:
        """(start, *held) of every equal pair of keys."""
        a, b = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
        n = b - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.concatenate([np.repeat(start, n)[:, None], held[at]], axis=1)

    def matches(self, texts: list[str]) -> list[list[tuple]]:
        """Per text, (item, distance, first word, end word) of its closest stretch for each item within the bound."""
        symbols, owner = words([t.lower() for t in texts])
        out: list[list[tuple]] = [[] for _ in texts]
        if not len(symbols):
            return out
        end = np.cumsum(np.bincount(owner, minlength=len(texts)))
        first = end - np.bincount(owner, minlength=len(texts))
        best: dict[tuple[int, int], tuple] = {}
        pairs = self.candidates(symbols, owner, end)
        pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1], owner[pairs[:, 0]]))] if len(pairs) else pairs
        i = 0
        while i < len(pairs):
            start, item = pairs[i]
            doc, size = int(owner[start]), len(self.rows[item])
            stop = start
            while i < len(pairs) and pairs[i][1] == item and owner[pairs[i][0]] == doc and pairs[i][0] - stop <= size:
                stop = pairs[i][0]
                i += 1
            bound = int(self.edits(size))
            low = max(int(first[doc]), int(start) - bound)
            high = min(int(end[doc]), int(stop) + size + bound)
            distance, a, b = closest(self.rows[item], symbols[low:high])
            if distance <= bound:
                made = (distance, low + a - int(first[doc]), low + b - int(first[doc]))
                key = (doc, int(item))
                best[key] = min(best.get(key, made), made)
        for (doc, item), (distance, a, b) in sorted(best.items()):
            out[doc].append((item, distance, a, b))
        return out


def repeated(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number within the row) of ``count`` lanes of each row."""
    lane = np.repeat(np.arange(len(count)), count)
    return lane, np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)


def grams(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all stretches of ``length`` words."""
    if len(symbols) < length:
        return np.zeros(0, U)
    out = np.zeros(len(symbols) - length + 1, U)
    for k in range(length):
        out = mix(out * BASE + symbols[k:k + len(out)])
    return out


def triple_hashes(symbols: np.ndarray) -> np.ndarray:
    return mix((symbols[:-2] * BASE + symbols[1:-1]) * BASE + symbols[2:]) if len(symbols) > 2 else np.zeros(0, U)


def closest(item: np.ndarray, words_: np.ndarray) -> tuple[int, int, int]:
    """(least edit distance of the item to a stretch of the words, its first word, its end word)."""
    n, m = len(item), len(words_)
    along = np.arange(m + 1)
    # A cell packs (distance, start) so that the least start is carried along.
    shift = 1 << 32
    row = along.astype(np.int64)
    for i in range(n):
        new = np.empty_like(row)
        new[0] = (i + 1) * shift
        new[1:] = np.minimum(row[1:] + shift, row[:-1] + np.where(words_ == item[i], 0, shift))
        # Insertions: a running minimum of value minus the cost of walking there.
        new = np.minimum.accumulate(new - along * shift) + along * shift
        row = new
    end = int(np.argmin(row >> 32))
    return int(row[end] >> 32), int(row[end] & (shift - 1)), end


def item_blocks(benchmark: DataFrame, percent: int, least_words: int = 1):
    """The benchmark in blocks of bounded size, each collected on its own."""
    items = (benchmark.filter(F.col("text").isNotNull())
             .withColumn("n_words", F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+"))))
    total = items.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_WORDS))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted({(r["item_id"], r["text"]) for r in part.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if not rows:
            continue
        symbols, owner = words([text.lower() for _, text in rows])
        split = np.split(symbols, np.cumsum(np.bincount(owner, minlength=len(rows)))[:-1])
        kept = [(rows[i][0], w) for i, w in enumerate(split) if len(w) >= least_words]
        if kept:
            yield Items([i for i, _ in kept], [w for _, w in kept], percent)


LEAK = "array<struct<item_id:bigint,distance:int,similarity:double,start:bigint,end:bigint>>"
LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64()),
                                 ("start", pa.int64()), ("end", pa.int64())]))


def with_leaks(docs: DataFrame, items: Items, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the array ``leaks`` of each row, for one block of the benchmark."""
    def make():
        def work(texts: list[str]) -> dict[str, pa.Array]:
            out = []
            for body, row in zip(texts, items.matches(texts)):
                spans = [m.span() for m in WORD.finditer(body)] if row else []
                out.append([{"item_id": items.ids[item], "distance": d, "similarity": 1 - d / len(items.rows[item]),
                             "start": spans[a][0], "end": spans[b - 1][1]} for item, d, a, b in row])
            return {"leaks": pa.array(out, LEAK_ARROW)}
        return work
    return per_text(docs, keep, text, f"leaks {LEAK}", make)


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, keep: list[str] | None = None,
          text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds.

    Columns: ``keep`` (default: doc_id), item_id, distance (word edits), similarity and the
    code points ``start`` to ``end`` of the closest stretch.
    """
    keep = ["doc_id"] if keep is None else keep
    out = None
    for items in item_blocks(benchmark, percent):
        part = with_leaks(docs, items, keep, text)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select(*keep, F.lit(None).cast(LEAK).alias("leaks"))
    return out.select(*keep, F.inline("leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text: str = "text", least_words: int = 3) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns.  Each row is judged on its own."""
    out, new = plain_names(docs)
    for items in item_blocks(benchmark, percent, least_words):
        out = with_leaks(out, items, list(new.values()), new[text]).filter("size(leaks) = 0").drop("leaks")
    return own_names(out, new)


def op3_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
