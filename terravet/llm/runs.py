"""Periodic runs of words: maximal pairs of the LCP-interval tree.

The words of a text are numbered and their suffixes sorted by prefix doubling, for all
texts of a piece at once; a sentinel with the number of the text ends each of them, so
no repeat crosses into another text.  Rank levels kept from the doubling give the common
prefix of neighbouring suffixes.  The tree of LCP intervals is then walked from the
leaves up.  A node holds its places sorted, and the same places filed under the word to
their left; when two children meet, places of different left words form the maximal
pairs (they differ to the left, and to the right because they sit in different children).
Only places within a third of the shared length are looked up: a pair of distance q and
shared length m is a repetition of length m + q, so m >= 3q says length >= 4q, and with
m >= 5 the length is at least 6.  Such a pair is a run as it stands.  Where the distance
is a multiple of the smallest period, the same stretch also has the pair of that period,
and the smallest distance of a stretch is kept.

Most intervals never reach the tree: below five shared words, with a single left word,
or with no two places near enough for their longest repeat, they hold no such pair.

Defined results: a null or empty text and a text without repeats have no run (count 0,
null for the longest run, the digest of nothing); a text of any length is read whole, in
memory that follows the longest text; equal runs in length are ordered by start, then period; repeated rows give
repeated results; an empty table gives an empty result; a column of the table with the
name of a result column is replaced by it; in ``op11_periodic_runs`` a null doc_id has no planted period.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravet.functions.text import blank, let

from .common import per_text, read

#: A run has at least LEAST_WORDS words and LEAST_TURNS periods.
LEAST_WORDS, LEAST_TURNS = 6, 4
LEAST_SHARED = LEAST_WORDS - 1
WORD = r"[^\x20\x09-\x0D]+"

Run = tuple[int, int, int]


class Node:
    """Places of an interval, sorted, and filed under their left words."""

    __slots__ = ("places", "by_left")

    def __init__(self, place: int, left: int):
        self.places, self.by_left = [place], {left: [place]}

    def others(self, left: int, low: int, high: int) -> Iterator[int]:
        """Places from low to high whose left word is another one."""
        first, last = bisect_left(self.places, low), bisect_right(self.places, high)
        if last - first <= len(self.by_left):
            same = self.by_left.get(left, [])
            for place in self.places[first:last]:
                k = bisect_left(same, place)
                if k == len(same) or same[k] != place:
                    yield place
            return
        for other, held in self.by_left.items():
            if other != left:
                yield from held[bisect_left(held, low):bisect_right(held, high)]

    def add(self, place: int, left: int) -> None:
        insort(self.places, place)
        insort(self.by_left.setdefault(left, []), place)


def _meet(one: Node, two: Node, shared: int, found: list[tuple[int, int, int]]) -> Node:
    """Pairs between two children of an interval, and the node of both."""
    large, small = (one, two) if len(one.places) >= len(two.places) else (two, one)
    reach = shared // (LEAST_TURNS - 1)
    for left, held in small.by_left.items():
        for place in held:
            for other in large.others(left, place - reach, place + reach):
                found.append((min(place, other), max(place, other), shared))
    for left, held in small.by_left.items():
        for place in held:
            large.add(place, left)
    return large


def maximal_pairs(places: Sequence[int], lefts: Sequence[int], shared: Sequence[int]) -> list[tuple[int, int, int]]:
    """(place, later place, shared length) of near maximal pairs.

    ``places`` are in suffix order, ``shared[i]`` is the common prefix of suffixes i and i + 1.
    """
    found: list[tuple[int, int, int]] = []
    path: list[tuple[int, Node]] = []  # open intervals, outermost first
    node = Node(places[0], lefts[0])
    for i in range(1, len(places) + 1):
        depth = shared[i - 1] if i < len(places) else -1
        while path and path[-1][0] > depth:
            own, up = path.pop()
            node = _meet(up, node, own, found)
        if path and path[-1][0] == depth:
            node = _meet(path.pop()[1], node, depth, found)
        if i < len(places):
            path.append((depth, node))
            node = Node(places[i], lefts[i])
    return found


def _order(codes: np.ndarray, text_of: np.ndarray, kinds: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(final rank of each place, rank levels) of the suffixes of ``codes``.

    A level (h, ranks) has equal ranks exactly where h words are equal.  Only places in
    a group of equals are sorted again with twice the length.
    """
    n = len(codes)
    single = text_of * kinds + codes
    follow = np.append(codes[1:], 0)
    levels = [(1, single)]
    key, at, h = single * kinds + follow, np.arange(n), 2
    rank = np.zeros(n, np.int64)
    base = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key)
        at, key, base = at[order], key[order], base[order]
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        index = np.arange(len(at))
        first = np.maximum.accumulate(np.where(head, index, 0))
        # A group keeps the rank of its first place; inside a divided group the parts follow each other.
        outer = np.ones(len(at), bool)
        outer[1:] = base[1:] != base[:-1]
        start = np.maximum.accumulate(np.where(outer, index, 0))
        rank[at] = base + first - start
        last = np.append(head[1:], True)
        again = ~(head & last)
        levels.append((h, rank.astype(np.int32) if n < 1 << 31 else rank.copy()))
        at = at[again]
        if not len(at):
            return rank, levels
        base = rank[at]
        key = base * n + rank[np.minimum(at + h, n - 1)]
        h *= 2


def _shared(levels: list[tuple[int, np.ndarray]], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Length of the common prefix of pairs of places."""
    done = np.zeros(len(one), np.int64)
    last = len(levels[0][1]) - 1
    for h, ranks in reversed(levels):
        same = ranks[np.minimum(one + done, last)] == ranks[np.minimum(two + done, last)]
        done[same] += h
    return done


def find_runs(codes: np.ndarray, lengths: np.ndarray) -> list[list[Run]]:
    """Runs (start, length, period) of each text, ordered, from the numbered words of all texts."""
    texts = len(lengths)
    result: list[list[Run]] = [[] for _ in range(texts)]
    if not len(codes):
        return result
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # with one sentinel for each text
    text_of = np.repeat(np.arange(texts), lengths + 1)
    held = np.zeros(starts[-1], np.int64)
    inner = np.ones(starts[-1], bool)
    inner[starts[1:] - 1] = False
    held[inner] = codes.astype(np.int64) + 1
    kinds = int(held.max()) + 1
    rank, levels = _order(held, text_of, kinds)
    four = next((ranks for h, ranks in levels if h == 4), None)
    if four is None:
        return result
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    close = np.flatnonzero(four[order[1:]] == four[order[:-1]])
    shared = np.zeros(len(order), np.int64)
    shared[close] = _shared(levels, order[close], order[close + 1])
    joined = shared >= LEAST_SHARED
    # Stretches of the suffix order in which every two neighbours share enough.
    begins = np.flatnonzero(joined & ~np.append(False, joined[:-1]))
    ends = np.flatnonzero(joined & ~np.append(joined[1:], False)) + 2
    left = np.append(-1, held[:-1])
    left[starts[:-1]] = -1
    pairs_by_text: dict[int, dict[tuple[int, int], int]] = {}
    for begin, end in zip(*_promising(begins, ends, order, shared, left)):
        places = order[begin:end]
        text = int(text_of[places[0]])
        at = (places - starts[text]).tolist()
        best = pairs_by_text.setdefault(text, {})
        for one, two, m in maximal_pairs(at, left[places].tolist(), shared[begin:end - 1].tolist()):
            stretch = (one, two + m)
            best[stretch] = min(best.get(stretch, two - one), two - one)
    for text, best in pairs_by_text.items():
        result[text] = sorted((a, b - a, q) for (a, b), q in best.items())
        result[text].sort(key=lambda r: (r[0], r[2]))
    return result


def _promising(begins: np.ndarray, ends: np.ndarray, order: np.ndarray, shared: np.ndarray,
               left: np.ndarray) -> tuple[list[int], list[int]]:
    """The intervals with two left words and two places near enough for their longest repeat."""
    if not len(begins):
        return [], []
    sizes = ends - begins
    group = np.repeat(np.arange(len(begins)), sizes)
    index = np.arange(len(group)) + np.repeat(begins - np.append(0, np.cumsum(sizes)[:-1]), sizes)
    cuts = np.append(0, np.cumsum(sizes)[:-1])
    lefts, places = left[order[index]], order[index]
    longest = np.maximum.reduceat(np.where(index == np.repeat(ends - 1, sizes), 0, shared[index]), cuts)
    by_place = np.lexsort((places, group))
    gap = np.diff(places[by_place], append=0)
    gap[np.append(cuts[1:], len(gap)) - 1] = np.iinfo(np.int64).max
    nearest = np.minimum.reduceat(gap, cuts)
    good = ((np.minimum.reduceat(lefts, cuts) != np.maximum.reduceat(lefts, cuts))
            & (nearest * (LEAST_TURNS - 1) <= longest))
    return begins[good].tolist(), ends[good].tolist()


def _digest(parts: bytes) -> str:
    return hashlib.sha256(parts).hexdigest()


def work(texts: list[str]) -> dict[str, pa.Array]:
    """Runs, the longest run and the digests of a piece of texts."""
    cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    owner = pc.list_parent_indices(cut)
    flat = cut.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(real), np.asarray(owner.filter(real))
    lengths = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    codes = np.asarray(flat.dictionary_encode().indices) if len(flat) else np.zeros(0, np.int64)
    runs = find_runs(codes, lengths)
    kept = np.ones(len(flat), bool)
    offsets = np.append(0, np.cumsum(lengths))
    for text, found in enumerate(runs):
        for start, length, period in found:
            kept[offsets[text] + start + period:offsets[text] + start + length] = False
    left = flat.filter(pa.array(kept))
    bounds = np.append(0, np.cumsum(np.bincount(owner[kept], minlength=len(texts))))
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), left), pa.scalar(" ", pa.large_string()))
    top = [max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None for found in runs]
    column = lambda values: pa.array(values, pa.int64())
    return {
        "n_words": column(lengths),
        "n_runs": column([len(found) for found in runs]),
        "start": column([t and t[0] for t in top]),
        "length": column([t and t[1] for t in top]),
        "period": column([t and t[2] for t in top]),
        "exponent_milli": column([t and 1000 * t[1] // t[2] for t in top]),
        "runs": pa.array([[{"start": a, "length": b, "period": q} for a, b, q in found] for found in runs],
                         pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        "runs_sha256": pa.array([_digest("".join(f"{a},{b},{q}\n" for a, b, q in found).encode()) for found in runs]),
        "collapsed": lines.cast(pa.string()) if lines.nbytes < 1 << 31 else lines,
        "collapsed_sha256": pa.array([_digest(x.as_py().encode()) for x in lines]),
    }


SCHEMA = {"n_words": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
          "exponent_milli": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>",
          "runs_sha256": "string", "collapsed": "string", "collapsed_sha256": "string"}


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                  results: Sequence[str] = tuple(SCHEMA)) -> DataFrame:
    """``keep`` (default: all columns but the text) and ``results``: runs and the text without their repeats."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep

    def make():
        def chosen(texts: list[str]) -> dict[str, pa.Array]:
            made = work(texts)
            return {name: made[name] for name in results}
        return chosen

    return per_text(docs, keep, text, ", ".join(f"`{name}` {SCHEMA[name]}" for name in results), make)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, for one document in ten with a periodic end that its doc_id fixes."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint") + 1
        return let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("bigint"), n - 1),
            lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))), " "))

    words = F.regexp_extract_all(blank(text), F.lit(f"({WORD})"))
    edited = let(words, lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))
    return F.when(F.pmod(h, F.lit(10)) == 0, edited).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs(docs, keep=["doc_id"], results=[
        "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
