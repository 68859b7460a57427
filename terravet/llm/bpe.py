"""Byte-level BPE encoding and decoding.

Pre-tokenisation without regular expressions.  Every code point gets a class (letter,
number, other mark, kinds of white space, contraction mark); a class is a transition
function on the kind of the token that is open.  The functions reachable by
composition form a small monoid, so a prefix of functions is one small integer and
two prefixes compose by one table look-up: an associative scan, done in blocks over
all texts of a piece at once.  The open state before each code point and its class
say whether a token starts there.  The slices then go through a cache of merged
pieces.  The byte offsets of the tokens are retained: decoding lays the bytes of each token
at its offset, and ``encode`` returns them.

Defined results: a null or empty text has no tokens, no offsets and decodes to empty
bytes; very long texts are encoded whole; repeated rows give repeated results; an empty
table gives an empty result; other columns are not touched, but one with the name of a
result column is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text, read

# Kinds of the open token, as states of the scan.
FREE, LETTERS, NUMBER, MARKS, LEAD, BLANKS, ONE_MORE, TWO_MORE = range(8)
# Classes of code points; white space knows whether a visible character follows it.
C_LETTER, C_NUMBER, C_MARK, C_SHORT, C_LONG, C_BLANK, C_LEAD, C_LAST, C_TEXT_END = range(9)
BLOCK = 64
CACHE_ENTRIES = 400_000
LONG_SLICE = 48
NEVER = 1 << 40


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, a token starts here) of the fixed split pattern."""
    if kind == C_TEXT_END:
        return FREE, True
    if kind == C_BLANK:
        return BLANKS, state != BLANKS
    if kind == C_LEAD:
        return LEAD, True
    if kind == C_LAST:
        return FREE, True
    if kind == C_LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FREE, False
        return LETTERS, state not in (LETTERS, LEAD)
    if kind == C_NUMBER:
        return NUMBER, state not in (NUMBER, LEAD)
    if state in (MARKS, LEAD):
        return MARKS, False
    if kind == C_MARK:
        return MARKS, True
    return (ONE_MORE if kind == C_SHORT else TWO_MORE), True


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, composition table, state after an element from FREE, starts)."""
    steps = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    identity = tuple(range(8))
    elements: dict[tuple, int] = {identity: 0}
    order = [identity]
    for made in order:
        for step in steps:
            both = tuple(step[s] for s in made)
            if both not in elements:
                elements[both] = len(order)
                order.append(both)
    size = len(order)
    if size > 255:
        raise ValueError("transition monoid does not fit a byte")
    table = np.zeros((size, size), np.uint8)
    for i, first in enumerate(order):
        for j, second in enumerate(order):
            table[i, j] = elements[tuple(second[s] for s in first)]
    of_class = np.array([elements[s] for s in steps], np.uint8)
    from_free = np.array([e[FREE] for e in order], np.uint8)
    starts = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    return of_class, table, from_free, starts


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, before its neighbours are looked at."""
    import regex
    table = np.full(0x110000, C_MARK, np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for pattern, kind in ((r"\p{L}+", C_LETTER), (r"\p{N}+", C_NUMBER), (r"\p{White_Space}+", C_BLANK)):
        for m in regex.finditer(pattern, every):
            low, high = ord(m.group(0)[0]), ord(m.group(0)[-1])
            table[low:high + 1] = kind
    table[0xD800:0xE000] = C_MARK
    return table


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of monoid elements (Blelloch style, in blocks)."""
    _, table, _, _ = monoid()
    flat, size = table.ravel(), table.shape[0]
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = functions
    rows = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    for i in range(1, BLOCK):
        rows[i] = flat[rows[i - 1].astype(np.int32) * size + rows[i]]
    before = np.zeros(blocks, np.uint8)
    before[1:] = scan(rows[-1])[:-1]
    whole = flat[before.astype(np.int32)[None, :] * size + rows]
    return np.ascontiguousarray(whole.T).reshape(-1)[:n]


def token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point.

    ``points`` holds the texts one after the other with one filler after each,
    ``ends`` the positions of the fillers (which count as starts).
    """
    of_class, _, from_free, starts = monoid()
    kinds = class_table()[points]
    kinds[ends] = C_TEXT_END
    blank = kinds == C_BLANK
    visible_next = np.zeros(len(kinds), bool)
    visible_next[:-1] = ~blank[1:] & (kinds[1:] != C_TEXT_END)
    last = blank & visible_next
    kinds[last] = C_LAST
    kinds[last & (points == 32)] = C_LEAD
    marks = np.flatnonzero((points == 39) & (kinds == C_MARK))
    if len(marks):
        # A filler stands after each text, and its point (0) is no letter.
        after = points[np.minimum(marks + 1, len(points) - 1)]
        second = points[np.minimum(marks + 2, len(points) - 1)]
        kinds[marks[np.isin(after, [115, 116, 109, 100])]] = C_SHORT
        long = (((after == 114) & (second == 101)) | ((after == 118) & (second == 101))
                | ((after == 108) & (second == 108)))
        kinds[marks[long]] = C_LONG
    state = np.zeros(len(kinds), np.uint8)
    state[1:] = from_free[scan(of_class[kinds])[:-1]]
    return starts.ravel()[state.astype(np.int32) * 9 + kinds]


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, byte border of every slice, first slice of every text).

    Slice i is ``data[borders[i]:borders[i + 1]]``; text j has the slices
    ``first[j]`` to ``first[j + 1]``, a filler slice of one byte at its end included.
    """
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    begins = np.flatnonzero(token_starts(points, ends))
    width = np.ones(len(points), np.int64)
    for bound in (0x80, 0x800, 0x10000):
        width += points >= bound
    offsets = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=offsets[1:])
    first = np.zeros(len(texts) + 1, np.int64)
    first[1:] = np.searchsorted(begins, ends) + 1
    borders = np.append(offsets[begins], offsets[-1])
    return joined.encode("utf-8", "surrogatepass"), borders, first


class Vocabulary:
    """Ranks of a byte-level vocabulary with a cache of merged slices."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._layout = None
        self.cache: dict[bytes, bytes] = {}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.pair_keys, key := left.astype(np.int64) << 32 | right)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_values[at], NEVER)

    def merge_together(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of short slices, merged in step: in each round every slice makes its
        merge of the lowest rank (leftmost among equals) until none has one left."""
        size = max(map(len, pieces))
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), size)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(size) < length[:, None], self.of_byte[raw], -1)
        ids = np.hstack([ids, np.full((len(ids), 1), -1, ids.dtype)])
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        done, rows = ids.copy(), np.arange(len(ids))
        along = np.arange(size)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            ended = best == NEVER
            if ended.any():
                done[rows[ended]] = ids[ended]
                going = ~ended
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
            if not len(rows):
                break
            every = np.arange(len(rows))
            ids[every, at] = best
            ids[:, :-1] = np.take_along_axis(ids, along + (along > at[:, None]), 1)
            ranks[:, :-1] = np.take_along_axis(ranks, along[:-1] + (along[:-1] >= at[:, None]), 1)
            ids[:, -1], ranks[:, -1] = -1, NEVER
            ranks[every, at] = self._pair_ranks(ids[every, at], ids[every, at + 1])
            before = np.maximum(at - 1, 0)
            new = self._pair_ranks(ids[every, before], ids[every, before + 1])
            ranks[every, before] = np.where(at > 0, new, ranks[every, before])
        return [row[:n] for row, n in zip(done.astype("<u4"), (done >= 0).sum(1))]

    def learn(self, pieces: set[bytes]) -> None:
        """Puts the short slices of ``pieces`` into the cache."""
        if len(self.cache) + len(pieces) > CACHE_ENTRIES:
            self.cache.clear()
        waiting: dict[int, list[bytes]] = {}
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(piece) <= LONG_SLICE:
                waiting.setdefault(-(-len(piece) // 8), []).append(piece)
        for group in waiting.values():
            for low in range(0, len(group), 16_384):
                part = group[low:low + 16_384]
                self.cache.update(zip(part, [ids.tobytes() for ids in self.merge_together(part)]))

    def merge_long(self, piece: bytes) -> bytes:
        """Packed ids by the same merges through a heap, for a slice of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        left, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
                r = ranks.get(piece[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            k = left[i]
            if k >= 0:
                r = ranks.get(piece[k:stop])
                if r is not None:
                    heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return np.array(out, "<u4").tobytes()

    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens in one array, where each token begins in it, and its size."""
        if self._layout is None:
            every = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
            sizes = np.array([len(t) for t in every], np.int64)
            self._layout = np.frombuffer(b"".join(every), np.uint8), np.cumsum(sizes) - sizes, sizes
        return self._layout

    def decode(self, packed: bytes, ends: np.ndarray | None = None) -> bytes:
        """Bytes of the tokens, each laid at the offset that encoding retained for it."""
        data, begins, known = self.layout()
        ids = np.frombuffer(packed, "<u4")
        if not known[ids].all():
            raise ValueError("id without a token")
        ends = token_offsets(self, packed) if ends is None else np.asarray(ends, np.int64)
        if not len(ids):
            return b""
        sizes = np.diff(ends, prepend=0)
        return data[np.repeat(begins[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(vocab: Vocabulary, texts: list[str]) -> Iterator[bytes]:
    """Packed ids of each text."""
    if not texts:
        return
    data, borders, first = slices(texts)
    cuts = borders.tolist()
    words = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    packed = list(map(vocab.cache.get, words))
    unseen = [i for i, ids in enumerate(packed) if ids is None]
    vocab.learn({words[i] for i in unseen})
    for i in unseen:
        packed[i] = vocab.cache.get(words[i]) or vocab.merge_long(words[i])
    for j in range(len(texts)):
        # The last slice of a text is its filler, which is left out.
        yield b"".join(packed[first[j]:first[j + 1] - 1])


def token_offsets(vocab: Vocabulary, packed: bytes) -> np.ndarray:
    """End of each token in the bytes of its text."""
    return np.cumsum(vocab.layout()[2][np.frombuffer(packed, "<u4")])


def encode(df: DataFrame, vocab_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but the text), ``ids`` and byte ``offsets`` (token ends)."""
    keep = [c for c in df.columns if c != text] if keep is None else keep

    def make():
        vocab = vocabulary(vocab_path)

        def work(texts: list[str]) -> dict[str, pa.Array]:
            rows = list(encode_texts(vocab, texts))
            return {"ids": pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())),
                    "offsets": pa.array([token_offsets(vocab, r) for r in rows], pa.list_(pa.int64()))}
        return work

    return per_text(df, keep, text, "ids array<int>, offsets array<bigint>", make)


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes of ``ids`` (null: empty)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            made = [vocab.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())],
                                             names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{fields}, `{out}` binary")


def round_trip(df: DataFrame, vocab_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode, decode and digest in one pass: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``lossless``."""
    keep = [c for c in df.columns if c != text] if keep is None else keep

    def make():
        vocab = vocabulary(vocab_path)

        def work(texts: list[str]) -> dict[str, pa.Array]:
            counts, ids, back, same = [], [], [], []
            for body, packed in zip(texts, encode_texts(vocab, texts)):
                ends = token_offsets(vocab, packed)
                decoded = vocab.decode(packed, ends)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                same.append(decoded == body.encode("utf-8", "surrogatepass"))
            return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()),
                    "decoded_sha256": pa.array(back, pa.string()), "lossless": pa.array(same, pa.bool_())}
        return work

    return per_text(df, keep, text,
                    "n_tokens bigint, ids_sha256 string, decoded_sha256 string, lossless boolean", make)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), default_vocabulary(), keep=["doc_id"])
