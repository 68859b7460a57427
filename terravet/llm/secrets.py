"""Secret scans: fixed patterns plus a character convolutional network in numpy.

Base findings (kinds ``assign``, ``access``, ``hex``) are the leftmost matches of the
fixed patterns of each kind; they are always kept.  Every run of 12 or more secret-like
characters, or what base findings leave of it, is a candidate.  A small network reads the
candidate, a long one in overlapping cores, and the text on both sides of each core and
gives a calibrated probability; candidates that reach the threshold are added as kind
``model``.

The network is trained on labelled findings of all documents, a bounded number of either
label by hash: runs that a keyword or a key pattern confirms are positive, plain runs are
negative.  A positive is also shown with the context of a negative and with redrawn
characters, so that the shape counts and not the keyword alone.  Since the patterns label
few shapes, random keys of all lengths and harmless strings of known kinds (URLs, paths,
UUIDs, dates, numbers, names) are drawn by rule and learned too, in contexts of the
documents; so there is a network whatever the documents hold.  Probabilities are calibrated
by a logistic map on a held-out part.  For each band of lengths the largest threshold that
keeps ``RECALL`` of the held-out positives bounds the threshold from above; it is then
placed half way down to the next harmless candidate, and never under one half.

Defined results: a null or empty text has no findings; very long texts are read whole; repeated
rows get equal findings; offsets are code points, end exclusive; an empty table gives an empty
result; a column of the table with the name of a result column is replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names, per_text, pieces, plain_names, read, stored
from .secret_shapes import CASED, HARMLESS, Shapes

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "model")
KEYWORD_PARTS = ("passw", "secret", "token", "api")

RUN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
RUN_LEAST = 12
JOINTS = "=/.-"
SIDE, CORE, STRIDE = 16, 48, 24
RECALL = 0.97
SAMPLE_ROWS = 3_000
#: Drawn keys, and drawn harmless strings of each kind; upper ends of the length bands of the thresholds.
DRAWN_KEYS, DRAWN_OF_KIND = 6_000, 800
BANDS = (15, 23, 1 << 30)
KEY_LENGTHS = (12, 56)
MASK = "[secret]"
ROUNDS = 9

_IN_RUN = np.zeros(0x110000, bool)
_IN_RUN[[ord(c) for c in RUN_CHARS]] = True
_SHORT = np.full(0x110000, 96, np.uint8)
_SHORT[32:127] = np.arange(95)
_SHORT[10] = 95
PAD, SYMBOLS = 97, 98


def runs(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Maximal runs of at least ``RUN_LEAST`` secret-like characters of each text."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_RUN[points]]).astype(np.int8)))
    low, high = edge[::2], edge[1::2]
    keep = high - low >= RUN_LEAST
    low, high = low[keep], high[keep]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(first, low, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for j, a, b in zip(owner.tolist(), (low - first[owner]).tolist(), (high - first[owner]).tolist()):
        out[j].append((a, b))
    return out


def base_findings(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself); kinds by their place in ``KINDS``.

    Matches of ``access`` and ``hex`` that are long enough lie inside the runs.
    """
    out = []
    low = text.lower()
    if any(part in low for part in KEYWORD_PARTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= LEAST["assign"]]
    for a, b in found:
        body = text[a:b]
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            out += [(a + m.start(), kind, a + m.end(), a + m.start()) for m in pattern.finditer(body)
                    if m.end() - m.start() >= LEAST[KINDS[kind]]]
    return sorted(out)


def parts(text: str, a: int, b: int, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of a run outside all base findings, without the joints beside a finding."""
    out, at = [], a
    for start, end in [*sorted((f[0], f[2]) for f in base if f[0] < b and a < f[2]), (b, b)]:
        low, high = at, min(start, b)
        while low > a and low < high and text[low] in JOINTS:
            low += 1
        while high < b and low < high and text[high - 1] in JOINTS:
            high -= 1
        if high - low >= RUN_LEAST:
            out.append((low, high))
        at = max(at, end)
    return out


def cores(a: int, b: int) -> list[tuple[int, int]]:
    """A long candidate gives several cores that overlap by half; the last one ends with it."""
    return [(low, low + CORE) for low in range(a, b - CORE, STRIDE)] + [(max(a, b - CORE), b)]


def around(text: str, a: int, b: int) -> tuple[str, str, str]:
    """Left context, core and right context."""
    return text[max(0, a - SIDE):a], text[a:b], text[b:b + SIDE]


def codes(left: str, core: str, right: str) -> np.ndarray:
    row = np.full(SIDE + CORE + SIDE, PAD, np.uint8)
    for place, part in ((SIDE - len(left), left), (SIDE, core), (SIDE + CORE, right)):
        if part:
            row[place:place + len(part)] = _SHORT[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return row


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over each segment, one output."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (1.0,) * len(BANDS)

    WIDTH = 5
    SEGMENTS = ((0, SIDE), (SIDE, SIDE + CORE), (SIDE + CORE, 2 * SIDE + CORE))

    @classmethod
    def start(cls, rng: np.random.Generator, depth: int = 8, count: int = 32) -> Network:
        return cls(rng.normal(0, 0.3, (SYMBOLS, depth)), rng.normal(0, 0.2, (cls.WIDTH * depth, count)),
                   np.zeros(count), rng.normal(0, 0.1, 6 * count), 0.0)

    def forward(self, x: np.ndarray):
        n, size = x.shape
        half = self.WIDTH // 2
        wide = np.pad(x, ((0, 0), (half, half)), constant_values=PAD)
        around = np.stack([wide[:, i:i + size] for i in range(self.WIDTH)], 2)
        seen = self.embed[around].reshape(n, size, -1)
        act = np.maximum(seen @ self.filters + self.bias, 0)
        best = [act[:, a:b].argmax(1) + a for a, b in self.SEGMENTS]
        tops = [np.take_along_axis(act, at[:, None], 1)[:, 0] for at in best]
        shares = self.shares(x)
        means = [np.einsum("nlc,nl->nc", act[:, a:b], shares[:, a:b]) for a, b in self.SEGMENTS]
        pooled = np.hstack([*tops, *means])
        return around, seen, act, best, pooled, pooled @ self.out + self.offset

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Weight of each place in the mean of its segment: equal over its characters."""
        real = (x != PAD).astype(float)
        for a, b in self.SEGMENTS:
            real[:, a:b] /= np.maximum(real[:, a:b].sum(1, keepdims=True), 1)
        return real

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.concatenate([self.forward(x[i:i + 512])[-1] for i in range(0, len(x), 512)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -35, 35)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        around, seen, act, best, pooled, z = self.forward(x)
        n, size = x.shape
        dz = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        d_pool = dz[:, None] * self.out
        count = len(self.bias)
        d_act, shares = np.zeros_like(act), self.shares(x)
        rows, columns = np.arange(n)[:, None], np.arange(count)[None]
        for i, (a, b) in enumerate(self.SEGMENTS):
            d_act[rows, best[i], columns] += d_pool[:, i * count:(i + 1) * count]
            d_act[:, a:b] += d_pool[:, None, (3 + i) * count:(4 + i) * count] * shares[:, a:b, None]
        d_act *= act > 0
        flat = d_act.reshape(-1, count)
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, around.reshape(-1), (flat @ self.filters.T).reshape(-1, self.embed.shape[1]))
        return [d_embed, seen.reshape(n * size, -1).T @ flat, flat.sum(0), pooled.T @ dz, np.array(dz.sum())]

    def learn(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rounds: int = 4,
              batch: int = 128, rate: float = 0.01) -> None:
        """Adam on the logistic loss."""
        state = [self.embed, self.filters, self.bias, self.out, np.array(self.offset)]
        first, second = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for low in range(0, len(order), batch):
                step += 1
                part = order[low:low + batch]
                for i, g in enumerate(self.gradients(x[part], y[part])):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    state[i] = state[i] - rate * (first[i] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
                self.embed, self.filters, self.bias, self.out = state[:4]
                self.offset = float(state[4])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic map of the outputs, then a threshold with the wanted recall."""
        z, a, b = self.logits(x), 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
            h = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
            m = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
            move = np.clip(np.linalg.solve(m, g), -1, 1)
            a, b = a - move[0], b - move[1]
        self.slope, self.shift = float(max(a, 1e-3)), float(b)
        p, band = self.probability(x), bands(x)
        self.thresholds = tuple(self.cut(p[band == i], y[band == i]) for i in range(len(BANDS)))

    @staticmethod
    def cut(p: np.ndarray, y: np.ndarray) -> float:
        hits = np.sort(p[y == 1])
        if not len(hits):
            return 0.5
        most = float(hits[int(np.floor((1 - RECALL) * len(hits)))])
        below = p[(y == 0) & (p < most)]
        return max(0.5, (most + float(below.max(initial=0.0))) / 2)


def bands(x: np.ndarray) -> np.ndarray:
    """Length band of the core of each row."""
    return np.searchsorted(BANDS, (x[:, SIDE:SIDE + CORE] != PAD).sum(1))


def examples(rows: list[tuple[int, str, str, str]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Training rows from (label, left, core, right), positives in three guises."""
    drawn = list(RUN_CHARS[:64])
    plain = [r for r in rows if not r[0]]
    x, y = [], []
    for label, left, core, right in rows:
        x.append(codes(left, core, right))
        y.append(label)
        if label and plain:
            other = plain[int(rng.integers(len(plain)))]
            x.append(codes(other[1], core, other[3]))
            x.append(codes(other[1], "".join(rng.choice(drawn, len(core))), other[3]))
            y += [1, 1]
    return np.array(x), np.array(y, float)


def labelled(body: str, found: list[tuple[int, int]]) -> list[tuple[int, str, str, str]]:
    """(label, left, core, right) of the candidates of a text."""
    base = base_findings(body, found)
    confirmed = [(s, e) for _, kind, e, s in base if kind != 2]
    touched = [(s, e) for s, _, e, _ in base]
    rows = []
    for a, b in found:
        if not any(s < b and a < e for s, e in touched):
            rows += [(0, *around(body, low, high)) for low, high in cores(a, b)]
        elif any(s < b and a < e for s, e in confirmed):
            rows += [(1, *around(body, low, high)) for low, high in cores(a, b)
                     if any(min(e, high) - max(s, low) >= min(RUN_LEAST, e - s) for s, e in confirmed)]
    return rows


class Smallest:
    """The ``limit`` distinct rows of smallest hash among all that were added; at most twice as many are held."""

    def __init__(self, limit: int):
        self.limit, self.rows, self.bound = limit, {}, 1 << 63

    def add(self, row: tuple[int, str, str, str]) -> None:
        text = "\0".join(row[1:]).encode("utf-8", "surrogatepass")
        at = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big") >> 1
        if at <= self.bound:
            self.rows[row] = at
            if len(self.rows) > 2 * self.limit:
                self.rows = dict(self.best())
                self.bound = max(self.rows.values())

    def best(self) -> list[tuple[tuple[int, str, str, str], int]]:
        return sorted(self.rows.items(), key=lambda x: (x[1], x[0]))[:self.limit]


def sample_rows(docs: DataFrame, text: str = "text", rows_limit: int = SAMPLE_ROWS) -> list[tuple[int, str, str, str]]:
    """At most ``rows_limit`` distinct labelled candidates of either kind, those of smallest hash of all documents.

    Each task hands on its own smallest ones only; the result does not depend on partitions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Smallest(rows_limit), Smallest(rows_limit)
        for batch in batches:
            for _, texts in pieces(x.as_py() for x in batch.column(0)):
                for body, found in zip(texts, runs(texts)):
                    for row in labelled(body, found):
                        kept[row[0]].add(row)
        for few in kept:
            best = few.best()
            columns = list(zip(*[(*row, at) for row, at in best])) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                names=["label", "before", "core", "after", "at"])

    seen = docs.select(text).mapInArrow(run, "label int, before string, core string, after string, at bigint")
    rows = stored(seen, "secret-candidates").distinct()
    out = []
    for label in (1, 0):
        best = rows.filter(F.col("label") == label).orderBy("at", "before", "core", "after").limit(rows_limit)
        out += [tuple(r)[:4] for r in best.collect()]
    return out


def train(docs: DataFrame, text: str = "text", rows_limit: int = SAMPLE_ROWS, seed: int = 11) -> Network:
    return fit(sample_rows(docs, text, rows_limit), seed)


def drawn_rows(rows: list[tuple[int, str, str, str]], rng: np.random.Generator) -> list[tuple[int, str, str, str]]:
    """(label, left, core, right) of drawn keys and harmless strings, beside texts of the labelled rows."""
    sides = [(left, right) for _, left, _, right in rows]
    shapes = Shapes(rng, [w for side in sides for part in side for w in part.split()])

    def context() -> tuple[str, str]:
        if sides and rng.random() < 0.6:
            return shapes.pick(sides)
        return shapes.pick(("", " ", shapes.word() + " ", shapes.word() + ": ", '"', "=")), shapes.pick(("", " ", " " + shapes.word(), "\n", '"'))
    out = []
    for _ in range(DRAWN_KEYS):
        left, right = context()
        # Half of the keys are short: they are the hard ones.
        most = KEY_LENGTHS[1] if rng.random() < 0.5 else 24
        key = shapes.key(int(rng.integers(KEY_LENGTHS[0], most + 1)))
        out += [(1, left[-SIDE:], key[a:b], (key[b:] + right)[:SIDE]) for a, b in cores(0, len(key))[:1]]
    for kind in HARMLESS:
        made = 0
        while made < DRAWN_OF_KIND:
            before, text = shapes.harmless(kind)
            left, right = context()
            if kind in CASED and rng.random() < 0.35:
                text = text.upper()
            text = left + before + text + right
            for a, b in runs([text])[0]:
                if not base_findings(text, [(a, b)]):
                    out += [(0, *around(text, *core)) for core in cores(a, b)]
            made += 1
    return out


def fit(rows: list[tuple[int, str, str, str]], seed: int = 11) -> Network:
    """Network of labelled rows and drawn ones; every fifth row of either label is held out for calibration."""
    rng = np.random.default_rng(seed)
    drawn = drawn_rows(rows, rng)

    def part(held_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Labelled rows in all their guises, drawn rows as they are."""
        chosen = [[r for k in (1, 0) for i, r in enumerate(r for r in kind if r[0] == k) if (i % 5 == 4) == held_out] for kind in (rows, drawn)]
        made = [examples(chosen[0], rng)] if chosen[0] else []
        made.append((np.array([codes(*r[1:]) for r in chosen[1]]), np.array([r[0] for r in chosen[1]], float)))
        return np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made])

    x, y = part(False)
    network = Network.start(rng)
    network.learn(x, y, rng, rounds=ROUNDS)
    network.calibrate(*part(True))
    return network


def scan_texts(texts: list[str], network: Network | None = None) -> list[list[tuple[int, int, int, int, float]]]:
    """Sorted (start, kind, end, secret start, probability) of each text; base findings have 1.0."""
    all_runs = runs(texts)
    out, asked, rows = [], [], []
    for j, (body, found) in enumerate(zip(texts, all_runs)):
        base = base_findings(body, found)
        out.append([(*f, 1.0) for f in base])
        if network is not None:
            for run in found:
                for a, b in parts(body, *run, base) if base else [run]:
                    read = cores(a, b)
                    asked.append((j, a, b, len(read)))
                    rows += [codes(*around(body, *core)) for core in read]
    if rows:
        x, at = np.array(rows), 0
        made, cut = network.probability(x), np.array(network.thresholds)[bands(x)]
        for j, a, b, n in asked:
            best = at + int((made[at:at + n] - cut[at:at + n]).argmax())
            at += n
            if made[best] >= cut[best]:
                out[j].append((a, 3, b, a, float(made[best])))
    return [sorted(f) for f in out]


def redacted(text: str, findings: list[tuple]) -> str:
    """Text with every found secret (not its keyword) replaced by a mark."""
    kept, at = [], 0
    for low, high in sorted((f[3], f[2]) for f in findings):
        if low >= at:
            kept += [text[at:low], MASK]
        at = max(at, high)
    return "".join([*kept, text[at:]])


FINDINGS = "findings array<struct<start:bigint,kind:string,end:bigint,secret_start:bigint,probability:double>>"
FINDINGS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()),
                                     ("secret_start", pa.int64()), ("probability", pa.float64())]))


def scan(docs: DataFrame, network: Network | None, text: str = "text", keep: list[str] | None = None,
         clean: str | None = None) -> DataFrame:
    """``keep`` (default: all columns but the text) and ``findings``; ``clean`` names a column for the redacted text."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep

    def make() -> Callable:
        def work(texts: list[str]) -> dict[str, pa.Array]:
            found = scan_texts(texts, network)
            made = {"findings": pa.array([[{"start": f[0], "kind": KINDS[f[1]], "end": f[2], "secret_start": f[3],
                                            "probability": f[4]} for f in row] for row in found], FINDINGS_ARROW)}
            if clean:
                made[clean] = pa.array([redacted(t, f) if f else t for t, f in zip(texts, found)], pa.string())
            return made
        return work

    return per_text(docs, keep, text, FINDINGS + (f", `{clean}` string" if clean else ""), make)


def cleaned(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in ``text`` replaced by a mark."""
    plain, new = plain_names(docs)
    rest = [made for name, made in new.items() if name != text]
    return own_names(scan(plain, network, new[text], rest, clean=new[text]), new)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scan(docs, train(docs), keep=["doc_id"])

    def count(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(rows):
        return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
