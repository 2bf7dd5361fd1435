"""Operator 1: secret scans with a character convolutional network.

Three kinds of finding are fixed by pattern.  Every candidate (those, every run of token
characters of two classes or more, every URL with a user and a password, every private key
with its body) is scored, with the characters around it, by a small network in numpy:
characters are embedded, convolved, max-pooled apart over left context, candidate and right
context, and combined by one logistic unit.  Pooling takes a candidate of any length whole.
The network is trained here on labelled findings that are made by rule from a seed; scores
are calibrated by Platt's method on findings kept apart, and each kind has the highest
threshold whose recall is at least RECALL, measured on the spans that the search for
candidates gives for them; a finding that it does not give counts as lost.  Look-alikes are
of named forms (words, identifiers, calls, paths, UUIDs, data in URIs, public keys and more);
where one of them is reported more often than FALSE, the threshold is raised until it is
not, at a recall of RECALL_LEAST or more.

Pattern findings always stay.  Another candidate is added when its score reaches the
threshold of its kind, no added one before it reaches into it, and pattern findings cover
less than half of it.

Null and empty texts have no findings.  A finding lies inside one text and depends on that
text alone, whatever bytes it holds.  Texts are scanned whole, in time in proportion to
their length.  Of candidates that begin together the one of the earlier kind comes first.
Repeated rows give equal rows; an empty table gives an empty table; extra columns are
ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, need, utf8

KINDS = ("assign", "access", "hex", "token", "url", "pem")
BASE = KINDS[:3]
#: Share of the labelled secrets of the calibration set that each threshold must keep.
RECALL = 0.98
#: Share of each form of look-alike that may be reported, and the recall that holds whatever it is.
FALSE, RECALL_LEAST = 0.02, 0.96
TRAINING_ROWS = 10000
CONTEXT = 24
WIDTH, EMBED, FILTERS = 7, 8, 24
#: Characters that inference convolves at a time.
STEP = 1 << 16

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LOGIN = re.compile(rb"://[^\s/:@\0]+:[^\s/:@\0]+@")
PEM = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
PEM_END = re.compile(rb"-----END [A-Z0-9 ]*PRIVATE KEY-----")
PEM_BODY = re.compile(rb"[A-Za-z0-9+/=\s:,.-]*\Z")
#: Lines of a key whose end is not there.
PEM_LINES = re.compile(rb"(?:\s+[A-Za-z0-9+/=]{32,})*(?:\s+[A-Za-z0-9+/]+={1,2})?")
#: A name and an equals sign before more of a run.
NAMED = re.compile(rb"[A-Za-z_][A-Za-z0-9_-]*=(?=[^=])")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 16


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX = _class(b"0123456789abcdef")
_TOKEN = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_LOWER, _UPPER, _DIGIT = _class(b"abcdefghijklmnopqrstuvwxyz"), _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"0123456789")
_SCHEME = _class(b"abcdefghijklmnopqrstuvwxyz0123456789+.-")
_FIRST_LETTER = re.compile(rb"[a-z]")


def _runs(mask: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of maximal runs of at least ``least`` marked bytes."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    runs = edges.reshape(-1, 2)
    return runs[runs[:, 1] - runs[:, 0] >= least]


def _all(data: bytes, word: bytes) -> list[int]:
    out, at = [], data.find(word)
    while at >= 0:
        out.append(at)
        at = data.find(word, at + 1)
    return out


def _leftmost(data: bytes, starts: list[int], pattern: re.Pattern, ok) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that begin at one of the starts; of these, the
    ones that ``ok`` passes."""
    out, free = [], 0
    for at in sorted(starts):
        if at >= free and (m := pattern.match(data, at)):
            free = m.end()
            if ok(m):
                out.append((m.start(), m.end()))
    return out


def _logins(data: bytes) -> list[tuple[int, int]]:
    """URLs up to the sign after a user and a password.  Neither goes past a delimiter, so
    the search looks at each character a few times at most."""
    out, free = [], 0
    for at in _all(data, b"://"):
        if at < free or not (m := LOGIN.match(data, at)):
            continue
        start = at
        while start > free and _SCHEME[data[start - 1]]:
            start -= 1
        if s := _FIRST_LETTER.search(data, start, at):
            out.append((s.start(), m.end()))
            free = m.end()
    return out


def _keys(data: bytes) -> list[tuple[int, int]]:
    """Private keys: from the header to the end mark, or, where none follows the body, the
    lines of the body that are there."""
    out = []
    for m in PEM.finditer(data):
        dashes = data.find(b"-----", m.end())
        end = PEM_END.match(data, dashes) if dashes >= 0 else None
        if end and PEM_BODY.match(data, m.end(), dashes):
            out.append((m.start(), end.end()))
        else:
            out.append((m.start(), PEM_LINES.match(data, m.end()).end()))
    return out


def candidates(texts: list[bytes]) -> tuple[bytes, np.ndarray, list[tuple[int, int, int]]]:
    """The texts joined by zero bytes, where each begins, and (start, end, kind) of every
    candidate.  No pattern here matches a zero byte, so none crosses from text to text."""
    data = b"\0".join(texts)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    raw = np.frombuffer(data, np.uint8)
    lower = data.lower()
    found = [(s, e, 0) for s, e in _leftmost(data, [p for w in KEYWORDS for p in _all(lower, w)], ASSIGN, lambda m: len(m[2]) >= MIN_VALUE)]
    found += [(s, e, 1) for s, e in _leftmost(data, _all(data, b"AKIA"), ACCESS, lambda m: len(m[0]) >= MIN_ACCESS)]
    found += [(int(s), int(e), 2) for s, e in _runs(_HEX[raw], MIN_HEX)]
    # Two of: small letters, capitals after the first character, digits; a word has one.
    # A name and the sign after it are context, not a part of the candidate.
    for s, e in _runs(_TOKEN[raw], MIN_TOKEN).tolist():
        while m := NAMED.match(data, s, e):
            s = m.end()
        if e - s >= MIN_TOKEN and bool(_LOWER[raw[s:e]].any()) + bool(_UPPER[raw[s + 1 : e]].any()) + bool(_DIGIT[raw[s:e]].any()) > 1:
            found.append((s, e, 3))
    found += [(s, e, 4) for s, e in _logins(data)]
    found += [(s, e, 5) for s, e in _keys(data)]
    return data, begin, found


# ---------------------------------------------------------------- the network


class Spans:
    """Characters of candidates one after another: CONTEXT before (zero outside the text),
    the candidate whole, CONTEXT after; zeros keep the convolution of one from the next."""

    def __init__(self, data: bytes, spans: list[tuple[int, int]], edges: list[tuple[int, int]]):
        gap = bytes(WIDTH // 2)
        parts, self.body = [], np.array([e - s for s, e in spans], np.int64)
        for (s, e), (lo, hi) in zip(spans, edges, strict=True):
            left, right = data[max(lo, s - CONTEXT) : s], data[e : min(hi, e + CONTEXT)]
            parts += [gap, left.rjust(CONTEXT, b"\0"), data[s:e], right.ljust(CONTEXT, b"\0"), gap]
        self.chars = np.frombuffer(b"".join(parts), np.uint8)
        size = self.body + 2 * CONTEXT + 2 * len(gap)
        first = np.cumsum(size) - size + len(gap)
        #: Where the three segments of each begin, and where the last one ends.
        self.cuts = np.stack([first, first + CONTEXT, first + CONTEXT + self.body, first + 2 * CONTEXT + self.body], axis=1)

    def __len__(self) -> int:
        return len(self.body)

    def matrix(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of some spans as rows, zeros after the shorter ones; and lengths of
        their bodies."""
        wide = int(self.body[at].max()) + 2 * CONTEXT
        out = np.zeros((len(at), wide), np.uint8)
        for row, (first, _, _, end) in zip(out, self.cuts[at].tolist(), strict=True):
            row[: end - first] = self.chars[first:end]
        return out, self.body[at]


class Network:
    """Embedding, convolution, rectifier, max-pool per segment, logistic unit."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embedding[0] = 0
        self.kernel = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weight = rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.slope, self.offset = 1.0, 0.0
        #: A threshold for each kind beyond the base.
        self.thresholds = dict.fromkeys(range(len(BASE), len(KINDS)), 0.5)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.kernel, self.shift, self.weight, self.bias]

    def forward(self, x: np.ndarray, body: np.ndarray):
        """For training: rows of characters and lengths of their bodies."""
        n, length = x.shape
        padded = np.pad(x, ((0, 0), (WIDTH // 2, WIDTH // 2)))
        index = np.lib.stride_tricks.sliding_window_view(padded, WIDTH, axis=1)
        columns = self.embedding[index].reshape(n, length, WIDTH * EMBED)
        act = np.ascontiguousarray(np.maximum(columns @ self.kernel + self.shift, 0).transpose(0, 2, 1))
        place, cut = np.arange(length - CONTEXT), body[:, None]
        inside = [place < cut, (place >= cut) & (place < cut + CONTEXT)]
        at = [act[:, :, :CONTEXT].argmax(axis=2)] + [CONTEXT + np.where(m[:, None], act[:, :, CONTEXT:], np.float32(-1)).argmax(axis=2) for m in inside]
        pooled = np.concatenate([np.take_along_axis(act, a[:, :, None], axis=2)[:, :, 0] for a in at], axis=1)
        return pooled @ self.weight + self.bias, pooled, at, columns, index

    def logits(self, spans: Spans) -> np.ndarray:
        """The same values for spans of any length: the convolution is a sum of one table
        look-up for each place of the kernel, pooled piece by piece."""
        if not len(spans):
            return np.zeros(0, np.float32)
        tables = [self.embedding @ self.kernel[k * EMBED : (k + 1) * EMBED] for k in range(WIDTH)]
        pooled = np.zeros((3 * len(spans), FILTERS), np.float32)  # the rectifier's least value
        starts, ends = spans.cuts[:, :3].ravel(), spans.cuts[:, 1:].ravel()
        half = WIDTH // 2
        for low in range(0, len(spans.chars), STEP):
            high = min(low + STEP, len(spans.chars))
            near = np.pad(spans.chars[max(low - half, 0) : high + half], (max(half - low, 0), max(high + half - len(spans.chars), 0)))
            act = tables[0][near[: high - low]]
            for k in range(1, WIDTH):
                act = act + tables[k][near[k : k + high - low]]
            act = np.maximum(act + self.shift, 0)
            some = np.flatnonzero((starts < high) & (ends > low) & (ends > starts))
            if len(some):
                edges = np.stack([np.maximum(starts[some], low), np.minimum(ends[some], high)], axis=1).ravel() - low
                tops = np.maximum.reduceat(np.concatenate([act, np.zeros((1, FILTERS), np.float32)]), edges, axis=0)[::2]
                pooled[some] = np.maximum(pooled[some], tops)
        return pooled.reshape(len(spans), -1) @ self.weight + self.bias

    def score(self, spans: Spans) -> np.ndarray:
        """Calibrated probability."""
        return 1 / (1 + np.exp(-(self.slope * self.logits(spans).astype(np.float64) + self.offset)))

    def gradients(self, x: np.ndarray, body: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z, pooled, at, columns, index = self.forward(x, body)
        n = len(x)
        dz = ((1 / (1 + np.exp(-z)) - y) / n).astype(np.float32)
        d_weight, d_bias = pooled.T @ dz, dz.sum(keepdims=True)
        d_pooled = dz[:, None] * self.weight * (pooled > 0)
        d_kernel, d_embedding, d_shift = (np.zeros_like(p) for p in (self.kernel, self.embedding, self.shift))
        rows = np.arange(n)
        chars, back = [], []
        for k, a in enumerate(at):
            d = d_pooled[:, k * FILTERS : (k + 1) * FILTERS]
            d_shift += d.sum(axis=0)
            d_kernel += np.einsum("nfc,nf->cf", columns[rows[:, None], a], d)
            chars.append(index[rows[:, None], a].ravel())
            back.append((d[:, :, None] * self.kernel.T).reshape(-1, EMBED))
        chars, back = np.concatenate(chars), np.concatenate(back)
        for j in range(EMBED):
            d_embedding[:, j] = np.bincount(chars, back[:, j], 256)
        d_embedding[0] = 0
        return [d_embedding, d_kernel, d_shift, d_weight, d_bias]

    def fit(self, spans: Spans, y: np.ndarray, epochs: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        params = self.parameters()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            # Long candidates share batches of their own; batches come in any order.
            order = rng.permutation(len(y))
            order = order[np.argsort(np.digitize(spans.body[order], (40, 96)), kind="stable")]
            for i in rng.permutation(np.arange(0, len(y), 128)):
                at, t = order[i : i + 128], t + 1
                for p, g, a, b in zip(params, self.gradients(*spans.matrix(at), y[at]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= 0.005 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, spans: Spans, y: np.ndarray) -> None:
        """Platt scaling by Newton's method."""
        z = self.logits(spans).astype(np.float64)
        pos, neg = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        w = np.zeros(2)
        design = np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ w))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (p - target) + 1e-6 * w)
            w -= step
            if abs(step).max() < 1e-9:
                break
        self.slope, self.offset = float(w[0]), float(w[1])

    def choose(self, kind: int, good: np.ndarray, recall: float, lost: int, bad: dict[str, np.ndarray]) -> None:
        """The highest threshold of a kind that keeps the recall over its secrets' scores
        and ``lost`` more that have none; raised where a form of look-alike (``bad``: its
        scores) is above it more often than FALSE, as far as RECALL_LEAST allows."""
        if not len(good):
            return
        good = np.sort(good)
        keeping = lambda share: float(good[min(max(int(np.floor((1 - share) * (len(good) + lost))) - lost, 0), len(good) - 1)])
        # The least value that leaves FALSE of a form at or above it.
        wanted = [float(np.nextafter(np.sort(v)[::-1][int(FALSE * len(v))], 2)) for v in bad.values() if len(v)]
        first = keeping(recall)
        self.thresholds[kind] = max(first, min(max([first, *wanted]), keeping(min(recall, RECALL_LEAST))))


#: Words that identifiers, paths and look-alikes of training are made of, beside invented ones.
WORDS = tuple(
    """about access account action active address agent allow alpha apply array assert async attribute average back backend balance base batch before billing binary block
    body boolean border bottom branch buffer build bundle button cache call cancel canvas card case category center change channel char check child class clear click client
    clone close cluster code collection color column command comment common complete config connect constant container content context control copy core count create current
    custom data database date debug decode default delete demo depth detail device dialog directory disable display document domain download driver dynamic edit element empty
    enable encode engine entry error event example execute export factory field file filter find first flag float flush font format frame function general global graph group
    handle handler hash header height helper hidden history home host icon image import index info init input insert instance integer invoice item job join key kind label
    language layer layout length level library line link list listen load local lock login main manager map mask memory menu message""".split()
)
COMMON = tuple("the a of and to in is for with on at by from as this that it be are was or not use used see value note here some other please set more quick".split())
#: First characters of files that stand in data URIs, base64: PNG, JPEG, GIF, WOFF2, SVG.
MAGIC = ("iVBORw0KGgoAAAANSUhEUgAA", "/9j/4AAQSkZJRgABAQ", "R0lGODlh", "d09GMgABAAAAA", "PHN2ZyB4bWxucz0i")


def made(rows: int, seed: int) -> list[tuple[bytes, int, int, int, str]]:
    """(text, start, end, label, form) of findings by rule: secrets of many forms in the
    places where they stand, and look-alikes where those stand.  Words of look-alikes are
    real ones (WORDS) or invented, spelt by random letters or by syllables."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, n: "".join(rng.choice(list(chars), int(n)))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    heads, vowels, tails = ("b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "tr", "ch", "sh", "pl", "gr", "qu", "j", "k"), "aeiou", ("", "", "n", "r", "s", "t", "l", "ng", "st", "ck", "x", "y", "m")
    random_word = lambda: pick(low, rng.integers(2, 9))
    syllables = lambda: "".join(rng.choice(heads) + pick(vowels, rng.integers(1, 3)) + rng.choice(tails) for _ in range(rng.integers(1, 4)))
    real = lambda: str(rng.choice(WORDS)) if rng.random() < 0.6 else syllables()
    word = lambda: real() if rng.random() < 0.7 else random_word()
    near = lambda: [lambda: str(rng.choice(COMMON)), word, lambda: pick(dig, rng.integers(1, 6)), lambda: word() + pick(dig, rng.integers(1, 4)) + pick(",.;", 1), lambda: f"{word()}://{word()}", lambda: f"{word()} {pick('=:', 1)} {word()}"][np.searchsorted((0.38, 0.85, 0.9, 0.95, 0.97), rng.random())]()
    words = lambda a, b: " ".join(near() for _ in range(rng.integers(a, b)))
    name = lambda: rng.choice(["secret", "token", "api_key", "auth", "access_key", "private_key", "credential", "bearer", "client_secret", "passphrase", "pwd", "signing_key"])
    plain = lambda: rng.choice(["id", "order", "page", "ref", "invoice", "card", "phone", "file", "version", "build", "commit", "checksum", "isbn", "date", "track"])
    initials = lambda: pick(up, rng.integers(2, 5))
    piece = lambda: [initials, lambda: real()[: rng.integers(2, 5)].capitalize(), real, lambda: real().capitalize()][np.searchsorted((0.1, 0.22, 0.28), rng.random())]()
    titled = lambda a, b: "".join(piece() for _ in range(rng.integers(a, b)))
    filled = lambda x: x if len(x) >= MIN_TOKEN else x + "".join(real().capitalize() for _ in range(4))
    number = lambda share: pick(dig, rng.integers(1, 4)) if rng.random() < share else ""
    part = lambda: rng.choice([real, real, lambda: real() + pick("-_", 1) + real(), lambda: titled(1, 4), lambda: real() + number(1)])()

    def secret() -> str:
        return [
            lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])),
            lambda: pick(low + up + dig, rng.integers(20, 44)),
            lambda: pick(low + up + dig + "+/", rng.integers(24, 60)) + "=" * int(rng.integers(0, 3)),
            lambda: "AKIA" + pick(up + dig, 16),
            lambda: rng.choice(["sk", "pk", "key", "tok", "pat", real(), real()[:3]]) + rng.choice(["_", "-"]) + (real()[:5] + rng.choice(["_", "-"]) if rng.random() < 0.3 else "") + pick(low + up + dig, rng.integers(18, 40)),
            lambda: pick(low, rng.integers(3, 6)) + "".join("-" + pick(dig, rng.integers(9, 14)) for _ in range(rng.integers(1, 3))) + "-" + pick(low + up + dig, rng.integers(20, 36)),
            lambda: pick(low + up + dig + "_-", rng.integers(24, 44)),
            lambda: "eyJ" + pick(low + up + dig + "_-", rng.integers(24, 60)),
            lambda: pick(low + up, rng.integers(20, 44)),
            lambda: pick(up + dig, rng.integers(24, 40)),
        ][rng.integers(10)]()

    scheme = lambda: rng.choice(["http", "https", "ftp", "ssh", "postgres", "mysql", "redis", "amqp", "mongodb", "smtp", real()])
    host = lambda: real() + rng.choice([".example", ".internal", "", ":" + pick(dig, 4), ".org/" + real()]) + rng.choice([" ", "/", "\n"]) + words(0, 3)
    forms = {
        "digits": lambda: pick(dig, rng.integers(16, 20)),
        "card": lambda: "-".join(pick(dig, 4) for _ in range(4)),
        "uuid": lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        "upper_uuid": lambda: "-".join(pick("0123456789ABCDEF", n) for n in (8, 4, 4, 4, 12)),
        "numbered": lambda: "_".join(word() for _ in range(3)) + "_" + pick(dig, rng.integers(3, 6)),
        "short_path": lambda: "/".join(word() for _ in range(3)) + "/" + pick(dig, 4),
        "time": lambda: f"20{pick(dig, 2)}-{pick('01', 2)}-{pick('012', 2)}T{pick('012', 2)}-{pick('012345', 2)}-00",
        "slug": lambda: "-".join(word() for _ in range(rng.integers(4, 9))) + "-" + pick(dig, rng.integers(1, 4)),
        "leader": lambda: word() + pick("=-_", 1) * int(rng.integers(8, 20)) + pick(dig, 4),
        "word_and_number": lambda: pick(low, rng.integers(14, 24)) + pick(dig, rng.integers(3, 5)),
        "small_letters": lambda: pick(low, rng.integers(16, 30)),
        "capitals": lambda: pick(up, rng.integers(16, 30)),
        "title": lambda: filled("".join(word().capitalize() for _ in range(rng.integers(3, 6)))),
        "joined": lambda: pick("-_/", 1).join(word() for _ in range(rng.integers(3, 6))).ljust(16, "e"),
        "rule": lambda: pick("=-_", 1) * int(rng.integers(16, 60)),
        "class_name": lambda: filled(titled(2, 6) + number(0.1)),
        "call": lambda: filled(real() + titled(1, 5) + number(0.1)),
        "snake": lambda: filled(pick("_", rng.integers(0, 3)) + "_".join(real() + number(0.1) for _ in range(rng.integers(3, 7))) + number(0.3)),
        "constant": lambda: "_".join(real().upper() for _ in range(rng.integers(3, 6))) + "_" + pick(dig, rng.integers(1, 4)),
        "path": lambda: filled(rng.choice(["", "/", "src/", "com/"]) + "/".join(part() for _ in range(rng.integers(2, 9)))),
        "module": lambda: filled("/".join(real() for _ in range(rng.integers(2, 7))) + "/" + titled(1, 5)),
    }

    out = []
    for k in range(rows):
        kind, good = rng.integers(8), k % 2
        form = "url" if kind == 7 else "pem"
        if kind == 7 and good:
            value = [lambda: pick(low + up + dig, rng.integers(6, 20)), lambda: pick(low + dig, rng.integers(6, 16)), lambda: real() + pick(dig + "!$_-", rng.integers(2, 6)), lambda: real().capitalize() + pick("-_!.", 1) + real() + pick(dig, 2)][rng.integers(4)]()
            left, body, right = words(1, 5) + " ", f"{scheme()}://{real()}:{value}@", host()
        elif kind == 7 and rng.random() < 0.3:
            left, body, right = words(1, 5) + " ", f"{scheme()}://{real()}:{rng.choice(['port', 'xx', 'xxxx', '0', 'user', 'pass', 'password', '****', '$PASSWORD', '<password>', '{password}', '...', 'PASSWORD'])}@", host()
        elif kind == 6 and good:
            of = rng.choice(["", "RSA ", "EC "])
            lines = "\n".join(pick(low + up + dig + "+/", 64) for _ in range(rng.integers(1, 4)))
            left, body, right = words(1, 4) + "\n", f"-----BEGIN {of}PRIVATE KEY-----\n{lines}" + f"\n-----END {of}PRIVATE KEY-----" * int(rng.random() < 0.7), "\n" + words(1, 4)
        else:
            form = "token" if good else str(rng.choice([*forms, *["uuid", "class_name"] * 4, *["upper_uuid", "call", "snake"] * 2]))
            body = secret() if good else forms[form]()
            key = name() if rng.random() < (0.5 if good else 0.15) else plain() if rng.random() < 0.4 else real()
            left = words(2, 6) + [lambda: f" {key} = \"", lambda: f" {key}: ", lambda: f" {key}=", lambda: f" {key} ", lambda: " "][rng.integers(5)]()
            right = rng.choice(["\" ", " ", "\n", ", ", ". "]) + words(1, 5)
            if not good and (form := form if rng.random() < 0.8 else str(rng.choice(["data_uri", "public_key", "integrity", "url_path"]))) in ("data_uri", "public_key", "integrity", "url_path"):
                data = pick(low + up + dig + "+/", rng.integers(24, 140))
                left, body = left + {"data_uri": f"{rng.choice(['src=', 'url(', ''])}data:{rng.choice(['image/png', 'image/jpeg', 'image/gif', 'font/woff2', 'image/svg+xml', 'application/pdf'])};base64,", "public_key": "ssh-" + rng.choice(["rsa", "ed25519"]) + " ", "integrity": rng.choice(["integrity=\"", "integrity: ", ""]), "url_path": f"{rng.choice(['http', 'https'])}://{rng.choice(['www.', ''])}{real()}."}[form], {"data_uri": (str(rng.choice(MAGIC)) if rng.random() < 0.7 else "") + data + "=" * int(rng.integers(0, 3)), "public_key": "AAAA" + rng.choice(["B3NzaC1yc2EAAAADAQABAAAB", "C3NzaC1lZDI1NTE5AAAAI"]) + data, "integrity": rng.choice(["sha256-", "sha384-", "sha512-"]) + pick(low + up + dig + "+/", rng.choice([43, 64, 86])) + "=" * int(rng.integers(0, 3)), "url_path": filled(rng.choice(["com/", "org/", "net/", "de/"]) + "/".join(part() for _ in range(rng.integers(1, 7))))}[form]
            elif not good:
                left, right = left + rng.choice(["", "", "", "", "", "org.example.", "new ", "self.", "("]), rng.choice([right, right, right, right, "() " + words(1, 3), "(" + words(1, 3) + ") ", "." + rng.choice(["java", "py", "md", "json", "html"]) + " " + words(1, 3), ";\n" + words(1, 3), "." + real() + "() "])
        if rng.random() < 0.15:  # at the start or the end of a text
            left, right = (left.lstrip()[len(left.lstrip().rsplit(" ", 1)[0]) :].lstrip(), right) if rng.random() < 0.6 else (left, "")
        start = len(left.encode())
        out.append(((left + body + right).encode(), start, start + len(body.encode()), int(good), form))
    return out


def labelled(rows: int, seed: int) -> tuple[Spans, np.ndarray]:
    """Spans and labels of findings by rule."""
    some = made(rows, seed)
    begin = np.cumsum([0] + [len(t) for t, *_ in some]).tolist()
    spans = [(b + s, b + e) for b, (_, s, e, *_) in zip(begin, some, strict=False)]
    return Spans(b"".join(t for t, *_ in some), spans, list(zip(begin, begin[1:], strict=False))), np.array([r[3] for r in some], np.float32)


def spotted(some: list[tuple[bytes, int, int, int, str]]) -> list[tuple[int, int, int] | None]:
    """For each finding the candidate beyond the base that overlaps it most, and by half
    at least, as (start, end, kind); (0, 0, 0) where a pattern finds it; None else."""
    out: list[tuple[int, int, int] | None] = []
    for t, s, e, *_ in some:
        _, _, found = candidates([t])
        share = lambda f: min(f[1], e) - max(f[0], s)  # noqa: B023, E731
        near = [f for f in found if share(f) > 0]
        best = max((f for f in near if f[2] >= len(BASE)), key=share, default=None)
        out.append((0, 0, 0) if any(f[2] < len(BASE) for f in near) else best if best and 2 * share(best) >= e - s else None)
    return out


def _joined(some: list[tuple[bytes, int, int, int, str]], spans: list[tuple[int, int]]) -> Spans:
    begin = np.cumsum([0] + [len(t) for t, *_ in some]).tolist()
    return Spans(b"".join(t for t, *_ in some), [(b + s, b + e) for b, (s, e) in zip(begin, spans, strict=False)], list(zip(begin, begin[1:], strict=False)))


@lru_cache(maxsize=2)
def trained(rows: int = TRAINING_ROWS, seed: int = 17, recall: float = RECALL) -> Network:
    """Fitted on three quarters of the findings, as they are and as the search gives them;
    calibrated on the rest, as the search gives them."""
    some = made(rows, seed)
    seen = spotted(some)
    kept = rows * 3 // 4
    fit = [k for k in range(kept) if seen[k] and seen[k][2]]
    out = Network(seed)
    both = [*some[:kept], *[some[k] for k in fit]]
    out.fit(_joined(both, [r[1:3] for r in some[:kept]] + [seen[k][:2] for k in fit]), np.array([r[3] for r in both], np.float32), 8, seed)
    apart = [k for k in range(kept, rows) if seen[k] and seen[k][2]]
    spans, label, kind = _joined([some[k] for k in apart], [seen[k][:2] for k in apart]), np.array([some[k][3] for k in apart], np.float32), np.array([seen[k][2] for k in apart])
    out.calibrate(spans, label)
    score, form = out.score(spans), np.array([some[k][4] for k in apart])
    for k in range(len(BASE), len(KINDS)):
        lost = sum(1 for i in range(kept, rows) if seen[i] is None and some[i][3] and some[i][4] == KINDS[k])
        of = (kind == k) & (label == 0)
        out.choose(k, score[(kind == k) & (label > 0)], recall, lost, {str(f): score[of & (form == f)] for f in np.unique(form[of])})
    return out


# ---------------------------------------------------------------- the operator


def find(texts: list[bytes], network: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, kind, score) of each text's findings by start, then kind; code points."""
    data, begin, found = candidates(texts)
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if not found:
        return out
    found.sort(key=lambda x: (x[0], x[2]))
    doc = np.searchsorted(begin, [f[0] for f in found], side="right") - 1
    ends = begin + [len(t) for t in texts]
    score = network.score(Spans(data, [f[:2] for f in found], [(int(begin[d]), int(ends[d])) for d in doc]))
    # Base findings as intervals apart, and how many characters those before each cover.
    low, high, before = [], [], [0]
    for s, e, k in found:
        if k < len(BASE):
            if low and s < high[-1]:
                before[-1] += max(e - high[-1], 0)
                high[-1] = max(high[-1], e)
            else:
                low.append(s)
                high.append(e)
                before.append(before[-1] + e - s)

    def covered(at: int) -> int:
        i = bisect_left(low, at)
        return before[i] - max(high[i - 1] - at, 0) if i else 0

    by: dict[int, list[tuple[int, int, int, float]]] = {}
    free = 0
    for (s, e, k), d, p in zip(found, doc.tolist(), score.tolist(), strict=True):
        if k >= len(BASE):
            if p < network.thresholds[k] or s < free or 2 * (covered(e) - covered(s)) >= e - s:
                continue
            free = e
        by.setdefault(d, []).append((s - int(begin[d]), e - int(begin[d]), k, p))
    for d, kept in by.items():
        raw = np.frombuffer(texts[d], np.uint8)
        points = np.cumsum((raw & 0xC0) != 0x80)
        at = lambda i: int(points[i - 1]) if i else 0  # noqa: B023, E731
        out[d] = [(at(s), at(e), k, p) for s, e, k, p in kept]
    return out


def spell(rows: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in rows)


def scan(df: DataFrame, *, network: Network | None = None) -> DataFrame:
    """doc_id, findings (array of kind, start, end, score) and base digest columns."""
    network = network or trained()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find(utf8(batch.column(1)), network)
        base = [[r for r in rows if r[2] < len(BASE)] for rows in found]
        count = lambda k: pa.array([sum(r[2] == k for r in rows) for rows in base], pa.int64())
        structs = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, e, k, p in rows] for rows in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
        cols = [batch.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(spell(r).encode()).hexdigest() for r in base]), pa.array([spell(r) for r in found]), structs]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"])

    return arrow_map(need(df, "doc_id", "text"), work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<kind: string, start: long, end: long, score: double>>")


def redact(df: DataFrame, *, network: Network | None = None, text: str = "text") -> DataFrame:
    """The rows with every finding replaced by [kind]; rows without findings as they were."""
    network = network or trained()
    names = df.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = names.index(text)
        old = batch.column(i).to_pylist()
        new = list(old)
        for k, rows in enumerate(find(utf8(batch.column(i)), network)):
            out, at = [], 0
            for s, e, kind, _ in rows:
                if s >= at:
                    out += [old[k][at:s], f"[{KINDS[kind]}]"]
                at = max(at, e)
            if rows:
                new[k] = "".join([*out, old[k][at:]])
        cols = [pa.array(new, c.type) if j == i else c for j, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(df, work, df.schema, text)


def report(df: DataFrame) -> DataFrame:
    return scan(df).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.size("findings").cast("long").alias("n_findings"))
