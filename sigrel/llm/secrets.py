"""Secret scans: fixed patterns, and a linear-chain conditional random field decoded by Viterbi."""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import Vocabulary

# The base patterns and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
_KEYS = (b"passw", b"secret", b"token", b"api")
# Words that announce a secret.
_NAMES = rb"(?:password|passwd|passphrase|pwd|secret|token|bearer|api_?key|credential|auth|authorization|private_?key|access_?key|secret_?key)s?"
_MORE = rb"(?:[_-](?:id|key|value|string|hash))?[\"']?"
_KEY_END = re.compile(_NAMES + _MORE + rb"$")
_KEY_OPEN = re.compile(_NAMES + _MORE + rb"[:=]+[\"']?$")
_KEY_VALUE = re.compile(_NAMES + _MORE + rb"[:=]+[\"']?.")
#: What says by its form what it is: an address without a password, mail, IP address, date, time, version, file, path of words.
_NAMED = re.compile(
    rb"[a-z][a-z0-9+.-]{1,9}://(?![^/\s]*:[^/@\s]*@).*|(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,6}(?:[:/?].*)?|(?:mailto:)?[\w.+%-]+@[\w-]+(?:\.[\w-]+)*"
    rb"|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?:/\d+)?|(?:[0-9a-f]{0,4}:){3,7}[0-9a-f]{1,4}"
    rb"|\d{4}-?\d\d-?\d\d(?:[t_-]?\d\d[:.-]?\d\d.{0,16})?|\d\d?:\d\d(?::\d\d)?(?:\.\d+)?|v?\d+(?:\.\d+)+(?:[-+_][a-z0-9.]{1,12})?"
    rb"|[\w() ,@~#%+-]*(?:[./\\][\w() ,@~#%+-]+)*\.[a-z][a-z0-9]{0,4}|[./~\\]*(?:[a-z_-]{2,}[./\\])+[a-z_.-]*", re.IGNORECASE)  # fmt: skip
_LOGIN = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]{1,9}://[^/@:\s]*:([^/@\s]+)@")
_RUN = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Words whose letters and digits change kind more often than once in so many are like random strings.
SHORT_RUN = 3.5
_PREFIXED = re.compile(rb"[A-Za-z]{1,8}[_-](?:[A-Za-z]{2,8}[_-])?[A-Za-z0-9+/_-]{16,}")
_CORE = re.compile(rb"[A-Za-z0-9+/_.=-]+")
_MARKS = b"*#$%&"
_STRIP = b"\"'`.,;:!?()[]{}<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Bounds of the training sample: documents, stretches of words, planted stretches; words on each side of a secret.
SAMPLE_DOCS, SAMPLE_PARTS, PLANTED, SIDE = 6000, 3000, 2500, 8
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Bits of a word's shape, from the lowest.
BITS = ("key", "key and operator", "key and value", "operator", "AKIA", "plain", "8+", "16+", "32+", "hex", "digit", "mixed case", "quoted", "many changes", "upper and digits", "prefixed", "letters and digits", "short runs", "named")
#: Bits that are no features: the word holds a key of the fixed patterns, or could hold a long hex run.
_HAS_KEY, _LONG = 1 << len(BITS), 2 << len(BITS)
_ALL = (1 << len(BITS)) - 1
#: What a mask takes away from a planted secret's surroundings and its own start: announcing words and fixed prefixes.
_MASK = ~(1 | 2 | 4 | 16 | 1 << 15)


def base_spans(text: str | None, key: bool = True, long: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind, in code points.

    ``key`` and ``long`` say whether a word can hold a key name, or a run of 32 characters.
    """
    if not text:
        return []
    out = []
    if key:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if long:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def shape(word: bytes) -> int:
    """Bits of a word's shape."""
    if word.isalpha() and word.islower():  # most words: what the rest would come to
        n = len(word)
        s = bool(_KEY_END.search(word)) | 32 | (n >= 8) << 6 | (n >= 16) << 7 | (n >= 32) << 8
        return s | any(k in word for k in _KEYS) * _HAS_KEY | (n >= 32) * _LONG
    core = word.strip(_STRIP)
    low = word.lower()
    s = bool(_KEY_END.search(low)) | bool(_KEY_OPEN.search(low)) << 1 | bool(_KEY_VALUE.search(low)) << 2 | (word in (b"=", b":", b":=", b"=>", b"==")) << 3
    s |= core.startswith(b"AKIA") << 4 | bool(_CORE.fullmatch(core)) << 5
    value = core.rpartition(b"=")[2].rpartition(b":")[2].strip(_STRIP) if s & 4 else core
    if login := _LOGIN.match(core):  # the address has a password before its host
        s, value = s | 4, login[1]
    n = len(value)
    s |= (n >= 8) << 6 | (n >= 16) << 7 | (n >= 32) << 8
    if not value.isalpha():
        kinds = bytes(1 if 48 <= c <= 57 else 0 for c in value)
        digit = 1 in kinds
        s |= bool(n >= 8 and digit and not value.translate(None, b"0123456789abcdefABCDEF")) << 9 | digit << 10
        s |= (sum(a != b for a, b in zip(kinds, kinds[1:])) >= 4) << 13
        s |= (digit and value.isupper()) << 14
        s |= bool(_PREFIXED.fullmatch(value)) << 15
        s |= (digit and n >= 8 and sum(kinds) * 5 < 4 * n and value.isalnum()) << 16
        s |= bool(_NAMED.fullmatch(value if s & 4 else core.rstrip(_MARKS))) << 18
    if n >= 8 and not (value.islower() and value.isalpha()):
        runs = _RUN.findall(value)
        s |= (len(runs) > 3 and sum(map(len, runs)) < SHORT_RUN * len(runs)) << 17
    s |= (value != value.lower() and value[1:] != value[1:].upper() and value[1:] != value[1:].lower()) << 11
    s |= (word[:1] in (b'"', b"'", b"`")) << 12
    return s | any(k in low for k in _KEYS) * _HAS_KEY | (len(word) >= 32) * _LONG


def shapes_of(words: list[bytes]) -> np.ndarray:
    return np.array([shape(w) for w in words], np.int64)


@dataclass
class Crf:
    """Scores of a label: by bits of the word, the one before, the one two before and the one after, by file features."""

    weights: np.ndarray  # (bits + 1, 4, 3), the last row of the first column being the bias
    file: np.ndarray  # (file features, 3)
    moves: np.ndarray  # (3, 3) from, to
    first: np.ndarray  # (3,)

    def tables(self) -> np.ndarray:
        """Scores for every shape there can be: (4, 2 ** bits, 3)."""
        n = len(BITS)
        t = np.zeros((4, 1 << n, 3), np.float32)
        for bit in range(n):  # the upper half of each power of two has its bit besides the lower half's
            t[:, 1 << bit : 2 << bit] = t[:, : 1 << bit] + self.weights[bit][:, None]
        t[0] += self.weights[n, 0]
        return t


def file_features(shapes: np.ndarray) -> np.ndarray:
    """What holds for a whole file: a key word occurs; many words are no plain ones."""
    return np.array([bool((shapes & _HAS_KEY).any()), len(shapes) > 0 and (shapes & 32 == 0).mean() > 0.3], np.float64)


def train(parts: list[tuple[list[int], list[int], list[float]]], steps: int = 120, rate: float = 0.2, decay: float = 1e-3) -> Crf:
    """Penalised conditional likelihood of labelled stretches by Adam; forward-backward runs over all at once.

    Equal stretches are one with a weight, and the scores of equal windows (a word's bits and its neighbours') are worked
    out once a step. Steps end early when ten of them have gained less than a ten-thousandth.
    """
    n = len(BITS)
    times = Counter((tuple(s), tuple(t), tuple(f)) for s, t, f in parts)
    k, most = max(1, len(times)), max((len(s) for s, _, _ in times), default=1)
    shapes, y, on = np.full((k, most), -1, np.int64), np.zeros((k, most), np.int64), np.zeros((k, most), bool)
    files, weight = np.zeros((k, 2)), np.ones(k)
    for i, ((own, tags, f), count) in enumerate(sorted(times.items())):
        shapes[i, : len(own)], y[i, : len(own)], on[i, : len(own)], files[i], weight[i] = own, tags, True, f, count
    weight /= weight.sum()
    pad = np.maximum(np.pad(shapes, ((0, 0), (2, 1)), constant_values=-1), 0)
    near = np.stack([pad[:, o : o + most] for o in (2, 1, 0, 3)], 2).reshape(-1, 4)
    windows, which = np.unique(near, axis=0, return_inverse=True)
    which = which.reshape(-1)
    x = (windows[:, :, None] >> np.arange(n) & 1).reshape(len(windows), 4 * n).astype(float)
    theta = [np.zeros((n, 4, 3)), np.zeros(3), np.zeros((2, 3)), np.zeros((3, 3)), np.zeros(3)]
    m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    gold = np.eye(3)[y] * on[..., None]
    pairs = on[:, 1:] & on[:, :-1]
    gold_moves = np.einsum("kta,ktb,kt,k->ab", gold[:, :-1], gold[:, 1:], pairs.astype(float), weight)
    gained: list[float] = []
    for step in range(1, (steps if parts else 0) + 1):
        w, bias, wf, moves, first = theta
        u = (x @ w.transpose(1, 0, 2).reshape(4 * n, 3))[which].reshape(k, most, 3) + bias + (files @ wf)[:, None]
        # forward and backward in probabilities, each place scaled to a sum of one
        top = u.max(2)
        eu, e = np.exp(u - top[..., None]), np.exp(moves)
        a, b, c = np.empty((k, most, 3)), np.ones((k, most, 3)), np.ones((k, most))
        a[:, 0] = eu[:, 0] * np.exp(first)
        for t in range(most):
            if t:
                a[:, t] = np.where(on[:, t, None], a[:, t - 1] @ e * eu[:, t], a[:, t - 1])
            c[:, t] = a[:, t].sum(1)
            a[:, t] /= c[:, t, None]
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(on[:, t + 1, None], (eu[:, t + 1] * b[:, t + 1]) @ e.T / c[:, t + 1, None], b[:, t + 1])
        z = np.log(c).sum(1) + (top * on).sum(1)
        held = ((gold * u).sum((1, 2)) + (gold[:, 0] * first).sum(1) - z) @ weight + (gold_moves * moves).sum()
        gained.append(float(held - decay / 2 * sum((t * t).sum() for t in theta)))
        if step > 40 and gained[-1] - gained[-11] < 1e-4 * abs(gained[-1]):
            break
        ahead = (a[:, :-1] * (pairs * weight[:, None])[..., None]).reshape(-1, 3)
        pm = e * (ahead.T @ (eu[:, 1:] * b[:, 1:] / c[:, 1:, None]).reshape(-1, 3))
        d = (a * b * on[..., None] - gold) * weight[:, None, None]
        by_window = np.stack([np.bincount(which, d[..., j].reshape(-1), len(windows)) for j in range(3)], 1)
        g = [(x.T @ by_window).reshape(4, n, 3).transpose(1, 0, 2), d.sum((0, 1)), files.T @ d.sum(1), pm - gold_moves, d[:, 0].sum(0)]
        for t, gt, s, v in zip(theta, g, m1, m2):
            gt = gt + decay * t
            s += 0.1 * (gt - s)
            v += 0.01 * (gt * gt - v)
            t -= rate * (s / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, bias, wf, moves, first = theta
    full = np.concatenate([w, np.zeros((1, 4, 3))])
    full[n, 0] = bias
    if not parts:
        full[n, 0, OUTSIDE] = 10.0
    return Crf(full, wf, moves, first)


def viterbi(scores: np.ndarray, moves: np.ndarray, first: np.ndarray | None, last: np.ndarray | None) -> list[int]:
    """The best labels of a stretch; ``first`` and ``last`` are added to the scores at its ends."""
    best, back = scores[0] + (0 if first is None else first), []
    for s in scores[1:]:
        x = best[:, None] + moves
        back.append(x.argmax(0))
        best = x.max(0) + s
    label = int((best + (0 if last is None else last)).argmax())
    out = [label]
    for b in reversed(back):
        out.append(label := int(b[label]))
    return out[::-1]


def decode(shapes: np.ndarray, f: np.ndarray, tables: np.ndarray, crf: Crf) -> list[tuple[int, int]]:
    """Runs of words that the best labelling of the whole chain has as secrets: [(first word, one past the last)].

    A label's score can gain no more from its two neighbours than twice the range of the moves, so where OUTSIDE leads by more it is in
    every best labelling, and Viterbi is run over the stretches between such words: the result is that of one run.
    """
    if not len(shapes):
        return []
    u = tables[0][shapes] + f @ crf.file
    u[1:] += tables[1][shapes[:-1]]
    u[2:] += tables[2][shapes[:-2]]
    u[:-1] += tables[3][shapes[1:]]
    spread = 2 * (np.ptp(crf.moves) + np.ptp(crf.first))
    open_ = u[:, OUTSIDE] - u[:, 1:].max(1) <= spread
    if not open_.any():
        return []
    edges = np.flatnonzero(np.diff(np.r_[0, open_.view(np.int8), 0]))
    runs = []
    for a, b in zip(edges[::2], edges[1::2]):
        tags = viterbi(u[a:b], crf.moves, crf.first if a == 0 else crf.moves[OUTSIDE], None if b == len(u) else crf.moves[:, OUTSIDE])
        start = None
        for i, t in enumerate([*tags, OUTSIDE]):
            if start is not None and t != INSIDE:
                runs.append((a + start, a + i))
                start = None
            if t == BEGIN or t == INSIDE and start is None:
                start = i
    return runs


def _token(rng: random.Random, n: int, letters: str = string.ascii_letters + string.digits) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def planted(rng: random.Random) -> tuple[list[str], list[int]]:
    """A made-up secret as words, and their labels: what people write around a random string, if anything."""
    hard, lower, base64 = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"
    value = _token(rng, rng.choice((10, 12, 16, 20, 24, 32, 36, 40, 64)), rng.choice((hard, hard, lower, base64, string.ascii_uppercase + string.digits, "0123456789abcdef")))
    if rng.random() < 0.3:
        value = rng.choice(("sk", "pk", "key", "xoxb", "tok", "app", "svc", "rk")) + rng.choice("_-") + rng.choice(("", "", "test_", "prod-")) + value
    if rng.random() < 0.2:
        value = ".".join((value, _token(rng, 24), _token(rng, 20)))
    name = rng.choice(("pwd", "password", "Bearer", "auth", "credential", "passphrase", "private_key", "token", "secret", "app_secret_id", "auth_key"))
    announced = rng.random() < 0.35
    if announced:  # what only the words around it give away
        value = rng.choice((_token(rng, rng.choice((8, 9, 10, 12, 14)), hard), _token(rng, rng.choice((8, 10, 12, 16)), hard + "!@#$%^&*_-"), "-".join(_token(rng, k, "0123456789abcdef") for k in (8, 4, 4, 4, 12))))
    quote = rng.choice(("", "", "", '"', "'", "`"))
    value = quote + value + quote
    form = rng.randrange(4) if announced else rng.randrange(7)
    if form == 0:
        return [name + ":", value], [OUTSIDE, BEGIN]
    if form == 1:
        return [name, rng.choice(("is", "=", "was", ":", "=>")), value], [OUTSIDE, OUTSIDE, BEGIN]
    if form == 2:
        return [f"{name}={value}"], [BEGIN]
    if form == 3:
        if rng.random() < 0.3:
            return [f"{rng.choice(('mysql', 'redis', 'amqp', 'https'))}://{rng.choice(('root', 'app', ''))}:{value.strip(quote)}@{rng.choice(('db1', 'cache.local', '10.0.0.7'))}/main"], [BEGIN]
        return ["Authorization:", name, value], [OUTSIDE, OUTSIDE, BEGIN]
    return [value + rng.choice(("", "", ",", "."))], [BEGIN]


def harmless(rng: random.Random) -> list[str]:
    """Words that look odd and are no secret: numbers, dates, addresses, names of things, versions."""
    n = lambda k: _token(rng, k, string.digits)
    w = lambda k=7: _token(rng, rng.randrange(3, k), string.ascii_lowercase)
    cap = lambda: w(9).capitalize()
    if rng.random() < 0.6:
        day, clock = f"20{n(2)}{{0}}{rng.randrange(1, 13):02}{{0}}{rng.randrange(1, 29):02}", f"{rng.randrange(24):02}{{0}}{rng.randrange(60):02}{{0}}{rng.randrange(60):02}"
        ending = rng.choice(("jpg", "png", "txt", "tar.gz", "csv", "py", "log", "JPG", "mp4", "html", "json", "java"))
        return [rng.choice((
            f"{rng.choice(('DSC', 'VID', 'scan', 'PXL', w(8)))}{rng.choice('_-')}{rng.choice((day.format(''), n(5)))}{rng.choice('_-')}{rng.choice((clock.format(''), n(6), w()))}.{ending}",
            f"{w(9)}{rng.choice('_-')}{w(9)}{rng.choice(('', n(2), '_v' + n(1), '-' + n(3)))}.{ending}",
            w(9) + cap() + cap() + rng.choice(("", cap(), n(1), n(2), "HTTP", "Id")) + rng.choice(("", "()", ",", ".")),
            cap() + cap() + rng.choice(("", n(1) + cap(), n(2))) + rng.choice(("", "." + w(9) + cap(), "::" + w() + cap())),
            f"{rng.choice(('http', 'https', 'ftp'))}://{rng.choice(('www.', '', w() + '.'))}{w(12)}.{rng.choice(('com', 'org', 'net', 'io', 'co.uk'))}/{w()}{rng.choice(('', '/' + w(), '/' + n(5)))}?{w(5)}={rng.choice((w(), n(6), _token(rng, 8)))}&{w(5)}={rng.choice((w(), n(3), _token(rng, 11)))}",
            day.format("-") + rng.choice("T_") + clock.format(rng.choice(":-")) + rng.choice(("Z", "", "+02:00", "." + n(3) + "Z")),
            day.format("") + "T" + clock.format("") + rng.choice(("", "Z")),
            f"{w()}{rng.choice(('.', '_', ''))}{w()}{rng.choice(('', n(2)))}@{w(12)}.{rng.choice(('com', 'org', 'de', 'co.uk'))}",
            f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}{rng.choice(('', ':8080', '/24'))}",
            "-".join(_token(rng, k, "0123456789abcdef") for k in (8, 4, 4, 4, 12)),
            f"{w().upper()}_{w().upper()}_{w().upper()}{rng.choice(('', '_' + n(2)))}",
            f"{w().upper()}-{n(4)}-{n(rng.randrange(2, 7))}",
            f"/{w()}/{w()}/{w()}{rng.choice(('', '/' + cap() + cap() + n(1)))}",
        ))]
    return rng.choice(([n(rng.randrange(3, 18))], [f"20{n(2)}-0{n(1)[:1]}-1{n(1)}"], [f"+{n(2)}-{n(3)}-{n(4)}"], [f"{w()}.{w()}{n(2)}@{w()}.com"], [f"https://{w()}.{w()}.org/{w()}/{w()}?id={n(5)}"], [f"v{n(1)}.{n(2)}.{n(1)}"], [f"{w(12)}_{w(12)}_{w(12)}"], [w(12).capitalize() + w(12).capitalize() + w(9).capitalize()], [w(9) + "-" + w(9) + "-" + w(9)], [w(14) + rng.choice(("***", "###", "$$$", "%%%"))], ["the", "token", "is", "missing"], ["password", "is", "required"], [f"{n(4)} {n(4)} {n(4)} {n(4)}"], [f"{n(3)}.{n(2)}.{n(1)}.{n(3)}"], [w(8).upper() + n(2)], ["see", f"{w()}/{w()}/{w()}.{w(4)}"], [f"{w(20)}{w(20)}{w(20)}"]))


def _labelled(text: str, order: int, vocabulary: Vocabulary) -> list[tuple]:
    """Stretches of a text, with their labels: around what the fixed patterns hold secret (half of them with the
    announcing words and prefixes masked), around its oddest other word, and elsewhere; and such a stretch with a
    made-up secret or a harmless odd word put in."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    if not words:
        return []
    rng = random.Random(order)
    code = vocabulary.batch([text])[0]
    f = file_features(code).tolist()
    code &= _ALL
    tags = np.zeros(len(words), int)
    starts = np.array([a for a, _ in words])
    for a, b, kind in base_spans(text):
        if kind == "assign":
            a = ASSIGN.match(text, a).start(2)
        i, j = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        if not tags[i:j].any():
            tags[i:j] = INSIDE
            tags[i] = BEGIN
    # words like random strings that no pattern names may be secrets: they are no examples of either kind
    mixed = (code & (32 | 128 | 1 << 10) == (32 | 128 | 1 << 10)) & (code & (1 << 11 | 1 << 14 | 1 << 15 | 1 << 16) > 0)
    unsure = (tags == OUTSIDE) & (mixed | (code & (64 | 1 << 17) == (64 | 1 << 17))) & (code & 1 << 18 == 0)
    odd = np.where((tags == OUTSIDE) & ~unsure, np.bitwise_count(code & ~64).astype(int), -1)
    out = []
    elsewhere = rng.randrange(len(words))
    for m in [*np.flatnonzero(tags == BEGIN)[:4].tolist(), int(odd.argmax()), elsewhere]:
        lo, hi = max(0, m - SIDE), min(len(words), m + SIDE + 1)
        if unsure[lo:hi].any():
            continue
        c = code[lo:hi].copy()
        if tags[m] == BEGIN and rng.random() < 0.5:
            c &= _MASK
        out.append((order, c.tolist(), tags[lo:hi].tolist(), f))
    lo, hi = max(0, elsewhere - SIDE), min(len(words), elsewhere + SIDE)
    if not (tags[lo:hi].any() or unsure[lo:hi].any()):
        more, labels = planted(rng) if rng.random() < 0.5 else (harmless(rng), None)
        new = shapes_of([w.encode() for w in " ".join(more).split()])
        known = [float(bool((new & _HAS_KEY).any()) or f[0]), f[1]]
        out.append((-1 - order, [*code[lo:elsewhere].tolist(), *(new & _ALL).tolist(), *code[elsewhere:hi].tolist()], [0] * (elsewhere - lo) + (labels or [0] * len(new)) + [0] * (hi - elsewhere), known))
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_parts: int = SAMPLE_PARTS, sample_planted: int = PLANTED) -> Crf:
    """Learn from the ``sample_docs`` documents of least hash (a bounded sample): from what the fixed patterns find there,
    with announcing words and prefixes masked in half of it, and from made-up secrets and harmless words put in."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").where("text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(shapes_of)
        for b in batches:
            got = [x for i, t in zip(b["doc_id"], b["text"]) for x in _labelled(t, int(i) * 2654435761 % (1 << 31), vocabulary)]
            yield pd.DataFrame(got, columns=["at", "shapes", "tags", "file"])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = sorted((int(at), s.tolist(), t.tolist(), f.tolist()) for b in batches for at, s, t, f in zip(b["at"], b["shapes"], b["tags"], b["file"]))
        made, given = [p[1:] for p in parts if p[0] < 0], [p[1:] for p in parts if p[0] >= 0]
        crf = train(given[:sample_parts] + made[:sample_planted])
        yield pd.DataFrame({"theta": [np.concatenate([crf.weights.ravel(), crf.file.ravel(), crf.moves.ravel(), crf.first])]})

    # the sample is bounded (some eight stretches a document), so one task can learn from it; the driver gets the weights
    parts = rows.mapInPandas(run, "at long, shapes array<int>, tags array<int>, file array<double>")
    got = parts.repartition(1).mapInPandas(learn, "theta array<double>").first()
    if got is None:
        return train([])
    w, n = np.array(got["theta"]), 12 * (len(BITS) + 1)
    return Crf(w[:n].reshape(-1, 4, 3), w[n : n + 6].reshape(2, 3), w[n + 6 : n + 15].reshape(3, 3), w[n + 15 :])


def find_secrets(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id and spans: array of (start, end, kind) of every row of ``docs``, over whole texts.

    Spans of the fixed patterns all stay; the field adds spans of kind "model" that overlap none of them: from the
    first word's to the last word's character that is no quote or punctuation mark. Code points, end exclusive,
    sorted by start, then kind. Null and empty texts have no spans; each row is handled by itself, so repeated rows
    get equal results; texts may have any length; other columns are ignored; an empty table gives an empty one.
    """
    crf = crf or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((crf, crf.tables()))

    def model_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        at, out = [m.span() for m in _WORD.finditer(text)], []
        for i, j in runs:
            a, z = at[i][0], at[j - 1][1]
            s = text[a:z]
            left = len(s) - len(s.lstrip(_STRIP.decode()))
            s = s.strip(_STRIP.decode())
            if s:
                out.append((a + left, a + left + len(s)))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, tables = shared.value
        vocabulary = Vocabulary(shapes_of)
        # A run of secret words beats OUTSIDE only if their leads, with a step's best move each, make up for what entering
        # and leaving costs, so one word at least has to lead by itself: texts without such a word need no decoding.
        leads = [[np.ascontiguousarray(tables[k][:, label] - tables[k][:, OUTSIDE]) for k in range(4)] for label in (BEGIN, INSIDE)]
        stay, m = field.moves[OUTSIDE, OUTSIDE], field.moves
        step = m[1:, 1:].max() - stay
        enter = max((m[OUTSIDE, 1:] - stay).max(), (field.first[1:] - field.first[OUTSIDE]).max())
        needed = min(0.0, step - enter - max(0.0, (m[1:, OUTSIDE] - stay).max())) - 1e-3
        by_file = [np.maximum(0, field.file[:, label] - field.file[:, OUTSIDE]).sum() for label in (BEGIN, INSIDE)]

        def leading(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            next_, after = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
            out = np.zeros(len(c), bool)
            for (own, before, two_before, behind), more in zip(leads, by_file):
                x = own[c]
                x[1:] += before[c[:-1]] * next_
                x[2:] += two_before[c[:-2]] * after
                x[:-1] += behind[c[1:]] * next_
                out |= x + (more + step) > needed
            return out

        for batch in batches:
            texts = list(batch["text"].array)
            code, starts = vocabulary.batch(texts)
            out = []
            open_ = np.concatenate([[0], np.cumsum(leading(code & _ALL, starts))])
            key, long = (np.concatenate([[0], np.cumsum(code & bit > 0)]) for bit in (_HAS_KEY, _LONG))
            for text, a, z in zip(texts, starts[:-1], starts[1:]):
                spans = []
                if text:
                    spans = base_spans(text, key[z] > key[a], long[z] > long[a])
                    if open_[z] > open_[a]:
                        own = code[a:z]
                        runs = decode(own & _ALL, file_features(own), tables, field)
                        if runs:
                            base = list(spans)
                            spans += [(x, y, "model") for x, y in model_spans(text, runs) if not any(x < e and s < y for s, e, _ in base)]
                            spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
                out.append([{"start": x, "end": y, "kind": k} for x, y, k in spans])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": out})

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInPandas(run, "doc_id long, spans array<struct<start:int,end:int,kind:string>>")
