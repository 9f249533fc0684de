"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds what they miss."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from embertide.llm.common import spread, text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)
#: Words that a batch of the decoder pads its runs to, at most.
BATCH_WORDS = 500_000
#: Distinct feature sets whose scores a worker remembers.
HELD_TYPES = 100_000
Span = tuple[str, int, int]

# --- fixed patterns ----------------------------------------------------------
# Each is the contract's pattern; look-behinds and the search from "@" only skip starts
# that can't match, so that long runs cost linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by kind, then start; leftmost, non-overlapping per kind."""
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
        last = m.end() if m else at
        at = text.find("@", max(last, at + 1))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (g.lstrip("0") or "0" for g in m.groups())):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


# --- the small labelled table --------------------------------------------------
#: Sentences with tagged slots; {w} is a plain word. Fixed values of the training table.
PATTERNS = (
    "{w} {w} {email} {w} {w}",
    "{w} contact {email} for {w} {w}",
    "{w} {w} mail {email}, {w}",
    "{w} {w} {w} at {phone} {w} {w}",
    "call {phone} {w} or {w}",
    "{w} tel. {phone} {w}",
    "{w} phone: {phone}",
    "{w} {phone} {w} {phone} {w}",
    "{w} host {ip} {w} {w}",
    "{w} {w} {ip}, {w} {w}",
    "from {ip} {w} {w}",
    "{w} card {card} {w} {w}",
    "{w} {w} {card} {w}",
    "{w} {w} {secret} {w} {w}",
    "{w} {secret} {w}",
    "{w}. {secret} {w}",
    "{secret} {w} {w}",
    "{w} | {w} | {secret} | {w}",
    "{w}!! {secret}!! {w}!!",
    "{w} {assign} {w} {w}",
    "{w} {assign} {w}",
    "{w} {talk} {w} {w}",
    "{w} the {talk} {w}, {w}",
    "{w} {assign} | {w}",
    "{w} {w} in {n} {w}, {w} {n} {w}",
    "{w} {n} {w} {w} {n}",
    "{w}, {w} {date} {w} {w}",
    "{w} {w} {money} {w}",
    "{w} {w} {w} {w} {w}",
    "{w} | {w} | {w} | {w}",
    "{w}*** {w}&&& {w}$$$ {w}%%%",
    "{w}!! {w}!! {w}!!",
    "({w} {w}) {w} {n}. {w}",
    "{w} {url} {w} {w}",
    "{w} version {version} {w} {w}",
    "{w} @{w} {w} #{w} {w}",
    "{w} {hex} {w} {w}",
    "{w} {w} {serial} {w}",
)
#: Names of settings that hold a secret (fixed values).
KEYS = "password passwd pwd passphrase secret token key api_key apikey auth_token access_token client_secret private_key credential".split()
SYLLABLES = "an er on the ti es re ou ent al ing de la que en ein ung ver cion mente rr os eau oi aux pf sch le as th wh ea".split()


def _word(r: random.Random) -> str:
    w = "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))
    w = r.choice((w, w, w, w.capitalize(), w.capitalize(), w.upper(), w.replace("a", "é"), w.replace("o", "ñ")))
    return w + r.choice(("", "", "", "", ",", ".", "?", ":", "'s"))


def _num(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def _slot(kind: str, r: random.Random) -> str:
    name = "".join(r.choices(SYLLABLES, k=2))
    if kind == "email":
        return r.choice((f"{name}.{_num(r, 2)}@mail{_num(r, 1)}.example.com", f"{name}@{name}.org", f"{name}_{name}@x{name}.co.uk", f"{name}(at){name}.com", f"{name}[at]{name}[dot]org"))
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(("", "", ":8080"))
    if kind == "card":
        groups = [_num(r, 4) for _ in range(4)]
        return r.choice((" ".join(groups), "-".join(groups), "".join(groups)))
    if kind == "phone":
        a, b, c = _num(r, 3), _num(r, 3), _num(r, 4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_num(r, 2)} {a} {b} {c}", f"{a}.{b}.{c}"))
    if kind == "secret":
        key = r.choice(KEYS)
        key = r.choice((key, key, key, key.upper(), key.capitalize()))
        value = "".join(r.choices(r.choice(("0123456789abcdef", "0123456789ABCDEF", "abcdefghkmnpqrsTUVWXYZ0123456789")), k=r.choice((12, 16, 24, 32, 40, 64))))
        sign, quote = r.choice(("=", "=", ":")), r.choice(("", '"', '"', "'"))
        return key + r.choice(("{}", "{} ", " {} ", " {} ", " {} ")).format(sign) + quote + value + quote
    if kind == "assign":  # a setting that is no secret
        value = r.choice((_num(r, 2), name, f'"{name}"', f"'{name}'", "true", '"' + "".join(r.choices("0123456789abcdef", k=40)) + '"'))
        return r.choice((name, "x", "id", "colour", "size", "commit", "sha")) + r.choice((" = ", " = ", "=", ": ")) + value
    if kind == "talk":  # the words of a setting outside one
        return r.choice(KEYS) + " " + r.choice((name, "of", "is", "was", "and"))
    if kind == "hex":
        return "".join(r.choices("0123456789abcdef", k=r.choice((8, 12, 32, 40, 64))))
    if kind == "serial":
        return r.choice((_num(r, r.randint(6, 12)), f"{_num(r, 3)}-{_num(r, 2)}", f"AB-{_num(r, 6)}"))
    if kind == "date":
        return f"{_num(r, 4)}-{_num(r, 2)}-{_num(r, 2)}"
    if kind == "money":
        return r.choice((f"${_num(r, 3)}.{_num(r, 2)}", f"{_num(r, 2)}%", f"{_num(r, 1)},{_num(r, 3)}"))
    if kind == "url":
        return f"https://www.{name}.com/{name}/{_num(r, 2)}"
    if kind == "version":
        return f"{_num(r, 1)}.{_num(r, 1)}.{_num(r, 1)}"
    return _num(r, r.randint(1, 5))


def labelled_table(rows: int = 1100, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label), the same on every call."""
    r = random.Random(seed)
    table = []
    for i in range(rows):
        out: list[tuple[str, str]] = []
        apart = True
        for part in re.findall(r"\{\w+\}|[^{}]+", PATTERNS[i % len(PATTERNS)]):
            kind = part[1:-1] if part[0] == "{" else ""
            text = _word(r) if kind == "w" else _slot(kind, r) if kind else part
            label = kind if kind in KINDS else "O"
            pieces = text.split()
            for j, piece in enumerate(pieces):
                if j == 0 and not apart and text[:1] != " ":
                    out[-1] = (out[-1][0] + piece, out[-1][1] if label == "O" else label)
                else:
                    out.append((piece, label))
            apart = text[-1:] == " "
        table.append(out)
    return table


# --- word shapes -----------------------------------------------------------------
_SHAPES = ((re.compile(r"[A-Z]+"), "X"), (re.compile(r"[a-z]+"), "x"), (re.compile(r"[^\W\d_A-Za-z]+"), "x"))
_SECRET = re.compile(rf"(?i)({'|'.join(KEYS)})[=:]")
_HEX = re.compile(r"[0-9A-Fa-f]{12,}")
_CUES = frozenset("call tel phone mail email contact host ip from card at commit sha".split())


_PLAIN = tuple(("runs=x", "rough=x", "digits=0", f"long={x}", "letters") for x in (False, True))


@lru_cache(maxsize=100_000)
def word_features(word: str) -> tuple[str, ...]:
    core = word.strip(".,;:!?()[]\"'")
    if core.isascii() and core.isalpha() and core.islower() and "(" not in word and core not in _CUES and core not in KEYS:
        return _PLAIN[len(core) > 15]
    shape = core
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    runs = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 5)}", shape)
    rough = re.sub(r"[0-9]+", "d", shape)
    rough = re.sub(r"(xd|dx)+(x|d)?", "h", re.sub(r"X", "x", rough))
    digits = sum(c.isdigit() for c in core)
    out = ["runs=" + runs[:24], "rough=" + rough[:16], f"digits={min(digits, 16)}", f"long={len(core) > 15}"]
    out += ["letters"] if not digits and core.isalpha() else []
    out += [f"has{c}" for c in "@=+(-" if c in word]
    out += ["at"] if "at)" in word or "at]" in word else []
    out += ["setting"] if _SECRET.match(core) else []
    out += ["open"] if word[-1:] in "=:" and word[:-1].lower() in KEYS else []
    out += ["sign"] if word in ("=", ":") else []
    out += ["quoted"] if word[:1] in "\"'" and core else []
    out += ["hex"] if _HEX.fullmatch(core) and digits else []
    out += ["mixed"] if len(core) > 9 and digits and core.isalnum() and digits < len(core) else []
    out += ["dots3"] if core.count(".") == 3 else []
    cue = core.lower()
    if cue in KEYS:
        return (*out, "cue=secret")
    return (*out, "cue=" + cue) if cue in _CUES else tuple(out)


# --- the field ---------------------------------------------------------------------
class ShapeCRF:
    """Emission of a word = scores of its own, its left and its right neighbour's features; a text starts after and ends before an O."""

    def __init__(self, table: list[list[tuple[str, str]]], steps: int = 120, ridge: float = 0.02):
        names = sorted({f for row in table for w, _ in row for f in word_features(w)})
        self.feature = {f: i for i, f in enumerate(names)}
        n, k = len(names), len(LABELS)
        self.own, self.left, self.right = (np.zeros((n, k)) for _ in range(3))
        self.step = np.zeros((k, k))
        self._train(table, steps, ridge)
        self._ready()

    def _ready(self) -> None:
        self.types: dict[tuple[str, ...], int] = {}
        self.words: dict[str, int] = {}
        self.table = np.zeros((3, 1024, len(LABELS)))
        #: What a label can gain over O by the step into it, and what a run of labels gains at most by the step out of it.
        self.into, self.out_of = self.step[:, 1:].max(0) - self.step[0, 0], self.step[1:, 0].max() - self.step[0, 0]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("types", "words", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _score(self, features: tuple[str, ...]) -> np.ndarray:
        ids = [self.feature[f] for f in features if f in self.feature]
        return np.stack([x[ids].sum(0) for x in (self.own, self.left, self.right)])

    def type_of(self, word: str) -> int:
        f = word_features(word)
        if f not in self.types:
            at = self.types[f] = len(self.types)
            if at == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            self.table[:, at] = self._score(f)
        if len(self.words) > 200_000:
            self.words.clear()
        return self.words.setdefault(word, self.types[f])

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.types) > HELD_TYPES:
            self._ready()  # what is remembered only saves time
        get = self.words.get
        ids = np.fromiter((t if (t := get(w)) is not None else self.type_of(w) for w in words), np.int64, len(words))
        e = self.table[0][ids]
        e[1:] += self.table[1][ids[:-1]]
        e[:-1] += self.table[2][ids[1:]]
        return e

    def possible(self, e: np.ndarray) -> np.ndarray:
        """Words that may be other than O in a best path; all others are O in every one.

        Each word of a run of labels between two O gains at most its best label's emission over that of O and the step into it, and
        the run what the step out of it gives. A word is possible if some run over it doesn't lose by that bound.
        """
        gain = (e[:, 1:] - e[:, :1] + self.into).max(1)
        total = np.concatenate([[0.0], np.cumsum(gain)])
        before = total[1:] - np.minimum.accumulate(total)[:-1]  # the best run that ends here
        after = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]  # the best run that starts here
        return before + after - gain >= -self.out_of - 1e-6

    def _train(self, table, steps: int, ridge: float) -> None:
        """Maximum likelihood by full-batch Adam; all rows padded into one tensor."""
        long, k = max(map(len, table)), len(LABELS)
        y = np.zeros((len(table), long), np.int64)
        mask = np.zeros((len(table), long), bool)
        at: dict[str, tuple[list[int], list[int], list[int]]] = {"own": ([], [], []), "left": ([], [], []), "right": ([], [], [])}
        for i, row in enumerate(table):
            for j, (w, label) in enumerate(row):
                y[i, j], mask[i, j] = LABELS.index(label), True
                for name, jj in (("own", j), ("left", j + 1), ("right", j - 1)):
                    if 0 <= jj < len(row):
                        for f in word_features(w):
                            for lst, v in zip(at[name], (i, jj, self.feature[f]), strict=True):
                                lst.append(v)
        places = {n: tuple(map(np.array, v)) for n, v in at.items()}
        gold = np.eye(k)[y] * mask[..., None]
        pair = mask[:, 1:]
        gold_step = np.einsum("nta,ntb->ab", gold[:, :-1] * pair[..., None], gold[:, 1:])
        rows, last = np.arange(len(table)), mask.sum(1) - 1
        gold_step[0] += gold[:, 0].sum(0)
        gold_step[:, 0] += gold[rows, last].sum(0)
        moment = {n: [np.zeros_like(getattr(self, n)) for _ in range(2)] for n in ("own", "left", "right", "step")}
        for t in range(1, steps + 1):
            e = np.zeros((len(table), long, k))
            for n, (i, j, f) in places.items():
                np.add.at(e, (i, j), getattr(self, n)[f])
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0] + self.step[0]
            b[:, -1] = self.step[:, 0]
            for j in range(1, long):
                new = _lse(a[:, j - 1, :, None] + self.step, 1) + e[:, j]
                a[:, j] = np.where(mask[:, j, None], new, a[:, j - 1])
            for j in range(long - 2, -1, -1):
                new = _lse(self.step + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2)
                b[:, j] = np.where(mask[:, j + 1, None], new, self.step[:, 0])
            z = _lse(a[:, -1] + self.step[:, 0], 1)
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            joint = a[:, :-1, :, None] + self.step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
            want = (np.exp(joint) * pair[..., None, None]).sum((0, 1))
            want[0] += p[:, 0].sum(0)
            want[:, 0] += p[rows, last].sum(0)
            grads = {"step": gold_step - want}
            for n, (i, j, f) in places.items():
                g = np.zeros_like(getattr(self, n))
                np.add.at(g, f, (gold - p)[i, j])
                grads[n] = g
            for n, g in grads.items():
                x, (m, v) = getattr(self, n), moment[n]
                g = g / len(table) - ridge / 10 * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each run of emissions, between sure O on both sides; runs of like length in one numpy batch of BATCH_WORDS at most, or one run."""
        out: list[np.ndarray] = [np.empty(0)] * len(runs)
        order, start = sorted(range(len(runs)), key=lambda i: -len(runs[i])), 0
        while start < len(order):
            some = order[start : start + max(1, BATCH_WORDS // len(runs[order[start]]))]
            for i, path in zip(some, self._decode([runs[i] for i in some]), strict=True):
                out[i] = path
            start += len(some)
        return out

    def _decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        length = np.array([len(r) for r in runs])
        order = np.argsort(-length, kind="stable")
        n, long, k = len(runs), int(length.max()), len(LABELS)
        back = np.zeros((long, n, k), np.int8)
        best = np.stack([runs[i][0] for i in order]) + self.step[0]
        final = np.zeros((n, k))
        sizes = length[order]
        for j in range(1, long + 1):
            ended = sizes == j
            final[ended] = best[ended]
            alive = int((sizes > j).sum())
            if not alive:
                break
            options = best[:alive, :, None] + self.step
            back[j, :alive] = options.argmax(1)
            best[:alive] = options.max(1) + np.stack([runs[i][j] for i in order[:alive]])
        final += self.step[:, 0]
        out: list[np.ndarray] = [np.empty(0)] * n
        for place, i in enumerate(order):
            path = np.zeros(length[i], np.int8)
            path[-1] = final[place].argmax()
            for j in range(length[i] - 1, 0, -1):
                path[j - 1] = back[j, place, path[j]]
            out[i] = path
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def trained() -> ShapeCRF:
    return ShapeCRF(labelled_table())


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]\"'"


def added_spans(texts: list[str], model: ShapeCRF) -> list[list[Span]]:
    """Spans that the field finds in each text, before base spans take precedence."""
    runs, where = [], []
    for d, text in enumerate(texts):
        words = _TOKEN.findall(text)
        if not words:
            continue
        e = model.emissions(words)
        loose = model.possible(e)
        if not loose.any():
            continue
        edge = np.diff(loose.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            runs.append(e[a:b])
            where.append((d, a, b))
    out: list[list[Span]] = [[] for _ in texts]
    places: dict[int, list[tuple[int, int]]] = {}
    for (d, a, b), path in zip(where, model.decode(runs), strict=True):
        if not path.any():
            continue
        if d not in places:
            places[d] = [m.span() for m in _TOKEN.finditer(texts[d])]
        j = 0
        while j < len(path):
            i, label = j, path[j]
            while j < len(path) and path[j] == label:
                j += 1
            if label:
                start, end = places[d][a + i][0], places[d][a + j - 1][1]
                while start < end and texts[d][start] in _EDGE.replace("(", ""):
                    start += 1
                while end > start and texts[d][end - 1] in _EDGE:
                    end -= 1
                if start < end and plausible(LABELS[label], texts[d][start:end]):
                    out[d].append((LABELS[label], start, end))
    return out


def plausible(kind: str, found: str) -> bool:
    """Whether the content of an added span can be of its kind."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        return bool(m := _IP.search(found)) and all(len(g) <= 3 and int(g) <= 255 for g in m.groups())
    return True


def find_pii(texts: list[str], model: ShapeCRF) -> list[tuple[list[Span], list[Span]]]:
    """Per text: base spans, and all spans (base, and added ones that overlap none of them), by kind and start."""
    out = []
    for text, more in zip(texts, added_spans(texts, model), strict=True):
        base = base_spans(text)
        new = [s for s in more if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
        out.append((base, sorted(base + new, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_pii(docs: DataFrame, model: ShapeCRF | None = None) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base and spans as kind:start:end lists.

    Offsets are code points, end exclusive. Null text is empty and has no spans; a row without doc_id is
    scanned like any other; repeated rows repeat; an empty table gives an empty result; other columns are ignored. A row's
    work is on its own text alone, linear in its length; a very long text is held whole. Of equally good paths of the field the
    one with the earlier label in LABELS counts. An added span that overlaps a base span goes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    rows = spread(docs.select("doc_id", text_or_empty().alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find_pii(b.column(1).to_pylist(), shared.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:4]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array([_joined(x) for x, _ in found], pa.string()), pa.array([_joined(x) for _, x in found], pa.string())],
                names,
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """All documents, with the digest of base spans."""
    found = scan_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr("doc_id", "n_email", "n_ip", "n_card", "n_phone", "sha2(base, 256) as base_sha256", "spans")
