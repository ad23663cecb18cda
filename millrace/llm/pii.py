"""Personal data: patterns, and a character BiLSTM with CRF transitions that adds spans.

The base spans follow fixed patterns. The tagger, trained in numpy, reads characters: a
bidirectional LSTM gives each character a score per tag, and a CRF over tag transitions ties
them together. It is trained on windows whose spans are labelled by the base patterns in a
bounded sample of documents, and on written variants that the patterns miss (a phone number
without its plus sign, an address with "at" spelled in brackets, digits parted by dots), set
into plain stretches of those documents and labelled by how they are made.

Every span holds a digit or an at sign, plain or spelled in brackets, so the tagger reads
windows around all of these in the whole text and nothing else. Windows overlap by half and
each is decoded on its own; what they find is reconciled over the whole text: a span's score
is its mean posterior over all windows that hold it with a margin, and the spans kept are
those of the largest total that don't overlap. A window's result depends on its characters
alone, so equal texts have equal spans whatever else is in a batch.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import clear, in_slices, materialize

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, nor gives digits back; said so, no run is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]", re.IGNORECASE)

#: Documents and windows the tagger is trained on, at most, and windows of one document.
FIT_DOCS, FIT_WINDOWS, EACH = 2000, 700, 4
#: Characters of a window, and how far the next one is shifted; a span of STRIDE - 2 characters lies within some window.
WINDOW, STRIDE = 96, 48
#: A span counts when its mean posterior probability reaches this.
MIN_POSTERIOR = 0.75
#: Windows that are scored at once.
AT_ONCE = 256
HIDDEN, EMBED, EPOCHS, BATCH, RATE = 16, 8, 16, 50, 0.04
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_MARKS = "@.-+() _%\n,:/[]{}"
_SPELLED = "atdo"  # the letters of "at" and "dot"
_CLASSES = 5 + len(_MARKS) + len(_SPELLED)  # padding, digit, lower, upper, other, then each mark and spelled letter
_FAR = -1e4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their at signs in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap; matches that fail their test are dropped."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += _emails(text)
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    out = np.full(len(codes), 4, dtype=np.int64)
    out[(codes >= 48) & (codes < 58)] = 1
    out[(codes >= 97) & (codes < 123)] = 2
    out[(codes >= 65) & (codes < 91)] = 3
    for i, mark in enumerate(_MARKS):
        out[codes == ord(mark)] = 5 + i
    for i, letter in enumerate(_SPELLED):
        out[(codes == ord(letter)) | (codes == ord(letter.upper()))] = 5 + len(_MARKS) + i
    return out


def stretches(text: str, reach: int = WINDOW // 3) -> list[tuple[int, int]]:
    """The stretches of a text within ``reach`` of a digit or an at sign."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows_of(text: str) -> list[tuple[int, int]]:
    """The windows of a text: WINDOW characters each, STRIDE apart, from the beginning of each stretch to its end."""
    return [
        (begin, min(b, begin + WINDOW))
        for a, b in stretches(text)
        for begin in range(a, max(a + 1, b - STRIDE), STRIDE)
    ]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _allowed() -> np.ndarray:
    """Transitions that can't be: into an I tag from anything but its own B and I."""
    t = np.zeros((len(TAGS), len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            for i, before in enumerate(TAGS):
                if before[2:] != tag[2:] or before == "O":
                    t[i, j] = _FAR
    return t


@dataclass
class Tagger:
    """Weights of the BiLSTM and the CRF; all numpy."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 7) -> "Tagger":
        r = np.random.default_rng(seed)
        p = {"embed": r.normal(0, 0.5, (_CLASSES, EMBED))}
        for d in ("f", "b"):
            p[f"w{d}"] = r.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
            p[f"c{d}"] = np.zeros(4 * HIDDEN)
            p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        p["out"] = r.normal(0, 0.25, (2 * HIDDEN, len(TAGS)))
        p["bias"] = np.zeros(len(TAGS))
        p["bias"][0] = 1.0
        p["trans"] = np.zeros((len(TAGS), len(TAGS)))
        return Tagger(p)

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction; the state is zero where ``mask`` is, so padding at an end changes nothing."""
        n, t, _ = x.shape
        w, c0 = self.p[f"w{d}"], self.p[f"c{d}"]
        xw = x @ w[:EMBED] + c0
        wh = w[EMBED:]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        hs, saved = np.zeros((n, t, HIDDEN)), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = xw[:, i] + h @ wh
            g = _sigmoid(z[:, : 3 * HIDDEN])
            a, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = (f * c + a * u) * mask[:, i, None]
            tc = np.tanh(c)
            h = o * tc
            hs[:, i] = h
            if keep:
                saved.append((i, a, f, o, u, c_before, tc, before))
        return hs, saved

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Score of each tag for each character of windows (n, t) of character classes, 0 for padding."""
        e = self.p["embed"][x]
        h = np.concatenate([self._lstm(e, x > 0, d, False)[0] for d in "fb"], axis=2)
        return h @ self.p["out"] + self.p["bias"]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray):
        """Negative log likelihood per window of tags ``y`` where ``mask`` holds, and its gradient."""
        p = self.p
        e = p["embed"][x]
        hf, sf = self._lstm(e, mask, "f", True)
        hb, sb = self._lstm(e, mask, "b", True)
        h = np.concatenate((hf, hb), axis=2)
        s = h @ p["out"] + p["bias"]
        trans = p["trans"] + _allowed()
        n, t, _ = s.shape
        gs, gt, loss = np.zeros_like(s), np.zeros_like(trans), 0.0
        log_a, log_b, z = _forward_backward(s, trans, mask)
        post = np.exp(log_a + log_b - z[:, None, None]) * mask[:, :, None]
        rows = np.arange(n)
        gs += post
        for i in range(t):
            m = mask[:, i]
            gs[rows[m], i, y[m, i]] -= 1
            loss -= s[rows[m], i, y[m, i]].sum()
            if i:
                pair = np.exp(np.clip(log_a[:, i - 1, :, None] + trans + (s[:, i] + log_b[:, i])[:, None, :] - z[:, None, None], -50, 50))
                gt += pair[m].sum(0)
                np.add.at(gt, (y[m, i - 1], y[m, i]), -1)
                loss -= trans[y[m, i - 1], y[m, i]].sum()
        loss += z.sum()
        gs, gt, loss = gs / n, gt / n, loss / n
        g = {"trans": gt, "out": h.reshape(-1, 2 * HIDDEN).T @ gs.reshape(-1, len(TAGS)), "bias": gs.sum((0, 1))}
        gh, ge = gs @ p["out"].T, np.zeros_like(e)
        for d, saved, part in (("f", sf, gh[:, :, :HIDDEN]), ("b", sb, gh[:, :, HIDDEN:])):
            w = p[f"w{d}"]
            gw, gc0, dh, dc = np.zeros_like(w), np.zeros(4 * HIDDEN), np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for i, a, f, o, u, c_before, tc, before in reversed(saved):
                m = mask[:, i, None]
                dh = (dh + part[:, i]) * m
                dc = (dc + dh * o * (1 - tc**2)) * m
                dz = np.concatenate((dc * u * a * (1 - a), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * a * (1 - u**2)), axis=1)
                gw[:EMBED] += e[:, i].T @ dz
                gw[EMBED:] += before.T @ dz
                gc0 += dz.sum(0)
                ge[:, i] += dz @ w[:EMBED].T
                dh, dc = dz @ w[EMBED:].T, dc * f
            g[f"w{d}"], g[f"c{d}"] = gw, gc0
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x, ge)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> "Tagger":
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, total = 0, epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                at = order[i : i + BATCH]
                _, g = self.loss_and_gradient(x[at], y[at], mask[at])
                step += 1
                rate = RATE * (1 - 0.9 * step / total)
                norm = np.sqrt(sum((w**2).sum() for w in g.values()))
                for k, w in g.items():
                    w = w * min(1.0, 5.0 / (norm + 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * w
                    v[k] = 0.99 * v[k] + 0.01 * w**2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, pieces: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """(kind, start, end, posterior) of the spans in each of some short texts, each decoded on its own."""
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in pieces]
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        trans = self.p["trans"] + _allowed()
        for at in range(0, len(order), AT_ONCE):
            part = [i for i in order[at : at + AT_ONCE] if pieces[i]]
            if not part:
                continue
            x = np.zeros((len(part), len(pieces[part[-1]])), dtype=np.int64)
            for r, i in enumerate(part):
                x[r, : len(pieces[i])] = classes_of(pieces[i])
            s = np.round(self.scores(x), 9)  # sums of a batch may differ in the last bits by its size
            path = _viterbi(s, trans, x > 0)
            told = np.flatnonzero(path.any(axis=1))
            if not len(told):
                continue
            log_a, log_b, z = _forward_backward(s[told], trans, x[told] > 0)
            post = np.exp(np.minimum(log_a + log_b - z[:, None, None], 0))
            for q, r in enumerate(told.tolist()):
                begin = np.flatnonzero(path[r] % 2 == 1)
                for t in begin.tolist():
                    end = t + 1
                    while end < x.shape[1] and path[r, end] == path[r, t] + 1:
                        end += 1
                    least = post[q, np.arange(t, end), path[r, t:end]].min()
                    out[part[r]].append((KINDS[(path[r, t] - 1) // 2], t, end, round(float(least), 6)))
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """The tagger's spans of each text: all windows decoded, then reconciled over the whole text."""
        jobs = [(i, a, b) for i, text in enumerate(texts) if text for a, b in windows_of(text)]
        # A window is decoded once however often its characters stand in these texts.
        pieces = [texts[i][a:b] for i, a, b in jobs]
        distinct = list(dict.fromkeys(pieces))
        found = dict(zip(distinct, self.decode(distinct)))
        held: list[dict[tuple[str, int, int], float]] = [{} for _ in texts]
        windows: list[list[tuple[int, int]]] = [[] for _ in texts]
        for (i, a, b), piece in zip(jobs, pieces):
            windows[i].append((a, b))
            for kind, s, e, p in found[piece]:
                # What touches an end at which the text goes on may be cut.
                if (s or not a) and (a + e < b or b == len(texts[i])):
                    key = (kind, a + s, a + e)
                    held[i][key] = held[i].get(key, 0.0) + p
        return [_reconciled(h, w, len(t or "")) for h, w, t in zip(held, windows, texts)]


def _reconciled(found: dict, windows: list[tuple[int, int]], size: int) -> list[tuple[str, int, int]]:
    """Of (kind, start, end) with summed posteriors those of the largest total weight that don't overlap.

    A span's mean is over all windows that hold it with a margin of a character, or to an end of
    the text; its weight is that times its length.
    """
    if not found:
        return []
    begins = [a for a, _ in windows]
    spans = []
    for (kind, a, b), total in found.items():
        k, among = bisect_right(begins, a) - 1, 0
        while k >= 0 and begins[k] > a - WINDOW:
            x, y = windows[k]
            among += (x < a or not x) and (b < y or y == size)
            k -= 1
        if total >= MIN_POSTERIOR * among:
            spans.append((b, a, kind, total / among * (b - a)))
    spans.sort()
    ends = [b for b, _, _, _ in spans]
    best, chosen = [0.0], []
    for i, (b, a, _, weight) in enumerate(spans):
        with_it = best[bisect_right(ends, a, 0, i)] + weight
        chosen.append(with_it > best[-1])
        best.append(max(best[-1], with_it))
    out, i = [], len(spans)
    while i:
        b, a, kind, _ = spans[i - 1]
        if chosen[i - 1]:
            out.append((kind, a, b))
            i = bisect_right(ends, a, 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _begin() -> np.ndarray:
    return np.array([_FAR if tag[0] == "I" else 0.0 for tag in TAGS])


def _forward_backward(s: np.ndarray, trans: np.ndarray, mask: np.ndarray):
    """Log alpha and beta of each character, and the log partition of each row. Masked characters stand at the end."""
    n, t, k = s.shape
    a, b = np.zeros_like(s), np.zeros_like(s)
    a[:, 0] = s[:, 0] + _begin()
    for i in range(1, t):
        new = _lse(a[:, i - 1, :, None] + trans, 1) + s[:, i]
        a[:, i] = np.where(mask[:, i, None], new, a[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = _lse(trans + (s[:, i + 1] + b[:, i + 1])[:, None, :], 2)
        b[:, i] = np.where(mask[:, i + 1, None], new, 0.0)
    return a, b, _lse(a[:, -1], 1)


def _viterbi(s: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> np.ndarray:
    n, t, k = s.shape
    best, back = s[:, 0] + _begin(), np.zeros((n, t, k), dtype=np.int8)
    for i in range(1, t):
        all_ = best[:, :, None] + trans
        back[:, i] = np.where(mask[:, i, None], all_.argmax(1), np.arange(k))
        best = np.where(mask[:, i, None], all_.max(1) + s[:, i], best)
    path = np.zeros((n, t), dtype=np.int64)
    path[:, -1] = best.argmax(1)
    rows = np.arange(n)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = back[rows, i, path[:, i]]
    path[~mask] = 0
    return path


_NONE = ("d", "dd", "dddd", "ddddd", "ddddddd", "dddddddddddddddd", "dddd-dd-dd", "dd.dd.dddd", "dd:dd", "ddd,ddd", "vd.d", "wddd", "@w", "dd%", "(dddd)", "ddd-ddd", "dd w", "w d.d", "wdwdddw", "dwdwwddwd", "ddd w ddd", "d, dd, ddd")


def _item(r: np.random.Generator, kind: str) -> str:
    """Something of a kind as people write it; of kind none, something else with digits or an at sign."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda a=2, b=9: "".join(r.choice(letters, r.integers(a, b)))
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[r.integers(len(x))]
    if kind == "email":
        user = word() + pick("", "", digits(2), "." + word(), "_" + word())
        host, top = word() + pick("", digits(1)), pick("com", "org", "net", "de", "info")
        o, c = pick("()", "[]", "{}")
        at, dot = pick("at", "AT", "At"), pick(".", ".", f"{o}dot{c}", f" {o}dot{c} ")
        gap = pick("", " ")
        return pick(f"{user}@{host}.{top}", *[f"{user}{gap}{o}{at}{c}{gap}{host}{dot}{top}"] * 3, f"{user} @ {host}.{top}")
    if kind == "ip":
        dot = pick(".", "[.]", "(.)", " . ", "[.]")
        return dot.join(str(r.integers(0, 256)) for _ in range(4))
    if kind == "card":
        body = pick("4", "5", "2") + digits(14)
        item = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return pick("", " ", "-", ".", "_", "/", "  ").join(item[j : j + 4] for j in range(0, 16, 4))
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}")
    return "".join(digits(1) if ch == "d" else word() if ch == "w" else ch for ch in pick(*_NONE))


def written_variants(n: int, seed: int = 11, carriers: list[str] = ()) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows with spans as people write them, and numbers that are none, labelled by how they are made.

    They stand in ``carriers``, stretches of plain text, or among made-up words where there are none.
    """
    r = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    prose = lambda: " ".join("".join(r.choice(letters, r.integers(2, 9))) for _ in range(r.integers(0, 6)))
    out = []
    for _ in range(n):
        kind = ("email", "ip", "card", "phone", "none", "none")[r.integers(6)]
        item = _item(r, kind)
        around = carriers[r.integers(len(carriers))] if len(carriers) else f"{prose()} {prose()}"
        cut = int(r.integers(0, len(around) + 1))
        cut = around.find(" ", cut) if around.find(" ", cut) >= 0 else len(around)
        lead = around[:cut] + ("", " ", ", ", ": ")[r.integers(1, 4)] if around[:cut] else ""
        text = lead + item + (" ", ". ", ", ", "\n", "")[r.integers(5)] + around[cut:].lstrip()
        begin = max(0, len(lead) - int(r.integers(0, WINDOW - len(item))))
        start = len(lead) - begin
        out.append((text[begin : begin + WINDOW], [(kind, start, start + len(item))] if kind != "none" else []))
    return out


def training_arrays(windows: list[tuple[str, list[tuple[str, int, int]]]]):
    x, y = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int64)
    for i, (text, spans) in enumerate(windows):
        c = classes_of(text[:WINDOW])
        x[i, : len(c)] = c
        for kind, a, b in spans:
            tag = 1 + 2 * KINDS.index(kind)
            y[i, a:b] = tag + 1
            y[i, a] = tag
    return x, y, x > 0


def sample_windows(text: str | None, limit: int = EACH) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """At most ``limit`` windows of a text, with the base spans in them: those with the smallest hashes.

    Windows that cut a base span, or that meet a match which failed its test because it ran
    into other numbers, are left out: their labels would be wrong.
    """
    spans = base_spans(text)
    doubtful = [m.span() for m in _PHONE.finditer(text or "") if len(_NO_DIGIT.sub("", m[0])) > 15]
    doubtful += [m.span() for m in _CARD.finditer(text or "") if not m[0].isdigit() and len(_NO_DIGIT.sub("", m[0])) > 16]
    doubtful = [d for d in doubtful if not any(d == (a, b) for _, a, b in spans)]
    out = []
    for a, b in windows_of(text or ""):
        if any(s < a < e or s < b < e for _, s, e in spans) or any(s < b and a < e for s, e in doubtful):
            continue
        inside = sorted(((k, s - a, e - a) for k, s, e in spans if a <= s and e <= b), key=lambda z: z[1])
        if any(p[2] > q[1] for p, q in zip(inside, inside[1:])):
            continue
        out.append((text[a:b], inside))
    return sorted(out, key=lambda w: (zlib.crc32(w[0].encode("utf-8", "replace")), w[0]))[:limit]


def plain_stretch(text: str | None) -> str | None:
    """The first stretch of WINDOW characters of a text without a digit or an at sign, to set variants into."""
    at = 0
    for m in _TRIGGER.finditer(text or ""):
        if m.start() - at >= WINDOW:
            break
        at = m.end()
    return text[at : at + WINDOW] if text and len(text) - at >= WINDOW and not _TRIGGER.search(text[at : at + WINDOW]) else None


def fit_tagger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger from the windows of at most FIT_DOCS documents (those with the smallest hashes) and twice as many written variants.

    EACH windows of a document are looked at, FIT_WINDOWS in all. The bound keeps the fit's
    cost the same at every size; nothing else is bounded. Null ids aren't sampled, null and
    empty texts have no windows, repeated rows count again; an empty table leaves variants
    among made-up words; other columns are not read.
    """
    spent: list[str] = []
    ids = df.select(F.col(id_col).cast("long").alias("lid")).where("lid is not null")
    ids = materialize(ids.orderBy(F.xxhash64("lid"), "lid").limit(FIT_DOCS).distinct(), "pii-ids", spent=spent)
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in in_slices(batches):
            rows = []
            for x in batch.column(0).to_pylist():
                rows += [(t, [f"{k}:{a}:{b}" for k, a, b in s], False) for t, s in sample_windows(x)]
                plain = plain_stretch(x)
                rows += [(plain, [], True)] if plain else []
            cols = list(zip(*rows)) or [(), (), ()]
            kinds = (pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["text", "spans", "plain"])

    found = narrow.join(F.broadcast(ids), F.col("id") == F.col("lid")).select("text").mapInArrow(run, "text string, spans array<string>, plain boolean")
    found = materialize(found, "pii-windows", spent=spent)
    rows = found.where("not plain").orderBy(F.size("spans") == 0, F.xxhash64("text"), "text").limit(FIT_WINDOWS).collect()
    carriers = [r["text"] for r in found.where("plain").orderBy(F.xxhash64("text"), "text").limit(FIT_WINDOWS).collect()]
    clear(df.sparkSession, spent)
    windows = [(r["text"], [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"])]) for r in rows]
    return Tagger.new().fit(*training_arrays(windows + written_variants(2 * FIT_WINDOWS, carriers=carriers)))


def plausible(kind: str, item: str) -> bool:
    """Whether what the tagger found passes the test of its kind: that of the base patterns on its digits, and no letters but an address's."""
    digits = _NO_DIGIT.sub("", item)
    if kind == "email":
        return bool(re.fullmatch(r"(?is)[^\W_][^@]*(@|[(\[{]\s?at\s?[)\]}]).*[^\W\d_]", item))
    if any(c.isalpha() for c in item):
        return False
    if kind == "ip":
        parts = [p for p in _NO_DIGIT.split(item) if p]
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def all_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; the tagger's spans count where they touch no base span and are plausible."""
    out = []
    order = {k: i for i, k in enumerate(KINDS)}
    for text, more in zip(texts, tagger.spans(texts)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        begins, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        extra = []
        for k, a, b in more:
            before = bisect_left(begins, b)  # base spans that begin before this one ends
            if (not before or reach[before - 1] <= a) and plausible(k, text[a:b]):
                extra.append((k, a, b))
        out.append((base, sorted(base + extra, key=lambda s: (order[s[0]], s[1], s[2]))))
    return out


def find_pii(df: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every row; one map-only pass.

    Counts are of the base spans; ``base`` and ``spans`` are arrays of kind:start:end in code
    points, end exclusive, by kind and start; ``spans`` holds the base spans and those the
    tagger adds.

    Defined results: null and empty texts have no spans; a null id stays null; repeated rows
    each give a row; an empty table gives none; other columns are not read. Memory follows
    the longest text.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = all_spans(part.column(1).to_pylist(), tagger)
                count = lambda k: pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64())
                text = lambda j: pa.array([[f"{k}:{a}:{b}" for k, a, b in f[j]] for f in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(count, KINDS), text(0), text(1)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]
                )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, spans array<string>")


def digests(found: DataFrame) -> DataFrame:
    joined: Column = F.array_join("base", ",")
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined, 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans")
    )


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, their union by the kind of the first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_all(texts: list[str | None], tagger: Tagger) -> list[str | None]:
    """The texts with all spans masked; once more where a mask parts numbers that ran into each other, so that a pattern fits now."""
    out, todo = list(texts), list(range(len(texts)))
    while todo:
        found = all_spans([out[i] for i in todo], tagger)
        again = []
        for i, (_, spans) in zip(todo, found):
            if spans:
                out[i] = masked(out[i], spans)
                if base_spans(out[i]):
                    again.append(i)
        todo = again
    return out


def mask_pii(df: DataFrame, tagger: Tagger, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df``, same columns, with personal data masked; the length column, if there is one, follows the new text.

    Defined results: null and empty texts, and texts without a span, stay as they are, their
    length column too; every row is kept, repeated ones and null ids included; an empty table
    gives an empty one; other columns, of whatever name, are passed on. One map-only pass;
    memory follows the longest text.
    """

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            for j in range(0, batch.num_rows, 256):
                part = batch.slice(j, 256)
                texts = part.column(i).to_pylist()
                new = mask_all(texts, tagger)
                part = part.set_column(i, part.schema.field(i), pa.array(new, part.schema.field(i).type))
                c = part.schema.get_field_index(chars_col) if chars_col else -1
                if c >= 0:
                    old = part.column(c).to_pylist()
                    sizes = [o if a == b else len(b) for o, a, b in zip(old, texts, new)]
                    part = part.set_column(c, part.schema.field(c), pa.array(sizes, part.schema.field(c).type))
                yield part

    return df.mapInArrow(run, df.schema)
