"""Operator 7: personal data by rules and a character-level BiLSTM-CRF.

The base spans (e-mail, IP, card, phone) are found by patterns over the whole
text. A bidirectional LSTM over characters with a linear-chain CRF, trained in
numpy from labelled spans, adds what the patterns miss (spaced, bracketed or
unprefixed forms). Base spans always stay.

Training: a bounded sample of the documents that hold a trigger character
(``SAMPLE_DOCS`` with the least hashes of their id, taken evenly from
``SAMPLE_PARTS`` parts of the hashes, ``SAMPLE_CHARS`` characters
around the first trigger of each) gives contexts with their base spans as
labels; into further contexts written forms of invented data are inserted,
labelled. The same seed gives the same model.

Tagging: the text is cut into windows of ``WINDOW`` characters, half
overlapping. A window without a digit or an at-sign (also the bracketed word)
is not decoded: no span can come of it, since every kind is validated and needs one.
Each decoded window (Viterbi over the CRF) proposes spans; proposals of one
kind that overlap across windows are united; all proposals of the document are
then reconciled globally: invalid ones and those touching a base span go, and
of the rest the non-overlapping set with the greatest total score is taken
(weighted interval scheduling).

One pass over the documents, no shuffle; the model (some thousand numbers) is
a broadcast variable; windows of many documents are decoded together, up to
``DECODE_BATCH`` at a time, so memory does not grow with a text's windows.

Edge cases: null text is empty and has no spans; without training contexts
the model is trained on the written forms alone; repeated rows are each
tagged; an empty table gives an empty result; very long runs of digits or
letters are matched in linear time; other columns pass through ``tag`` and
``redact`` untouched (one named like an output of ``tag`` is replaced).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogset.session import ship_package

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 256
SAMPLE_CHARS = 600
SAMPLE_PARTS = 64
WINDOW = 96
STRIDE = WINDOW // 2
DECODE_BATCH = 512
HIDDEN = 16
EMBED = 12
ROUNDS = 12
EXAMPLES = 1024
SEED = 7

# ---------------------------------------------------------------- base patterns
# fixed values: the patterns of the base. Written so that a long run of
# characters that cannot match is passed over once.

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = r"[0-9@]|[\[({<]\s*[aA][tT]\s*[\])}>]"
_TRIGGER = re.compile(TRIGGER)
_NOT_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), sorted."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(_small, m.groups())):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 64 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---------------------------------------------------------------- validation of added spans

_AT = re.compile(r"\s*(?:@|[\[({<]\s*at\s*[\])}>])\s*", re.I)
_DOT = re.compile(r"\s*(?:\.|[\[({<]\s*(?:dot|\.)\s*[\])}>])\s*", re.I)
_NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\Z")


def valid(kind: int, s: str) -> bool:
    """Whether an added span can be what it is taken for."""
    digits = _NOT_DIGIT.sub("", s)
    if kind == 0:
        halves = _AT.split(s)
        return len(halves) == 2 and bool(_NAME.match(_DOT.sub(".", halves[0])) and _HOST.match(_DOT.sub(".", halves[1])))
    if kind == 1:
        parts = _DOT.split(s.strip())
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and _luhn(digits) and not re.search(r"[^0-9 .\-_/]", s)
    marked = s[0] in "+(" or s.startswith("00")
    groups = re.findall(r"[0-9]+", s)
    return (
        7 <= len(digits) <= 15
        and not re.search(r"[^0-9 ().+/\-]", s)
        and (marked or len(groups) >= 3)
        and (marked or (not _DOT.search(s) or len(groups) == 3) and max(map(len, groups)) <= 4 and len(digits) >= 9)
    )


# ---------------------------------------------------------------- the model

_SPECIAL = "abcdefghijklmnopqrstuvwxyz@.-+()_ %[]{}<>/:,\n"
_CODE = {c: i + 4 for i, c in enumerate(_SPECIAL)}
N_CODES = len(_SPECIAL) + 4  # 0 padding, 1 digit, 2 other letter, 3 other
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
_ASCII = np.full(128, 3, np.int64)
for _c in range(128):
    _ch = chr(_c)
    _ASCII[_c] = 1 if _ch.isdigit() else _CODE.get(_ch.lower(), 3)


def encode(text: str) -> np.ndarray:
    """A class number per character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], 2)


def allowed() -> np.ndarray:
    """0 where a tag may follow another, a great cost where not: an inside tag
    follows only a begin or inside of its own kind."""
    cost = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        cost[:, inside] = -1e4
        cost[[inside - 1, inside], inside] = 0
    return cost


def init(rng) -> dict[str, np.ndarray]:
    p = {"E": rng.normal(0, 0.3, (N_CODES, EMBED))}
    p["W"] = rng.normal(0, 0.25, (2, EMBED + HIDDEN, 4 * HIDDEN))  # forward, backward
    p["c"] = np.zeros((2, 1, 4 * HIDDEN))
    p["c"][:, :, HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open
    p["O"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS))
    p["o"] = np.zeros(TAGS)
    p["o"][0] = 1.0
    p["T"] = np.zeros((TAGS, TAGS))
    p["S"] = np.zeros(TAGS)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(x, w, c0, keep: bool):
    """x: time x direction x batch x EMBED, the second direction reversed in
    time. Hidden states and, if asked, what the backward pass needs. Gates are
    input, forget, output; a logistic gate is a shifted tanh."""
    steps, _, n, _ = x.shape
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    half = np.ones(4 * HIDDEN, np.float32)
    half[: 3 * HIDDEN] = 0.5
    w, c0 = w * half, c0 * half
    inputs = x @ w[:, :EMBED] + c0
    out, saved = np.empty((steps, 2, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = np.tanh(inputs[t] + h @ w[:, EMBED:])
        gates = z[..., : 3 * HIDDEN] * 0.5 + 0.5
        i, f, o, g = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :], z[..., 3 * HIDDEN :]
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((i, f, o, g, before, tc, h_before))
    return out, saved


def _lstm_back(x, w, saved, d_out):
    dw, dx = np.zeros_like(w), np.empty_like(x)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    dzs = np.empty((*d_out.shape[:3], 4 * HIDDEN), np.float32)
    to_h = w[:, EMBED:].transpose(0, 2, 1)
    for t in range(len(saved) - 1, -1, -1):
        i, f, o, g, before, tc, _ = saved[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dzs[t]
        dz[..., :HIDDEN] = dc * g * i * (1 - i)
        dz[..., HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
        dz[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        dz[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
        dh, dc = dz @ to_h, dc * f
    dx = dzs @ w[:, :EMBED].transpose(0, 2, 1)
    hs = np.stack([x_[6] for x_ in saved])
    for d in (0, 1):
        flat = dzs[:, d].reshape(-1, 4 * HIDDEN)
        dw[d, :EMBED] = x[:, d].reshape(-1, EMBED).T @ flat
        dw[d, EMBED:] = hs[:, d].reshape(-1, HIDDEN).T @ flat
    return dw, dzs.sum((0, 2))[:, None, :], dx


def _both(a):
    """time x batch x ... -> time x direction x batch x ..."""
    return np.stack([a, a[::-1]], axis=1)


def emissions(p, codes: np.ndarray, keep: bool = False):
    """codes: batch x time. Tag scores, time x batch x TAGS."""
    x = _both(p["E"][codes.T])
    states, saved = _lstm(x, p["W"], p["c"], keep)
    h = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    return h @ p["O"] + p["o"], (x, h, saved)


def _loss_gradient(p, codes, tags, rules):
    em, (x, h, saved) = emissions(p, codes, True)
    steps, n, _ = em.shape
    # forward and backward sums in scaled probabilities
    move = np.exp(p["T"] + rules).astype(np.float64)
    e = np.exp(em - em.max(axis=2, keepdims=True)).astype(np.float64)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, n, 1))
    a = e[0] * np.exp(p["S"])
    for t in range(steps):
        if t:
            a = (alpha[t - 1] @ move) * e[t]
        scale[t] = a.sum(1, keepdims=True)
        alpha[t] = a / scale[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = (e[t + 1] * beta[t + 1]) @ move.T / scale[t + 1]
    d_em = alpha * beta
    after = (e[1:] * beta[1:] / scale[1:]).reshape(-1, TAGS)
    d_tr = alpha[:-1].reshape(-1, TAGS).T @ after * move
    gold = tags.T
    np.put_along_axis(d_em, gold[:, :, None], np.take_along_axis(d_em, gold[:, :, None], 2) - 1, 2)
    np.subtract.at(d_tr, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    d_em = (d_em / n).astype(np.float32)
    g = {"T": (d_tr * (rules > -1) / n).astype(np.float32), "S": d_em[0].sum(0)}
    g["O"] = h.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, TAGS)
    g["o"] = d_em.sum((0, 1))
    dh = d_em @ p["O"].T
    d_states = np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]], axis=1)
    g["W"], g["c"], dx = _lstm_back(x, p["W"], saved, d_states)
    dx = dx[:, 0] + dx[::-1, 1]
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], codes.T.ravel(), dx.reshape(-1, EMBED))
    return g


def fit(codes: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS, seed: int = SEED, batch: int = 64, rate: float = 0.015):
    """Adam on the CRF's negative log-likelihood."""
    rng = np.random.default_rng(seed)
    p, rules = init(rng), allowed()
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for r in range(rounds):
        order = rng.permutation(len(codes))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            g = _loss_gradient(p, codes[pick], tags[pick], rules)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            now = rate * (1 - 0.9 * r / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in p:
                gk = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * gk
                v2[k] = 0.999 * v2[k] + 0.001 * gk * gk
                p[k] = (p[k] - now * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)
    return p


def decode(p, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (batch x time) and each tag's lead over O."""
    em, _ = emissions(p, codes)
    tr = p["T"] + allowed()
    steps, n, _ = em.shape
    best, back = em[0] + p["S"] + tr[0], np.empty((steps, n, TAGS), np.int8)
    for t in range(1, steps):
        s = best[:, :, None] + tr[None]
        back[t] = s.argmax(1)
        best = s.max(1) + em[t]
    tags = np.empty((n, steps), np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
    lead = np.take_along_axis(em, tags.T[:, :, None], 2)[:, :, 0] - em[:, :, 0]
    return tags, lead.T


# ---------------------------------------------------------------- training examples

def _written_forms(rng) -> tuple[int, str]:
    """One invented datum: its kind and a way to write it."""
    pick = lambda *a: a[rng.integers(len(a))]
    word = lambda lo, hi: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(lo, hi)))
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    kind = int(rng.integers(4))
    if kind == 0:
        name = pick(word(3, 10), word(3, 9) + "." + word(3, 9), word(2, 8) + "." + num(2), word(4, 8) + "_" + num(1))
        host = pick(word(3, 9), "mail" + num(1) + "." + word(4, 9), word(3, 6) + "-" + word(3, 6))
        at = pick("@", "@", "@", " @ ", "(at)", "[at]", " (at) ", " [at] ", "[@]")
        dot = pick(".", ".", ".", "[.]", " [dot] ", "(dot)") if at != "@" else pick(".", ".", "[.]")
        return 0, (name + at + host + dot + pick("com", "org", "net", "de", "example.com".replace(".", dot)))
    if kind == 1:
        return 1, pick(".", ".", "[.]", " . ", "(.)").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        digits = num(rng.integers(13, 19))
        digits += next(d for d in "0123456789" if _luhn(digits + d))
        sep = pick("", "", " ", "-", ".", "_", "  ")
        return 2, sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, a, b = num(3), num(3), num(4)
    return 3, pick(
        f"+{num(1)} ({area}) {a}-{b}", f"+{num(2)} {area} {a} {b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}",
        f"00{num(2)} {area} {a}{b}", f"+{num(2)}{area}{a}{b}", f"{area} {a} {b}", f"+{num(1)}/{area}/{a}{b}", f"1-{area}-{a}-{b}",
    )


def _distractor(rng) -> str:
    """Numbers and marks that are not personal data."""
    pick = lambda *a: a[rng.integers(len(a))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    tail = num(rng.integers(1, 9))
    return pick(
        "19" + num(2), num(1) + "." + num(2), "v" + num(1) + "." + num(1) + "." + num(1), f"{num(2)}:{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}",
        f"${num(3)}.{num(2)}", f"#{tail}", f"{num(rng.integers(1, 3))}%", '"' + "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 24)) + '"', "@" + "user",
        f"{num(1)},{num(3)},{num(3)}", f"[{num(2)}]", f"({num(2)})", tail, f"{num(3)}.{num(3)}",
    )


def examples(contexts: list[str], n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: a third as they are found (labels: base spans), the
    rest with one written form or distractor inserted."""
    rng = np.random.default_rng(seed)
    contexts = [c for c in contexts if c] or ["the river had risen in the night and by morning the lower meadows were under water"]
    codes, tags = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        c = contexts[rng.integers(len(contexts))]
        spans = []
        if i % 3:
            room = _TRIGGER.sub("", c) or " "
            a = int(rng.integers(max(1, len(room) - WINDOW // 2)))
            room = room[a : a + WINDOW]
            cut = room.find(" ", int(rng.integers(max(1, len(room) // 2)))) + 1
            kind, datum = _written_forms(rng) if i % 3 == 1 or rng.random() < 0.5 else (-1, _distractor(rng))
            before = room[:cut][-(WINDOW - 8) :]
            text = (before + datum + (" " if rng.random() < 0.8 else ". ") + room[cut:])[:WINDOW]
            if kind >= 0:
                spans = [(len(before), min(len(before) + len(datum), WINDOW), kind)]
        else:
            a = int(rng.integers(max(1, len(c) - WINDOW + 1)))
            text = c[a : a + WINDOW]
            spans = [(s - a, e - a, k) for s, e, k in base_spans(c)]
        codes[i, : len(text)] = encode(text)
        for s, e, k in spans:
            if e > 0 and s < WINDOW:
                tags[i, max(s, 0) : e] = 2 + 2 * k
                if s >= 0:
                    tags[i, s] = 1 + 2 * k
                else:
                    tags[i, 0] = 1 + 2 * k
    return codes, tags


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """The tagger, from a bounded sample of ``docs`` (see the module text)."""
    at = F.regexp_instr(F.col("text"), F.lit(TRIGGER))
    start = F.greatest(at - SAMPLE_CHARS // 2, F.lit(1))
    held = docs.where(F.col("text").rlike(TRIGGER)).select(
        F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("c")
    )
    # the least of each part: a map task sends at most the sample's size, and no
    # task or driver gathers what all map tasks found
    parts = min(SAMPLE_PARTS, sample_docs)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("h", "c"))
    ranked = held.withColumn("part", F.pmod("h", F.lit(parts))).withColumn("rank", rank)
    rows = ranked.where(F.col("rank") <= sample_docs // parts).select("h", "c").collect()
    return fit(*examples([r[1] for r in sorted(rows)]))


# ---------------------------------------------------------------- tagging

def window_starts(text: str) -> list[int]:
    """Windows (half overlapping) that hold a trigger."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    out: dict[int, None] = {}
    for m in _TRIGGER.finditer(text):
        hi = min(m.start() // STRIDE, last)
        for k in (hi - 1, hi):
            if k >= 0:
                out[k] = None
    return [k * STRIDE for k in out]


def _proposals(starts, tags, leads, length: int) -> list[tuple[int, int, int, float]]:
    found = []
    for start, row, lead in zip(starts, tags, leads):
        n = min(WINDOW, length - start)
        i = 0
        while i < n:
            t = row[i]
            if t and t % 2:
                j = i + 1
                while j < n and row[j] == t + 1:
                    j += 1
                found.append((start + i, start + j, (int(t) - 1) // 2, float(lead[i:j].sum())))
                i = j
            else:
                i += 1
    return found


def reconcile(text: str, base: list[tuple[int, int, int]], proposed: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """All spans of a text: the base, and the best valid non-overlapping
    proposals beside it."""
    united: list[list] = []
    for k in range(len(KINDS)):
        for s, e, _, w in sorted(p for p in proposed if p[2] == k):
            if united and united[-1][2] == k and s < united[-1][1]:
                united[-1][1] = max(united[-1][1], e)
                united[-1][3] = max(united[-1][3], w)
            else:
                united.append([s, e, k, w])
    spans = []
    taken = sorted((s, e) for s, e, _ in base)
    for s, e, k, w in united:
        piece = text[s:e]
        s += len(piece) - len(piece.lstrip(" \t\n.,;:"))
        e -= len(piece) - len(piece.rstrip(" \t\n.,;:-"))
        if s < e and w > 0 and valid(k, text[s:e]) and not _inside_number(text, s, e):
            spans.append((e, s, k, w))
    spans.sort()
    free, i = [], 0
    for e, s, k, w in spans:
        if not any(a < e and s < b for a, b in taken):
            free.append((e, s, k, w))
    # weighted interval scheduling over the ends
    from bisect import bisect_right

    ends = [x[0] for x in free]
    best, take = [0.0], []
    for i, (e, s, k, w) in enumerate(free):
        j = bisect_right(ends, s, 0, i)
        take.append((best[j] + w > best[i], j))
        best.append(max(best[i], best[j] + w))
    added, i = [], len(free)
    while i:
        use, j = take[i - 1]
        if use:
            e, s, k, _ = free[i - 1]
            added.append((s, e, k))
            i = j
        else:
            i -= 1
    return sorted([*base, *added], key=lambda x: (x[0], x[2], x[1]))


def _inside_number(text: str, s: int, e: int) -> bool:
    """Whether a span is a piece of a longer word or number."""
    return (s > 0 and text[s - 1].isalnum() and text[s].isalnum()) or (e < len(text) and text[e].isalnum() and text[e - 1].isalnum())


class Tagger:
    def __init__(self, model):
        self.model = model

    def spans(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """Per text: base spans, all spans."""
        out: list = [None] * len(texts)
        bases, starts, pending = {}, {}, []
        proposed: dict[int, list] = {}

        def flush():
            if not pending:
                return
            codes = np.zeros((len(pending), WINDOW), np.int64)
            for r, (i, s) in enumerate(pending):
                c = encode(texts[i][s : s + WINDOW])
                codes[r, : len(c)] = c
            tags, leads = decode(self.model, codes)
            for r, (i, s) in enumerate(pending):
                if tags[r].any():
                    proposed[i] += _proposals([s], tags[r : r + 1], leads[r : r + 1], len(texts[i]))
            pending.clear()

        for i, t in enumerate(texts):
            if not t or not _TRIGGER.search(t):
                out[i] = ([], [])
                continue
            bases[i], proposed[i] = base_spans(t), []
            for s in window_starts(t):
                pending.append((i, s))
                if len(pending) == DECODE_BATCH:
                    flush()
        flush()
        for i, base in bases.items():
            out[i] = (base, reconcile(texts[i], base, proposed[i]))
        return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
_PA_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _structs(spans):
    return [{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans]


def tag(docs: DataFrame, model, base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` plus two arrays of (start, end, kind), in code points: the base
    spans and all spans."""
    docs = docs.drop(base, spans)
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(base, SPAN), T.StructField(spans, SPAN)])

    def run(batches):
        tagger = Tagger(shared.value)
        for b in batches:
            found = tagger.spans(b.column(at).to_pylist())
            new = [pa.array([_structs(x[j]) for x in found], _PA_SPAN) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema.names)

    return docs.mapInArrow(run, schema)


def mask(text: str, spans) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping
    spans become one, named by the first."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model) -> DataFrame:
    """``docs`` with personal data in ``text`` masked (and ``n_chars``, where
    there is such a column, counted again)."""
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        tagger = Tagger(shared.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            masked = [mask(t, x[1]) if x[1] else t for t, x in zip(texts, tagger.spans(texts))]
            columns = list(b.columns)
            columns[at] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        count = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        out = out.select(*[count.alias(c) if c == "n_chars" else F.col(c) for c in names])
    return out
