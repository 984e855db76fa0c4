"""The operators' rules said plainly over Python lists, one text or pair at a
time: what the distributed operators are held against."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import groupby

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOWER)


def crc(doc_id, modulus):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def quality(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in t),
        len(lines) - len(set(lines)),
        len(repeat),
        len(words) < 50 or 100 * len(repeat) > 50 * len(words),
    )


def contamination(text, benchmark, span=13):
    words = BENCH_WORD.findall(lower(text))
    hit, items = set(), set()
    for item_id, item in benchmark:
        w = BENCH_WORD.findall(lower(item))
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[i : i + n]:
                    hit |= set(range(p, p + n))
                    items.add("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(words)


def simhash(text, shingle=3):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, max_bits):
    """Least id reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    """The four patterns of the base as they are written in the contract."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, e, k) for s, k, e in sorted(out)]


def targets(sizes, weights=(1, 2, 3), most=3):
    """Source -> exact target, by capping again and again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest, shares = total - sum(capped.values()), sum(weight[s] for s in free)
        above = [s for s in free if Fraction(weight[s] * rest, shares) > most * sizes[s]]
        if not above:
            return {s: capped[s] if s in capped else Fraction(weight[s] * rest, shares) for s in order}
        capped |= {s: Fraction(most * sizes[s]) for s in above}


def language_model(docs, rounds=12, buckets=16):
    """doc -> (n_tokens, n_known, base score, score), with dictionaries."""
    tokens = [[*WORD.findall(lower(t)), None] for _, t in docs]
    role = [crc(d, 10) for d, _ in docs]

    def counts(keep):
        uni, pairs, n = Counter(), Counter(), 0
        for r, ts in zip(role, tokens):
            if keep(r):
                uni.update(ts)
                pairs.update(zip(["<s>", *ts[:-1]], ts))
                n += 1
        return uni, pairs, n

    def estimates(uni, pairs, n, ts):
        total = sum(uni.values())
        for prev, w in zip([("<s>",), *[(x,) for x in ts[:-1]]], ts):
            seen = n if prev == ("<s>",) else uni[prev[0]]
            bucket = min(int(np.log2(seen + 1)), buckets - 1)
            yield bucket, pairs[(prev[0], w)] / max(seen, 1), uni[w] / max(total, 1)

    full = counts(lambda r: r != 0)
    size = len(full[0])
    uniform = 1 / (size + 1)
    rest = counts(lambda r: r not in (0, 1))
    held = [e for r, ts in zip(role, tokens) if r == 1 for e in estimates(*rest, ts)]
    weight = np.full((buckets + 1, 3), 1 / 3)
    at = np.array([e[0] for e in held], int)
    p = np.array([[e[1], e[2], uniform] for e in held]).reshape(-1, 3)
    for _ in range(rounds if held else 0):
        own = weight[at] * p
        own /= own.sum(1, keepdims=True)
        pooled = weight[buckets] * p
        pooled = (pooled / pooled.sum(1, keepdims=True)).sum(0)
        weight[buckets] = pooled / pooled.sum()
        for b in range(buckets):
            weight[b] = own[at == b].sum(0) / (at == b).sum() if (at == b).any() else weight[buckets]
    weight = 0.999999 * weight + 0.000001 * np.array([0, 0, 1])
    n_train = sum(full[0].values())
    out = []
    for ts in tokens:
        c = np.array([full[0][w] for w in ts])
        base = np.log10((c + 0.1) / (n_train + 0.1 * (size + 1))).sum()
        logs = sum(np.log10(weight[b] @ [p2, p1, uniform]) for b, p2, p1 in estimates(*full, ts))
        out.append((len(ts), int((c > 0).sum()), n_train, base, logs))
    return out


def revisits(records):
    """record_id -> (refers_to, status), by walking the captures of each URL."""
    out = {}
    order = lambda r: (r["url"], r["ts"], r["kind"] != "response", r["record_id"])
    for url, group in groupby(sorted(records, key=order), key=lambda r: r["url"]):
        last = None
        for r in group:
            if r["kind"] == "response":
                last = r
                continue
            if last is None:
                out[r["record_id"]] = (None, "missing")
                continue
            mine, theirs = r["headers"] or {}, last["headers"] or {}
            if mine.get("etag") is not None and theirs.get("etag") is not None:
                same = re.sub("^[wW]/", "", mine["etag"]) == re.sub("^[wW]/", "", theirs["etag"])
            elif mine.get("last-modified") is not None and theirs.get("last-modified") is not None:
                same = mine["last-modified"] == theirs["last-modified"]
            else:
                same = None
            status = {True: "resolved", False: "mismatch", None: "unchecked"}[same]
            out[r["record_id"]] = (last["record_id"] if same is not False else None, status)
    return out
