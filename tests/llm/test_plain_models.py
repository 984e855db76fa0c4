"""Decoding, scheduling and compression against plain statements."""

import itertools
import re

import numpy as np
import pytest
import xxhash
import zstandard
from llm import plain

SF = "/root/testdata/sf0.001"


def test_viterbi_against_all_tag_sequences():
    from dialogset.llm import pii

    rng = np.random.default_rng(4)
    model = pii.init(rng)
    model["T"] = rng.normal(size=model["T"].shape)
    model["S"] = rng.normal(size=model["S"].shape)
    codes = np.stack([pii.encode(t) for t in ("a@1", "+4 ", "9.9", "...")])
    tags, _ = pii.decode(model, codes)
    em, _ = pii.emissions(model, codes)
    tr = model["T"] + pii.allowed()

    def score(i, ys):
        path = em[0, i, ys[0]] + model["S"][ys[0]] + tr[0, ys[0]]
        return path + sum(em[t, i, b] + tr[a, b] for t, (a, b) in enumerate(zip(ys, ys[1:]), 1))

    for i in range(len(codes)):
        best = max(itertools.product(range(pii.TAGS), repeat=codes.shape[1]), key=lambda ys: score(i, ys))
        assert tuple(tags[i]) == best


def test_spans_are_the_best_that_do_not_overlap(monkeypatch):
    """Windows' proposals of one kind are united, those meeting a base span go,
    and of the others no set without overlaps weighs more."""
    from dialogset.llm import pii

    monkeypatch.setattr(pii, "valid", lambda kind, s: True)
    monkeypatch.setattr(pii, "_inside_number", lambda text, s, e: False)
    rng = np.random.default_rng(9)
    text = "x" * 40
    for _ in range(400):
        spans = lambda n: [(int(a), int(a + rng.integers(1, 9)), int(rng.integers(0, 4))) for a in rng.integers(0, 31, n)]
        base = spans(int(rng.integers(0, 3)))
        proposed = [(*s, float(rng.integers(1, 50))) for s in spans(int(rng.integers(0, 9)))]
        united = {}
        for k in range(4):
            own = sorted(p for p in proposed if p[2] == k)
            while own:
                s, e, _, w = own.pop(0)
                while own and own[0][0] < e:
                    _, e2, _, w2 = own.pop(0)
                    e, w = max(e, e2), max(w, w2)
                united[s, e, k] = w
        free = [s for s in united if not any(a < s[1] and s[0] < b for a, b, _ in base)]
        apart = lambda chosen: all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(chosen, 2))
        most = max(sum(united[s] for s in c) for n in range(len(free) + 1) for c in itertools.combinations(free, n) if apart(c))
        got = pii.reconcile(text, base, proposed)
        added = list(got)
        for b in base:
            added.remove(b)
        assert set(added) <= set(free) and apart(added) and sum(united[s] for s in added) == pytest.approx(most)


def test_language_against_plain_compressors(spark):
    """Every given document, with dictionaries gathered and compressors called here."""
    from dialogset.llm.queries import op10_language

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    reduced = lambda t: re.sub(r"[\W\d_]+", " ", (t or "").lower())
    samples, counts = {}, {}
    for d in docs:
        if plain.crc(d.doc_id, 5) != 0 and d.lang is not None and re.search(r"[^\W\d_]", d.text or ""):
            h = xxhash.xxh64_intdigest(str(d.doc_id).encode(), 42)
            samples.setdefault(d.lang, []).append((h - (h >> 63 << 64), reduced(d.text).lstrip(" ")[:1024]))
            counts[d.lang] = counts.get(d.lang, 0) + 1
    # few enough that no part of the hashes is cut
    assert max(counts.values()) < 16 * 8
    order = sorted(samples, key=lambda k: (-counts[k], k))
    tools = {}
    for lang in order:
        content = "\n".join(t for _, t in sorted(samples[lang])).encode()
        params = zstandard.ZstdCompressionParameters.from_level(
            3, source_size=1024, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False
        )
        tools[lang] = lambda b, c=content, p=params: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p).compress(b)
    got = {r.doc_id: r for r in op10_language(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs[:: max(1, len(docs) // 60)]:
        data = reduced(d.text).encode()
        r = got[d.doc_id]
        if not data.strip():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = [sum(len(tools[k](data[i : i + 1024])) for i in range(0, len(data), 1024)) for k in order]
        best, second = sorted(sizes)[:2]
        # a dictionary prepared once may code a block a few bytes apart from one loaded anew
        assert r.lang_pred == order[sizes.index(best)] or second - best <= 0.01 * second
        assert r.score == pytest.approx(1 - best / second, abs=0.02)
        assert 0 <= r.score <= 1
