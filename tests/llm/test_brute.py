"""Registered queries over whole tables against the plain rules."""

import hashlib

import pytest
from llm import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_base(spark, docs):
    from dialogset.llm.queries import op1_quality_rules

    got = by_id(op1_quality_rules(spark, SF))
    for d in docs:
        r = got[d.doc_id]
        want = plain.quality(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_decontamination(spark, docs):
    from dialogset.llm.queries import op3_decontaminate

    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = by_id(op3_decontaminate(spark, SF))
    hits = 0
    for d in docs[:60] + [d for d in docs[60:] if got[d.doc_id].n_hit]:
        n, hit, items, bad = plain.contamination(d.text, bench)
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), bad)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()
        hits += bad
    assert hits


def test_language_model(spark, docs):
    from dialogset.llm.lm import score
    from dialogset.llm.queries import op5_lm_score

    want = plain.language_model([(d.doc_id, d.text) for d in docs])
    # many chunks and shards give the same scores as one
    narrow = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (op5_lm_score(spark, SF), score(narrow, chunk_tokens=3000, shard_keys=2000)):
        got = by_id(df)
        for d, (n, known, train, base, full) in zip(docs, want):
            r = got[d.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert r.score == pytest.approx(full, rel=1e-9)


def test_simhash(spark, docs):
    from dialogset.llm.queries import op6_simhash

    got = by_id(op6_simhash(spark, SF))
    fps = [plain.simhash(d.text) for d in docs]
    roots = plain.components([d.doc_id for d in docs], fps, 2)
    for d, fp, root in zip(docs, fps, roots):
        assert (got[d.doc_id].fingerprint, got[d.doc_id].component_id) == (f"{fp:016x}", root)


@pytest.mark.parametrize("bucket", [1, 3, 1024])
def test_simhash_links_in_small_and_large_buckets(spark, bucket):
    """Chains of near fingerprints sharing blocks: any bucket size connects the
    same fingerprints."""
    import random

    from dialogset.llm.components import components
    from dialogset.llm.simhash import _signed, links

    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:12]:
        for _ in range(14):  # a walk of one or two flipped bits at a time
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    want = plain.components(fps, fps, 2)
    df = spark.createDataFrame([(_signed(f),) for f in fps], "fp long").repartition(4)
    roots = {r.node & (2**64 - 1): r.root for r in components(links(df, 2, bucket), "a", "b").collect()}
    groups = {}
    for f, w in zip(fps, want):
        groups.setdefault(w, set()).add(roots.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pii_base(spark, docs):
    from dialogset.llm import pii
    from dialogset.llm.queries import op7_pii

    got = by_id(op7_pii(spark, SF))
    seen = 0
    for d in docs:
        spans = plain.base_spans(d.text)
        r = got[d.doc_id]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in spans) for i in range(4)]
        assert set(text.split(",")) <= set(r.spans.split(",")) or not text
        seen += len(spans)
    assert seen


def test_mixing(spark, docs):
    from dialogset.llm.queries import op8_mix

    got = op8_mix(spark, SF).collect()
    again = op8_mix(spark, SF).collect()
    assert sorted(got) == sorted(again)
    sizes, source = {}, {d.doc_id: d.source for d in docs}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + len(plain.WORD.findall(d.text or ""))
    goal, taken, largest = plain.targets(sizes), {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(goal[s]))
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s, words in taken.items():
        assert abs(words - goal[s]) <= 3 * largest[s]


def test_language(spark):
    """Learned on four fifths, held out on the rest."""
    from dialogset.llm.queries import op10_language

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_language(spark, sf).collect()
    held = [r for r in rows if r.held_out and truth[r.doc_id].lang is not None and len(truth[r.doc_id].text or "") >= 40]
    assert len(rows) == len(truth) and len(held) > 50
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (plain.crc(r.doc_id, 5) == 0) for r in rows)


def test_revisits(spark):
    from pyspark.sql import functions as F

    from dialogset.llm import warc

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    records = warc.captures_of(pages)
    plain_records = [r.asDict() for r in records.withColumn("url", warc.canonical_url(F.col("url"))).collect()]
    want = plain.revisits(plain_records)
    got = {r.record_id: (r.refers_to, r.status) for r in warc.resolve(records).collect()}
    assert got == want and {s for _, s in got.values()} >= {"resolved", "mismatch"}


def test_pipeline(spark, docs):
    """Each stage's rows follow from the rows before it by the plain rules."""
    import corpus_pipeline as C

    from dialogset.llm import language, pii
    from dialogset.session import pin

    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = df.columns, [df]
    for _, stage in C.STAGES:
        kept.append(pin(stage(spark, kept[-1], SF)))
        assert kept[-1].columns[: len(columns)] == columns
    rows = [k.orderBy("doc_id").collect() for k in kept]
    model = language.Classifier(language.learn(df))
    import re

    def sure(t):
        guess, score = model.predict(re.sub(r"[\W\d_]+", " ", (t or "").lower()))
        return guess != "und" and score >= language.MIN_MARGIN

    assert [r.doc_id for r in rows[1]] == [r.doc_id for r in rows[0] if sure(r.text)]
    roots = plain.components([r.doc_id for r in rows[1]], [plain.simhash(r.text) for r in rows[1]], 2)
    assert [r.doc_id for r in rows[2]] == [r.doc_id for r, c in zip(rows[1], roots) if r.doc_id == c]
    assert [r.doc_id for r in rows[3]] == [r.doc_id for r in rows[2] if not plain.contamination(r.text, bench)[3]]
    tagger = pii.Tagger(pii.learn(kept[3]))
    assert [(r.doc_id, r.text, r.n_chars) for r in rows[4]] == [
        (r.doc_id, t, len(t)) for r in rows[3] for t in [pii.mask(r.text, tagger.spans([r.text])[0][1])]
    ]
    assert not any(plain.base_spans(r.text) for r in rows[4])
    sizes = {}
    for r in rows[4]:
        sizes[r.source] = sizes.get(r.source, 0) + len(plain.WORD.findall(r.text))
    goal, taken = plain.targets(sizes), {}
    for r in rows[5]:
        taken[r.source] = taken.get(r.source, 0) + len(plain.WORD.findall(r.text))
    longest = max(len(plain.WORD.findall(r.text)) for r in rows[4])
    assert all(abs(taken.get(s, 0) - g) <= 3 * longest for s, g in goal.items())
    assert max(r["copy"] for r in rows[5]) <= 3
    assert sorted(map(str, C.run(spark, SF).collect())) == sorted(map(str, rows[5]))
