"""Operators 11 to 13 against plain rules, and on nulls, empty and very long
texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from llm import plain
from llm.test_edges import CLASHES, LONG, ROWS, SCHEMA, TEXT
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def clashing(df):
    for i, c in enumerate([*CLASHES, "item_no", "terms", "counts", "n", "score", "quality", "codes", "q", "rid", "part", "error", "label_error", "_label"]):
        df = df if c in df.columns else df.withColumn(c, F.lit(f"x{i}"))
    return df


# ------------------------------------------------------------ lexical search


def ranked(docs, items, k=10):
    """item -> [(doc_id, score)], by adding up every document."""
    bags = [(i, Counter(TERM.findall(plain.lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, found = set(TERM.findall(plain.lower(text))), []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // n_terms
            total = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in asked if t in b)
            found += [(-total, i is not None, i or 0, i)] if total > 0 else []
        out += [(str(item), r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_search_over_whole_tables(spark):
    from dialogset.llm.queries import op13_lexical_search

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert as_rows(op13_lexical_search(spark, SF)) == ranked(docs, items)


def test_search_edges(spark):
    from dialogset.llm.lexical_search import search

    docs = clashing(spark.createDataFrame(ROWS, SCHEMA)).repartition(3)
    asked = [("a", TEXT), ("b", "ALPHA"), ("c", None), ("d", "..."), ("e", "unheard"), ("e2", "naïve 12345 Word word"), (None, "same id"), ("f", LONG)]
    items = clashing(spark.createDataFrame(asked, "item_id string, text string"))
    want = ranked([(r[0], r[1]) for r in ROWS], asked)
    assert as_rows(search(docs, items)) == want
    assert as_rows(search(docs, items, block_terms=1)) == want  # every item a block of its own
    assert as_rows(search(docs, items, k=2)) == ranked([(r[0], r[1]) for r in ROWS], asked, 2)
    assert search(docs.where("false"), items).collect() == search(docs, items.where("false")).collect() == []
    # an item asked twice is answered twice
    twice = as_rows(search(docs, items.where("item_id = 'a'").unionByName(items.where("item_id = 'a'"))))
    assert twice == sorted(2 * [r for r in want if r[0] == "a"], key=str)


def test_search_prunes_and_keeps_ties(spark):
    """Small buckets, many equal scores: the least ids stay; few pairs are scored exactly."""
    from dialogset.llm import lexical_search as S

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    share = 1 / np.arange(1, 401)
    share /= share.sum()
    docs = [(i, " ".join(rng.choice(words, 30, p=share))) for i in range(1500)]
    docs += [(5000 + i, docs[7][1]) for i in range(40)]
    items = [(i, docs[i * 7][1]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert as_rows(S.search(df, spark.createDataFrame(items, "item_id long, text string"))) == ranked(docs, items)

    bags = [Counter(t.encode() for t in x.split()) for _, x in docs]
    vocabulary = sorted({w for b in bags for w in b})
    number = {w: i for i, w in enumerate(vocabulary)}
    df_ = Counter(w for b in bags for w in b)
    weight = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df_[w] + 1))) for w in vocabulary])
    asked = S.Items([sorted(number[w.encode()] for w in set(x.split())) for _, x in items], weight)
    best, scored = S.Best(asked.n, 10), 0
    rows = []
    for (i, _), b in zip(docs, bags):
        term = np.array([number[w] for w in b])
        impact = S._vectors(np.array([30]), np.array([len(b)]), np.array(list(b.values())), len(docs), 30 * len(docs))
        rows.append((math.sqrt(((asked.scale[term] * impact) ** 2).sum()), i, term, impact))
    rows.sort(key=lambda r: -r[0])
    for s in range(0, len(rows), 64):
        length, ids, term, impact = zip(*rows[s : s + 64])
        sizes = np.array([len(t) for t in term])
        scored += S.search_bucket(np.array(ids), np.cumsum(sizes) - sizes, np.concatenate(term), np.concatenate(impact), np.array(length), asked, best)
    assert scored < len(docs) * asked.n / 3
    got = sorted(((str(i), r + 1, int(d), int(x)) for i in range(20) for r, (d, x) in enumerate(zip(best.doc[i], best.score[i])) if x), key=str)
    assert got == ranked(docs, items)


# -------------------------------------------------------------- vector codes


def coded(rows, rounds=6, parts=8, entries=16):
    """(id, codes, error) of every row and the codebooks, by comparing all."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    q = [[math.floor(4096 * x) for x in r[1]] for r in rows]
    width = len(q[0]) // parts
    cut = [[v[k * width : (k + 1) * width] for v in q] for k in range(parts)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, q[i]))[:entries]
    books = [[cut[k][i] for i in order] for k in range(parts)]

    def near(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            own = [near(k, x)[1] for x in cut[k]]
            for j in set(own):
                mine = [x for x, o in zip(cut[k], own) if o == j]
                books[k][j] = [sum(c) // len(mine) for c in zip(*mine)]
    ends = [[near(k, cut[k][i]) for k in range(parts)] for i in range(len(rows))]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(r[0], [e[1] for e in end], sum(e[0] for e in end), r[2]) for r, end in zip(rows, ends)], hashlib.sha256(text.encode()).hexdigest()


def test_vector_codes_over_whole_table(spark):
    from dialogset.llm.queries import op12_vector_codes

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, sha = coded(rows)
    by_label = Counter()
    for _, _, error, label in want:
        by_label[label] += error
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in op12_vector_codes(spark, SF).collect()}
    assert got == {i: ("".join(f"{c:02x}" for c in codes), e, by_label[label], sha) for i, codes, e, label in want}


@pytest.mark.parametrize("block", [1, 3, 256])
def test_vector_codes_edges(spark, monkeypatch, block):
    from dialogset.llm import vector_codes as V

    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16)], int(i % 3) if i % 4 else None) for i in range(40)]
    rows += [(100 + i, rows[3][1], 1) for i in range(60)] + [rows[5], rows[5], (None, rows[6][1], None)]
    rows += [(900, None, 1), (901, [], 1), (902, [None] + [0.0] * 15, 1), (903, [math.nan] * 16, 1), (904, [math.inf] + [0.0] * 15, 1), (905, [-0.1] * 16, 1)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).repartition(5)
    want, sha = coded(rows)
    by_label = Counter()
    for _, _, error, label in want:
        by_label[label] += error
    got, books = V.compress(df)
    assert books.sha256() == sha
    plain_rows = sorted(((i, c, e, by_label[label]) for i, c, e, label in want), key=str)
    as_list = lambda d: sorted(((r.vec_id, list(r.codes), r.error, r.label_error) for r in d.collect()), key=str)
    assert as_list(got) == plain_rows
    monkeypatch.setattr(V, "BROADCAST_LABELS", 0)
    assert as_list(V.compress(df)[0]) == plain_rows
    none, books = V.compress(df.where("vec_id >= 900 and vec_id < 905"))
    assert none.collect() == [] and books.text() == ""
    few, _ = V.compress(df.where("vec_id < 5"))
    assert [(r.vec_id, r.error) for r in few.orderBy("vec_id").collect()] == [(i, 0) for i in range(5) ]
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([(1, [0.0] * 9, 1)], "vec_id long, embedding array<double>, label int"))


def test_shortlists_never_lose_the_nearest():
    from dialogset.llm import vector_codes as V

    rng = np.random.default_rng(0)
    entries = rng.integers(-50, 50, (16, 8))
    entries[9] = entries[2]  # a tie
    dropped = 0
    for _ in range(200):
        points = rng.integers(-60, 60, 8) + rng.integers(-4, 5, (20, 8))
        some = np.flatnonzero(V.shortlists(points.min(0)[None], points.max(0)[None], entries)[0])
        dropped += 16 - len(some)
        a, d = V.nearest(points, entries, some)
        b, e = V.nearest(points, entries, np.arange(16))
        assert (a == b).all() and (d == e).all()
    assert dropped > 200


def test_hilbert_keys_walk_the_grid():
    """In two dimensions, 8 by 8: every cell once, each next to the one before."""
    from dialogset.llm import vector_codes as V

    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    bits, V.KEY_BITS = V.KEY_BITS, 6
    try:
        key = V.hilbert_keys(grid, grid.min(0), grid.max(0))
    finally:
        V.KEY_BITS = bits
    walk = grid[np.argsort(key)]
    assert sorted(key) == list(range(64)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# ------------------------------------------------------------------- quality


def test_quality_machine_identity_and_gradient():
    """Linear-time scores equal the sum over all pairs, gradients those by differences."""
    from dialogset.llm import quality_fm as Q

    rng = np.random.default_rng(1)
    width = 3
    model = Q.Machine(0.3, rng.normal(size=Q.HASHES + width), rng.normal(size=(Q.HASHES + width, Q.FACTORS)), np.zeros(width), np.ones(width))
    words = [(np.sort(rng.choice(Q.HASHES, n, False)), rng.normal(size=n)) for n in (0, 1, 7)]
    dense = rng.normal(size=(3, width))
    m = Q.Matrix.of(words, dense)
    for r, (at, value) in enumerate(words):
        at, value = np.append(at, Q.HASHES + np.arange(width)), np.append(value, dense[r])
        pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * value[i] * value[j] for i in range(len(at)) for j in range(i))
        assert model.raw(m)[0][r] == pytest.approx(0.3 + model.linear[at] @ value + pairs)
    label, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = 1 / (1 + np.exp(-model.raw(m)[0]))
        return -(weight * np.log(np.where(label == 1, p, 1 - p))).sum() / weight.sum()

    model.linear *= 0.1
    model.factors *= 0.1
    gb, gl, gf = Q.gradient(model, m, label, weight)
    for x, g, at in ((model.linear, gl, Q.HASHES), (model.factors, gf, (Q.HASHES + 1, 2)), (model.factors, gf, (words[2][0][3], 0))):
        before, step = x[at], 1e-6
        x[at] = before + step
        up = loss()
        x[at] = before - step
        down = loss()
        x[at] = before
        assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_quality_on_held_out_documents(spark):
    from dialogset.llm.queries import op11_quality_fm

    sf = "/root/testdata/sf0.01"
    rows = op11_quality_fm(spark, sf).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (plain.crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    for label in (0, 1):
        own = [p == t for p, t in held if t == label]
        assert len(own) >= 10 and sum(own) / len(own) >= 0.95
    assert sorted(rows) == sorted(op11_quality_fm(spark, sf).collect())


def test_quality_edges(spark):
    from dialogset.llm import quality_fm as Q

    docs = clashing(spark.createDataFrame(ROWS, SCHEMA))
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (4, 0), (6, 0), (7, None), (8, 5), (None, 1), (77, 0)], "doc_id int, quality int")
    model = Q.learn(docs, labels)
    rows = Q.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.quality_score <= 1 for r in rows)
    assert Q.score(docs, model).columns == [*docs.columns, "quality_score"]
    assert Q.score(docs.where("false"), model).collect() == []
    empty = [r.quality_score for r in rows if not (r.text or "")]
    assert len(empty) == 3 and len({r.quality_score for r in rows if r.text == TEXT}) == 1
    unlearned = Q.score(docs, Q.learn(docs, labels.where("false"))).collect()
    assert {r.quality_score for r in unlearned} == {0.5}
    only = Q.score(docs.withColumn("quality_score", F.lit("clash")), Q.learn(docs, labels.where("quality = 1"))).collect()
    assert min(r.quality_score for r in only) > 0.9
    # neither labels, language, source nor id are inputs of a score
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"), "n_chars")
    assert sorted(r.quality_score for r in Q.score(other, model).collect()) == sorted(r.quality_score for r in rows)
