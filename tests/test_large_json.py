"""Files of one JSON document, read in byte ranges."""

import json
import os
import random
import tempfile

import pytest

from dialogset.sources import splitfiles
from dialogset.sources.splitfiles import GRANULARITIES, legacy_counts, read_legacy_json

ODD = ["plain", "brackets ] [ ][ ]]", 'quote " inside', "back\\slash", 'a\\"]b', "ends \\", "new\nline\ttab", "", "]", "[", '"', 'ünï "code" ]é', '"coarse": [', "}, {", "\u2028 x \u0000", '\\\\"]'] 


def _document(n, seed):
    rng = random.Random(seed)
    doc = {g: [] for g in GRANULARITIES}
    for i in range(n):
        text = " ".join(rng.choice(ODD) for _ in range(rng.randint(0, 6)))
        multi = [rng.randint(0, 1) for _ in range(6)]
        values = {"coarse": i % 2, "multi": multi, "seq_coarse": multi[: 1 + i % 5], "seq_multi": [multi] * (i % 3)}
        for g, v in values.items():
            doc[g].append([text, v, i // 7, i])
    return doc


def _rows(doc):
    return [(c[0], c[1], m[1], sc[1], sm[1], c[2], c[3]) for c, m, sc, sm in zip(*[doc[g] for g in GRANULARITIES])]


def _read(spark, folder):
    rows = read_legacy_json(spark, folder).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.pos):
        out.setdefault(os.path.basename(r.file), []).append((r.text, r.coarse, r.multi, r.seq_coarse, r.seq_multi, r.thread_id, r.conv_id))
    return out


def _write(folder, name, doc, **kw):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        json.dump(doc, f, **kw)


def test_one_file_is_read_by_many_tasks(spark):
    folder = tempfile.mkdtemp(prefix="one-document-")
    doc = _document(3000, 1)
    _write(folder, "large", doc)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    spark.conf.set("dialogset.scan.hotGroupRows", "2000")  # the running sums spread over blocks as well
    try:
        pieces = splitfiles._pieces(spark, folder)
        assert pieces.select("block").distinct().count() > 20
        assert _read(spark, folder) == {"large": _rows(doc)}
    finally:
        for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "dialogset.scan.hotGroupRows"):
            spark.conf.unset(c)


def test_any_writing_of_the_same_document(spark):
    folder = tempfile.mkdtemp(prefix="one-document-")
    docs = {"a": (_document(40, 2), {}), "b": (_document(40, 3), {"indent": 2}), "c": (_document(30, 4), {"ensure_ascii": False, "separators": (",", ":")}),
            "d": (_document(1, 5), {"indent": 1}), "e": (_document(0, 6), {})}
    for name, (doc, kw) in docs.items():
        _write(folder, name, dict(reversed(doc.items())) if name == "c" else doc, **kw)
    got = _read(spark, folder)
    assert got == {name: _rows(doc) for name, (doc, _) in docs.items() if name != "e"}
    counts = {os.path.basename(r.file): r.n_seq_multi for r in legacy_counts(spark, folder).collect()}
    assert counts == {"a": 40, "b": 40, "c": 30, "d": 1, "e": 0}


def test_lists_of_unequal_length_are_an_error(spark):
    for g in GRANULARITIES:
        folder = tempfile.mkdtemp(prefix="one-document-")
        doc = _document(5, 7)
        doc[g].pop()
        _write(folder, "x", doc)
        with pytest.raises(Exception, match="unequal"):
            read_legacy_json(spark, folder).collect()
