"""Headers over several lines and whole licence texts, named as they are."""

import hashlib
import math
import re
import textwrap
from collections import Counter
from itertools import groupby

import pytest
from llm import plain


def _wrapped(text, prefix="", width=72):
    return "\n".join(prefix + x for x in textwrap.wrap(text, width))


def test_wrapped_headers_and_licence_texts(spark):
    from dialogset.llm.licence_texts import HEADERS, full_texts
    from dialogset.llm.licenses import own_licences

    whole = dict(HEADERS)  # the last text of a licence
    whole["BSD-3-Clause"] = next(t for name, t in HEADERS if name == "BSD-3-Clause")
    bsd = _wrapped(whole["BSD-3-Clause"], " * ")
    code = "\n\nint main(void) {\n  return 0;\n}\n" * 20
    want = {}

    def file(path, licence, text):
        want[path] = (licence, text)

    file("bsd.c", "BSD-3-Clause", f"/*\n * BSD 3-Clause License\n *\n * Copyright (c) 2020, A. Author\n * All rights reserved.\n *\n{bsd}\n */{code}")
    file("bare.c", "BSD-3-Clause", "/*\nCopyright (c) 2020, A. Author\nAll rights reserved.\n\n" + _wrapped(whole["BSD-3-Clause"]) + "\n*/" + code)
    file("tight.py", "BSD-2-Clause", _wrapped(whole["BSD-2-Clause"], "# ") + "\nimport os\n" + "x = os.getcwd()\n" * 50)
    file("one.txt", "proprietary", "prose\nAll rights reserved.")
    for name in ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0"):
        file(f"{name}.py", name, "# A program.\n#\n" + _wrapped(whole[name], "# ") + code)
        # the paragraphs parted by blank lines
        first, rest = whole[name].split("This program is distributed" if "LGPL" not in name else "This library is distributed")
        file(f"{name}.txt", name, "Some words on the tool.\n\n" + _wrapped(first) + "\n\n" + _wrapped("This is distributed" + rest) + code)
    for name in ("Apache-2.0", "MIT", "ISC", "0BSD", "MPL-2.0"):
        file(f"{name}.js", name, "// Copyright 2021 The Authors\n//\n" + _wrapped(whole[name], "// ") + code)
    for name, text in full_texts()[:-len(HEADERS)]:
        file(f"{name}/COPYING", name, text)
    for name in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC"):
        file(f"{name}/LICENSE", name, f"The {name} License\n\nCopyright (c) 2020 A. Author\nAll rights reserved.\n\n" + _wrapped(whole[name]))
    rows = [(p, t) for p, (_, t) in want.items()]
    got = {r.path: r.own_license for r in own_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {p: name for p, (name, _) in want.items()}


@pytest.mark.parametrize("text", ["", "word", "\n\n", "# a\n# b\n\n# c", "/* a\n\n b */ c", "a\n#\nb\r\n\n--x\n"])
def test_blocks_hold_their_lines(spark, text):
    from dialogset.llm.licenses import blocks_of
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(text,)], "text string").select(F.inline(blocks_of(F.col("text")))).collect()
    assert {x for x in text.split("\n") if x.strip()} <= {x for r in rows for x in r.text.split("\n")}
    assert all(r.several == ("\n" in r.text) for r in rows)


def _plain_blocks(text):
    """The runs of lines and the comments of a text: (text, several lines)."""
    comment = lambda x: bool(re.match(r"[\x20\x09]*(//|#|;|--|%|!|<!--|(?i:dnl|rem)\b|\.\\\")", x))
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = set()
    for lines, mark in (
        (text.split("\n"), lambda x: comment(x) if re.search(r"[0-9A-Za-z\u0080-\U0010ffff]", x) else None),
        (text.split("\n"), lambda x: comment(x) if re.search(r"[^\x20\x09-\x0D]", x) else None),
        (full, comment),
    ):
        for _, run in groupby(lines, mark):
            run = list(run)
            out.add(("\n".join(run), len(run) > 1))
    for m in re.finditer(r"/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3}|'{3}.*?'{3}", text, re.S):
        out.add((m[0], "\n" in m[0]))
    return out


def _dense(words, weights):
    """(score, licence) of every template for one unit, by whole vectors."""
    bag = Counter(words)
    norm = math.sqrt(sum((n * weights.idf.get(t, weights.unknown)) ** 2 for t, n in bag.items()))
    for (_, licence, *_), v, length in zip(({r[0]: r for r in weights.rows}).values(), weights.vectors, weights.lengths):
        dot = sum(n * weights.idf[t] * v[t] for t, n in bag.items() if t in v)
        yield (round(dot / norm / length, 6), licence) if norm else (0.0, licence)


def test_all_units_against_dense_cosines(spark):
    """Lines, blocks and whole files of the given documents, and of files with
    licence texts among them, by comparing every unit with every template."""
    from dialogset.llm.licence_texts import HEADERS, full_texts
    from dialogset.llm.licenses import LICENCE_FILE, TEMPLATES, Weights, files_of, own_licences

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    files = [(r.path, r.text) for r in files_of(docs).select("path", "text").collect()]
    prose = files[3][1]
    for i, (_, text) in enumerate(HEADERS):
        files.append((f"h{i}.c", "/*\n" + _wrapped(text, " * ") + "\n*/\n" + prose))
        files.append((f"m{i}.txt", _wrapped(text) + "\n" + prose[:80]))
    for i, (_, text) in enumerate(full_texts()[:6]):
        files += [(f"w{i}/LICENSE.md", text[: len(text) // 2]), (f"x{i}/COPYING", text + prose), (f"y{i}/notes", text)]
    files += [(None, "Released under the MIT License."), ("two", None), ("two", "Licensed under CC BY 4.0."), ("z/LICENSE", "the of and to " * 4000)]
    weights = [(2, Weights(TEMPLATES)), (1, Weights(HEADERS)), (0, Weights(full_texts()))]
    want = {}
    for path, text in files:
        units = {(2, x) for x in (text or "").split("\n")} | {(1 if several else -2, b) for b, several in _plain_blocks(text or "")}
        units |= {(0, text or "")} if path and re.match(LICENCE_FILE, path.split("/")[-1]) else set()
        for rank, unit in units:
            w = dict(weights)[1 if abs(rank) == 1 or rank == -2 else rank]
            for score, licence in _dense(plain.BENCH_WORD.findall(plain.lower(unit)), w):
                if score >= 0.75:
                    key = path or "\0" + hashlib.sha256(text.encode()).hexdigest()
                    want[key] = min(want.get(key, (9,)), (abs(rank), -score, licence))
    frame = spark.createDataFrame(files, "path string, text string").repartition(4)
    got = {r.path: (r.own_license, r.own_score) for r in own_licences(frame).collect()}
    assert got.keys() == want.keys() and len(got) > 40
    for path, (_, score, licence) in want.items():
        assert got[path] == (licence, pytest.approx(-score, abs=2e-6)), path
