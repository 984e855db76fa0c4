"""Rows without an id or kind, and the whole learning sample."""

import re


def test_revisits_of_no_kind_are_returned(spark):
    from dialogset.llm.warc import resolve

    rows = [(1, "a.com", 1, "response", {"etag": "1"}), (2, "a.com", 2, None, {"etag": "1"}), (3, "a.com", 3, "revisit", {"etag": "1"})]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>")
    assert sorted((r.record_id, r.refers_to, r.status) for r in resolve(df).collect()) == [(2, None, "unknown"), (3, 1, "resolved")]


def test_decontamination_rows_of_one_id_meet_their_own_items(spark):
    from dialogset.llm.decontaminate import decontaminate

    items = [(f"b{i}", " ".join(f"w{i}x{k}" for k in range(13))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(None, t) for _, t in items], "doc_id long, text string")
    out = decontaminate(docs, bench)
    assert sorted(r["items"][0] for r in out.select("decontamination.items").collect()) == sorted(i for i, _ in items)
    keys = re.findall(r"Aggregate \[([^\]]*)\]", out._jdf.queryExecution().optimizedPlan().toString())
    assert keys and all("text_key" in k for k in keys)


def test_language_sample_is_learned_whole(spark):
    from dialogset.llm import language

    word = lambda i: "".join(chr(0x430 + int(c)) for c in str(1000 + i))
    rows = [(i, "9" * 5000 + " " + (word(i) + " ") * 300, "ru") for i in range(2000)]
    found = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["ru"].decode().split("\n")
    assert len(found) > 200 and all(len(p) == language.SAMPLE_CHARS for p in found)
