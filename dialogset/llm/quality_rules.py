"""Operator 1: host-level quality rules (DataFrame functions only).

Per document, four rules are judged: ``short`` (fewer than ``MIN_WORDS``
words), ``repeats`` (words inside repeated 3-word windows above half of all
words), ``symbols`` (markup symbols per word) and ``dup_lines`` (repeated
lines among lines with a word). Rule failures are added up by host (here the
document's source); each host's failure rate of a rule is shrunk towards all
hosts by a beta prior whose mean and strength come from the hosts themselves
(method of moments, weighted by their documents). A host is judged by its
posterior, ``CERTAINTY`` deviations from the mean, against all hosts' rate, so
a small host or one like the others decides nothing. The verdicts go back to
the documents:

* a host whose rate of *any* rule failing is surely above all hosts' rate and
  surely at least ``DROP_HOST`` is dropped with all its documents;
* a document failing ``symbols`` or ``dup_lines`` is dropped unless its host
  is surely clean in that rule (at most ``FORGIVE`` times all hosts' rate): the
  odd page of a clean host is forgiven;
* documents failing ``short`` or ``repeats`` are dropped anywhere.

Everything is counted over all documents; text is read once. The narrow
per-document table is pinned, counted per host with partial aggregation (a hot
host is one row per map task), and host verdicts are broadcast only when their
counted number is at most ``BROADCAST_HOSTS``; beyond it the join shuffles
the narrow rows, salted by document so that a hot host spreads over
``SALTS`` tasks.

Edge cases: null text has no words and fails ``short``; a null host is a host
of its own; repeated rows count each; an empty table gives an empty result;
only id, host and text are read, other columns are not returned; a text of one word without a line break, of any length, is one line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogset.llm.common import SPACE, let, split_words, text_or_empty
from dialogset.session import pin

SYMBOLS = "#*$%&|<>"  # fixed value: markup symbols
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
DROP_HOST = 0.5
FORGIVE = 0.25
CERTAINTY = 2.0  # deviations of the posterior
BROADCAST_HOSTS = 200_000
SALTS = 16
SOFT = ("symbols", "dup_lines")
RULES = ("short", "repeats", *SOFT)


def n_symbols(text: Column) -> Column:
    bare = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SYMBOLS, text)
    return (F.octet_length(text) - F.octet_length(bare)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Window hashes (64 bits) are sorted with their positions, equal neighbours
    mark the repeated windows, and the marked positions are merged into the
    number of words they cover: n log n for a text of any length."""

    def covered(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.size(p)), lambda a, b: b - a)
        return F.aggregate(gaps, F.lit(3).cast("long"), lambda acc, g: acc + F.least(g, F.lit(3)))

    def positions(s: Column) -> Column:
        marked = F.transform(
            s,
            lambda x, i: F.when(
                F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
                x["pos"],
            ),
        )
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("pos"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(pairs, positions), covered)
        )

    return let(windows(words), repeated)


def document_rules(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and the four rule failures (narrow)."""
    t = text_or_empty(text)
    words = split_words(t, SPACE)
    lines = lines_with_words(t)

    def word_stats(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            n_repeat_words(w).alias("n_repeat_words"),
        )

    def line_stats(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(host).alias("host"),
        n_symbols(t).alias("n_symbols"),
        let(words, word_stats).alias("_w"),
        let(lines, line_stats).alias("_l"),
    ).select("doc_id", "host", "_w.*", "n_symbols", "_l.*")
    return base.select(
        "*",
        (F.col("n_words") < MIN_WORDS).alias("short"),
        (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT).alias("repeats"),
        (F.col("n_symbols") * 100 > F.col("n_words") * MAX_SYMBOLS_PER_WORD_PERCENT).alias("symbols"),
        (F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINE_PERCENT).alias("dup_lines"),
    )


def host_rates(rules: DataFrame) -> DataFrame:
    """One row per host: documents, and for each rule (and ``any``) the
    failures, the failure rate shrunk by the empirical beta prior (``rate``),
    its sure bounds (``low``, ``high``) and the rate of all hosts (``mean``).

    With per-host failures f of n documents, the prior mean is m = sum f /
    sum n. The n-weighted variance of f/n over hosts, v, less its binomial part
    leaves the variance between hosts, t = (v - m(1-m)(H-1)/sum n) /
    (1 - sum n^2 / (sum n)^2) ; the strength is s = m(1-m)/t - 1, held
    within [1, 10000] (no visible variance: strongest). The shrunk
    rate is r = (f + s m) / (n + s), the posterior's mean; its deviation is
    sqrt(r (1 - r) / (n + s + 1))."""
    names = (*RULES, "any")
    any_ = reduce(lambda a, b: a | b, [F.col(r) for r in RULES])
    hosts = (
        rules.withColumn("any", any_)
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r)).alias(f"f_{r}") for r in names])
    )
    sums = [F.sum("n").alias("sn"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sn2")]
    sums += [F.sum(f"f_{r}").alias(f"sf_{r}") for r in names]
    sums += [F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / F.col("n")).alias(f"sq_{r}") for r in names]
    hosts = pin(hosts, "host-counts")
    p = hosts.agg(*sums).first()  # one row: the sums over all hosts
    rates = []
    for r in names:
        sn = float(p["sn"] or 1)
        m = (p[f"sf_{r}"] or 0) / sn
        v = (p[f"sq_{r}"] or 0.0) / sn - m * m
        spread = 1 - (p["sn2"] or 0.0) / (sn * sn)
        t = (v - m * (1 - m) * (p["hosts"] - 1) / sn) / spread if spread else 0.0
        s = min(max(m * (1 - m) / t - 1, 1.0), 10000.0) if t > 0 else 10000.0
        rates.append((((F.col(f"f_{r}") + s * m) / (F.col("n") + s)).alias(f"rate_{r}"), F.lit(m).alias(f"mean_{r}"), F.lit(s).alias(f"strength_{r}")))
    shrunk = hosts.select("host", "n", *[f"f_{r}" for r in names], *[c for group in rates for c in group])
    bounds = []
    for r in names:
        rate = F.col(f"rate_{r}")
        spread = CERTAINTY * F.sqrt(rate * (1 - rate) / (F.col("n") + F.col(f"strength_{r}") + 1))
        bounds += [(rate - spread).alias(f"low_{r}"), (rate + spread).alias(f"high_{r}")]
    return shrunk.select("*", *bounds).drop(*[f"strength_{r}" for r in names])


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """All columns of ``document_rules`` plus base_failed, host_dropped, kept."""
    rules = pin(document_rules(docs, host), "host-rules")
    verdicts = host_rates(rules).select(
        F.col("host").alias("_host"),
        ((F.col("low_any") >= DROP_HOST) & (F.col("low_any") > F.col("mean_any"))).alias("host_dropped"),
        *[(F.col(f"high_{r}") > FORGIVE * F.col(f"mean_{r}")).alias(f"strict_{r}") for r in SOFT],
    )
    verdicts = pin(verdicts, "host-verdicts")
    same = F.col("host").eqNullSafe(F.col("_host"))
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = rules.join(F.broadcast(verdicts), same, "left")
    else:
        salted = verdicts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rules.withColumn("_d", F.pmod(F.xxhash64("doc_id", "n_words", "n_symbols"), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, same & (F.col("_d") == F.col("_s")), "left").drop("_d", "_s")
    base_failed = F.col("short") | F.col("repeats")
    soft_failed = reduce(lambda a, b: a | b, [F.col(r) & F.col(f"strict_{r}") for r in SOFT])
    return joined.select(
        *rules.columns,
        base_failed.alias("base_failed"),
        "host_dropped",
        (~base_failed & ~F.col("host_dropped") & ~soft_failed).alias("kept"),
    )
