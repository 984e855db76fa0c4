"""Registered queries: one per operator row of the inventory.

Every query reads the driver tables through the fixture views, so its work
grows with them. Array results are rendered as strings (``1,0,0`` and
``1,0|0,1`` for nested arrays) and doubles are rounded to 6 digits, so the
DuckDB oracle (``checks/oracle.py``) can compare values exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogset.functions import labels as L
from dialogset.functions import scores as S
from dialogset.functions import text as T
from dialogset.operators import metrics as M
from dialogset.operators.align import (
    align_sequences,
    class_names,
    generated_label_ids,
    pair_by_id,
    utterance_pieces,
)
from dialogset.operators.conversations import conversation_sizes, conversations, tag_donors
from dialogset.operators.intervals import subsample_interval
from dialogset.operators.quality import emoji_count, first_occurrence_dedup, is_noise, last_context_dedup
from dialogset.operators.splits import (
    batch_ids,
    class_ratio,
    dev_test_cut,
    label_ids,
    oversample,
    prefix_limit,
    row_numbers,
    seeded_shuffle,
)
from dialogset.operators.windows import context_bounds, one_sided_examples, two_sided_examples, utterance_positions
from dialogset.plans import reports as R
from dialogset.plans.dataset import DatasetConfig, build_dataset
from dialogset.plans.scoring import char_stats_scorer, score_texts
from dialogset.session import scratch_path
from dialogset.sources import fixtures as FX
from dialogset.sources.configs import read_run_configs
from dialogset.sources.messages import annotated_filter, load_messages, write_bucketed
from dialogset.sources.metricstore import read_metrics, to_metrics, write_metrics
from dialogset.sources.splitfiles import (
    legacy_counts,
    read_legacy_json,
    read_split_labels,
    read_splits,
    read_two_sided,
    write_legacy_json,
    write_splits,
)

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values of the registered workload: budget, separator, noise ratio.
CTX = 256
CTX_LONG = 1000
SEP = ";"
NOISE_RATIO = 0.2
SYMBOL_PATTERN = "[#*%|]"  # junk symbols in `documents`, same syntax in Java and RE2
DONORS = {"test": FX.TEST_DONORS, "train": FX.TRAIN_DONORS}
KEYS = ["user_id", "thread_id", "conv_id"]
REPEATS = 200


# ---------------------------------------------------------------- rendering

def ints(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def nested(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")), "|")


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------- inputs

def messages(spark, sf, fx="messenger", text_col="line_text") -> DataFrame:
    raw = FX.messenger_fx(spark, sf) if fx == "messenger" else FX.lines_fx(spark, sf)
    return load_messages(raw, text_col=text_col)


def scored(spark, sf) -> DataFrame:
    s = FX.scored_fx(spark, sf)
    return s.withColumn("probs", S.softmax(F.array("logit0", "logit1"))).withColumn(
        "pred_class", (F.floor(F.abs(F.col("logit0")) * 10) % 10).cast("int")
    )


def vectors(spark, sf) -> DataFrame:
    """Multi-label truths and predictions derived from the scored view."""
    s = FX.scored_fx(spark, sf)
    tc = F.col("true_class")
    return s.select(
        "row_id",
        F.array(F.col("y_true"), F.when(tc % 2 == 1, 1).otherwise(0), F.when(tc >= 7, 1).otherwise(0)).alias("true"),
        F.array(
            F.col("y_pred"), F.when(F.col("logit0") > 0, 1).otherwise(0), F.when(F.col("logit1") > 0, 1).otherwise(0)
        ).alias("pred"),
    )


def one_sided(spark, sf, ctx=CTX, fx="messenger", nsp=False) -> DataFrame:
    return one_sided_examples(messages(spark, sf, fx), ctx, SEP, nsp)


def two_sided(spark, sf, ctx=CTX, fx="messenger") -> DataFrame:
    return two_sided_examples(messages(spark, sf, fx), ctx, SEP)


def dataset_cfg(**kw) -> DatasetConfig:
    base = dict(ctx=CTX, sep=SEP, no_small_pieces=True, noise_ratio=NOISE_RATIO, donors=DONORS)
    base.update(kw)
    return DatasetConfig(**base)


# ---------------------------------------------------------------- sources

def s1_load_messages(spark, sf):
    m = messages(spark, sf)
    return m.select(*KEYS, "line_num", "author", "text", ints("label").alias("label"), "is_annotated")


def s2_english_text(spark, sf):
    m = messages(spark, sf, text_col="line_text_en")
    return m.select(*KEYS, "line_num", "text")


def _written_dataset(spark, sf, two_sided_=False):
    cfg = dataset_cfg(two_sided=two_sided_)
    ds, _ = build_dataset(messages(spark, sf), cfg)
    root = scratch_path(spark, "splits")
    tag = "ctx256_two" if two_sided_ else "ctx256"
    write_splits(ds, root, "1", tag)
    return root, tag


def s3_read_split(spark, sf):
    root, tag = _written_dataset(spark, sf)
    return read_split_labels(spark, root, "1", tag, "test", "coarse")


def s5_read_two_sided(spark, sf):
    root, tag = _written_dataset(spark, sf, two_sided_=True)
    return read_two_sided(spark, root, "1", tag, "dev", "seq_multi_per_utterance")


def _legacy_documents(spark, sf) -> str:
    root = scratch_path(spark, "legacy")
    write_legacy_json(one_sided(spark, sf), root, KEYS)
    return root


def s6_legacy_import(spark, sf):
    back = read_legacy_json(spark, _legacy_documents(spark, sf), lines=True)
    return back.select("thread_id", "conv_id", "text", "coarse", ints("multi").alias("multi"),
                       ints("seq_coarse").alias("seq_coarse"), nested("seq_multi").alias("seq_multi"))


def a19_granularity_counts(spark, sf):
    counts = legacy_counts(spark, _legacy_documents(spark, sf), lines=True)
    return counts.agg(*[F.sum(f"n_{g}").alias(f"n_{g}") for g in ("coarse", "multi", "seq_coarse", "seq_multi")])


def s8_run_configs(spark, sf):
    s = FX.scored_fx(spark, sf)
    cfg = s.select(
        F.col("row_id").cast("string").alias("run_id"),
        F.concat(F.lit("fx"), F.col("true_class").cast("string")).alias("tag"),
        F.array(F.lit("0"), F.col("true_class").cast("string")).alias("target_names"),
        (F.col("true_class") + 1).alias("epochs"),
        (F.col("logit0") / 8).alias("learning_rate"),
    )
    root = scratch_path(spark, "configs")
    cfg.select(F.to_json(F.struct("*")).alias("value")).write.text(root)
    back = read_run_configs(spark, root, lines=True)
    return back.select("run_id", "tag", F.array_join("target_names", ",").alias("target_names"), "epochs",
                       r6("learning_rate").alias("learning_rate"), "model_name")


def s7_write_splits(spark, sf):
    root, tag = _written_dataset(spark, sf)
    back = read_splits(spark, root)
    return back.groupBy("split_id", "tag", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("coarse").alias("n_positive")
    )


def s9_metrics_sink(spark, sf):
    rep = R.binary_report(scored(spark, sf).select("row_id", F.col("y_true").alias("true"), "probs"))
    root = scratch_path(spark, "metrics")
    write_metrics(to_metrics(rep, "run-1", "1", "fx"), root)
    back = read_metrics(spark, root, "run-1")
    return back.select("run_id", "split_id", "tag", "metric", "label", r6("value").alias("value"))


# ---------------------------------------------------------------- filters

def p1_annotated(spark, sf):
    raw = FX.messenger_fx(spark, sf)
    return raw.where(annotated_filter("is_annotated_tagset_0")).select(*KEYS, "line_num")


def p2_donor_split(spark, sf):
    return tag_donors(messages(spark, sf), DONORS).select(*KEYS, "line_num", "split")


def p4_min_turns(spark, sf):
    m = messages(spark, sf, "lines")
    return conversation_sizes(m).where(F.col("n_turns") >= 2)


def p5_noise_filter(spark, sf):
    m = messages(spark, sf, "lines")
    return m.select(
        *KEYS,
        "line_num",
        emoji_count("text", SYMBOL_PATTERN).alias("n_symbols"),
        is_noise("text", NOISE_RATIO, SYMBOL_PATTERN).alias("is_noise"),
    )


def _gold(raw: DataFrame) -> Column:
    return F.concat(L.active_indices(raw["gold_nhot"]), F.array(F.col("l2")))


def p6_gold_filter(spark, sf):
    raw = FX.messenger_fx(spark, sf)
    return raw.select("conv_id", "line_num", ints(L.keep_below(_gold(raw), 6)).alias("gold"))


# ---------------------------------------------------------------- aggregations

MAX_TURNS_PER_ROW = 10_000


def _bucketed(spark, sf, fx="messenger"):
    """The messages stored by conversation, as a table."""
    path = scratch_path(spark, "messages")
    name = "messages_" + path.rsplit("-", 1)[-1]
    write_bucketed(messages(spark, sf, fx), name, 16, path)
    return spark.table(name)


def a1_conversations_bucketed(spark, sf):
    return _conversation_rows(_bucketed(spark, sf))


def a1_conversations(spark, sf):
    return _conversation_rows(messages(spark, sf))


def _conversation_rows(m):
    c = conversations(m, max_turns_per_row=MAX_TURNS_PER_ROW)
    return c.select(
        *KEYS,
        "part_no",
        "n_turns",
        ints("line_nums").alias("line_nums"),
        F.md5(F.array_join("texts", "\u0001")).alias("texts_md5"),
        nested("labels").alias("labels"),
        F.array_join("authors", ",").alias("authors"),
    )


def a2_window_coarse(spark, sf):
    return one_sided(spark, sf).select(*KEYS, "target_idx", "coarse")


def a3_window_multi(spark, sf):
    return one_sided(spark, sf).select(*KEYS, "target_idx", ints("multi").alias("multi"))


def a4_seq_labels(spark, sf):
    return one_sided(spark, sf).select(
        *KEYS, "target_idx", ints("seq_coarse").alias("seq_coarse"), nested("seq_multi").alias("seq_multi")
    )


def a5_two_sided_labels(spark, sf):
    return two_sided(spark, sf).select(*KEYS, "target_idx", "coarse", ints("multi").alias("multi"))


def _lines_dataset_examples(spark, sf, two=False):
    from dialogset.plans.dataset import examples

    cfg = dataset_cfg(two_sided=two, noise_pattern=SYMBOL_PATTERN)
    return examples(messages(spark, sf, "lines"), cfg), cfg


def a6_rejections(spark, sf):
    ex, cfg = _lines_dataset_examples(spark, sf)
    _, rej = first_occurrence_dedup(ex, cfg.noise_ratio, pattern=cfg.noise_pattern)
    return rej.select("split", "text", "n_duplicate", "n_noise", "n_rejected")


def a7_class_ratio(spark, sf):
    c = class_ratio(FX.imbalance_fx(spark, sf))
    return c.select(r6("neg").alias("neg"), r6("pos").alias("pos"))


def a8_confusion_matrix(spark, sf):
    s = scored(spark, sf).select(F.col("true_class").alias("true"), F.col("pred_class").alias("pred"))
    return M.confusion_matrix(s)


def a9_multilabel_confusion(spark, sf):
    return M.multilabel_counts(vectors(spark, sf)).select("label", "tn", "fp", "fn", "tp")


def a10_binary_metrics(spark, sf):
    s = scored(spark, sf).select(F.col("y_true").alias("true"), F.col("y_pred").alias("pred"))
    b = M.binary_metrics(s)
    return b.select(*[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def a11_f1_multiclass(spark, sf):
    s = scored(spark, sf).select(F.col("true_class").alias("true"), F.col("pred_class").alias("pred"))
    return M.f1_multiclass(s).select("average", r6("f1").alias("f1"))


def a12_f1_multilabel(spark, sf):
    return M.f1_multilabel(vectors(spark, sf)).select("average", r6("f1").alias("f1"))


def a13_subset_accuracy(spark, sf):
    return M.subset_accuracy(vectors(spark, sf)).select(r6("accuracy").alias("accuracy"))


def a14_roc_auc(spark, sf):
    s = scored(spark, sf).select(F.col("y_true").alias("y"), F.col("probs")[1].alias("score"))
    return M.roc_auc(s).select(r6("auc").alias("auc"))


def a15_roc_auc_hard(spark, sf):
    b = scored(spark, sf).select(F.col("y_true").alias("true"), F.col("y_pred").alias("pred"))
    binary = M.roc_auc_hard(b).select(r6("auc").alias("binary"))
    ml = M.roc_auc_hard_multilabel(vectors(spark, sf)).select(r6("micro").alias("micro"), r6("weighted").alias("weighted"))
    return binary.select("binary", ml.select("micro").scalar().alias("micro"), ml.select("weighted").scalar().alias("weighted"))


def a16_mean_quantiles(spark, sf):
    s = scored(spark, sf)
    q = M.mean_interval(s, "logit0", ["true_class"])
    return q.select("true_class", r6("lower").alias("lower"), r6("upper").alias("upper"), r6("mean").alias("mean"))


def _ci(df, **kw):
    return subsample_interval(df, "true", "pred", "row_id", repeats=REPEATS, seed=0, **kw).select(
        "average", r6("lower").alias("lower"), r6("upper").alias("upper"), r6("mean").alias("mean")
    )


def a17_subsample_ci(spark, sf):
    s = scored(spark, sf).select("row_id", F.col("true_class").alias("true"), F.col("pred_class").alias("pred"))
    return _ci(s)


def a17_subsample_ci_pooled(spark, sf):
    s = scored(spark, sf).select("row_id", F.col("y_true").alias("true"), F.col("y_pred").alias("pred"))
    return _ci(s, pooled=True)


def a17_subsample_ci_multilabel(spark, sf):
    return _ci(vectors(spark, sf), multilabel=True)


def a17_subsample_ci_cells(spark, sf):
    return a17_subsample_ci(spark, sf)


def a17_subsample_ci_rows(spark, sf):
    """Row ranks instead of cell counts: the rows of a repeat are known by id."""
    s = scored(spark, sf).select("row_id", F.col("true_class").alias("true"), F.col("pred_class").alias("pred"))
    return _ci(s, mode="rows")


def a18_encoded_f1(spark, sf):
    s = scored(spark, sf).select((F.col("y_true") + 10 * F.col("y_pred")).alias("code"))
    return M.encoded_f1(s).select(r6("f1").alias("f1"))


def a21_bleu(spark, sf):
    c = FX.table(spark, sf, "conversations")
    pairs = c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"),
        F.col("text").alias("reference"),
        F.replace(F.col("text"), F.lit("e"), F.lit("a")).alias("hypothesis"),
    )
    return M.corpus_bleu(pairs).select(r6("bleu").alias("bleu"))


# ---------------------------------------------------------------- windows and examples

def w1_backward_context(spark, sf, ctx=CTX):
    m = messages(spark, sf)
    b = context_bounds(utterance_positions(m), ctx)
    return b.select(*KEYS, "idx", "start_idx")


def w1_backward_context_lines(spark, sf):
    m = messages(spark, sf, "lines")
    b = context_bounds(utterance_positions(m), CTX)
    return b.select(*KEYS, "idx", "start_idx")


def w2_forward_context(spark, sf, ctx=CTX):
    m = messages(spark, sf)
    b = context_bounds(utterance_positions(m), ctx)
    return b.select(*KEYS, "idx", "end_idx")


def w2_forward_context_lines(spark, sf):
    m = messages(spark, sf, "lines")
    b = context_bounds(utterance_positions(m), CTX)
    return b.select(*KEYS, "idx", "end_idx")


def w3_no_small_pieces(spark, sf):
    return one_sided(spark, sf, nsp=True).select(*KEYS, "target_idx", "start_idx")


def w3_no_small_pieces_lines(spark, sf):
    return one_sided(spark, sf, fx="lines", nsp=True).select(*KEYS, "target_idx", "start_idx")


def _w4a(ex):
    return ex.select(
        *KEYS, "target_idx", "start_idx", "text", "coarse", ints("multi").alias("multi"),
        ints("seq_coarse").alias("seq_coarse"), nested("seq_multi").alias("seq_multi"),
    )


def w4a_one_sided(spark, sf):
    return _w4a(one_sided(spark, sf))


def w4a_one_sided_1000(spark, sf):
    return _w4a(one_sided(spark, sf, ctx=CTX_LONG))


def w4a_one_sided_lines(spark, sf):
    return _w4a(one_sided(spark, sf, fx="lines"))


def w4a_one_sided_bucketed(spark, sf):
    """W4a over messages stored by conversation: the same rows without an exchange."""
    return _w4a(one_sided_examples(_bucketed(spark, sf, "lines"), CTX, SEP))


def _w4b(ex):
    return ex.select(
        *KEYS, "target_idx", "start_idx", "end_idx", "text", "context", "coarse", ints("multi").alias("multi"),
        ints("seq_coarse").alias("seq_coarse"), nested("seq_multi").alias("seq_multi"),
    )


def w4b_two_sided(spark, sf):
    return _w4b(two_sided(spark, sf))


def w4b_two_sided_1000(spark, sf):
    return _w4b(two_sided(spark, sf, ctx=CTX_LONG))


def w4b_two_sided_lines(spark, sf):
    return _w4b(two_sided(spark, sf, fx="lines"))


def w5_first_dedup(spark, sf):
    ex, cfg = _lines_dataset_examples(spark, sf)
    kept, _ = first_occurrence_dedup(ex, cfg.noise_ratio, pattern=cfg.noise_pattern)
    return kept.select("split", *KEYS, "target_idx", "text")


def w6_last_context_dedup(spark, sf):
    ex, cfg = _lines_dataset_examples(spark, sf, two=True)
    kept = last_context_dedup(ex, cfg.noise_ratio, pattern=cfg.noise_pattern)
    return kept.select("split", *KEYS, "target_idx", "text")


def w6_exact_pair_dedup(spark, sf):
    ex, cfg = _lines_dataset_examples(spark, sf, two=True)
    kept = last_context_dedup(ex, cfg.noise_ratio, pattern=cfg.noise_pattern, exact=True)
    return kept.select("split", *KEYS, "target_idx", "text")


def w7_dev_test_cut(spark, sf):
    ex, cfg = _lines_dataset_examples(spark, sf)
    kept, _ = first_occurrence_dedup(ex, cfg.noise_ratio, pattern=cfg.noise_pattern)
    return dev_test_cut(kept).select("split", "part", *KEYS, "target_idx")


def w9_batches(spark, sf):
    s = FX.scored_fx(spark, sf).select(F.col("row_id").alias("vec_id"))
    rn = row_numbers(s, [("vec_id", True)], out="row_id")
    return batch_ids(rn, 32).select("vec_id", "row_id", "batch_id")


def _w10(ds):
    return ds.select(
        "split", "part", *KEYS, "target_idx", "start_idx", "text", "coarse", ints("multi").alias("multi"),
        ints("seq_coarse").alias("seq_coarse"), nested("seq_multi").alias("seq_multi"),
    )


def w10_build_dataset(spark, sf):
    ds, _ = build_dataset(messages(spark, sf), dataset_cfg())
    return _w10(ds)


def w10_build_dataset_two_sided(spark, sf):
    ds, _ = build_dataset(messages(spark, sf), dataset_cfg(two_sided=True, ctx=CTX_LONG))
    return ds.select(
        "split", "part", *KEYS, "target_idx", "start_idx", "end_idx", "text", "context", "coarse",
        ints("multi").alias("multi"), ints("seq_coarse").alias("seq_coarse"), nested("seq_multi").alias("seq_multi"),
    )


# ---------------------------------------------------------------- sorts, limits, sampling

def f2_label_ids(spark, sf):
    g = FX.generated_fx(spark, sf)
    vocab = g.select(T.first_label("true_text", strip=False).alias("label")).union(
        g.select(T.first_label("pred_text").alias("label"))
    )
    return label_ids(vocab, "label", "label_id")


def f3_prefix_limit(spark, sf):
    g = FX.generated_fx(spark, sf)
    return prefix_limit(g, 200).select("row_id", "true_text", "pred_text")


def f4_oversample(spark, sf):
    return oversample(FX.imbalance_fx(spark, sf)).select("row_id", "label", "copy_no")


def f5_seeded_shuffle(spark, sf):
    o = oversample(FX.imbalance_fx(spark, sf))
    order = [("shuffle_key", True), ("row_id", True), ("copy_no", True)]
    placed = row_numbers(seeded_shuffle(o, 1).select("shuffle_key", "row_id", "copy_no"), order, out="position")
    return placed.select("row_id", "copy_no", "shuffle_key", "position")


# ---------------------------------------------------------------- scalar functions

def _raw(spark, sf):
    return FX.messenger_fx(spark, sf)


def h1_join_texts(spark, sf):
    a = conversations(messages(spark, sf), max_turns_per_row=MAX_TURNS_PER_ROW)
    return a.select(*KEYS, "part_no", T.join_texts("texts", SEP).alias("joined"))


def h2_n_chars(spark, sf):
    return _raw(spark, sf).select("conv_id", "line_num", T.n_chars("line_text").alias("n_chars"))


def h3_emoji_count(spark, sf):
    c = FX.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", emoji_count("text").alias("n_emoji"))


# letters of the given texts turned into emoji, a sign, half a flag, a joiner and a skin tone
MARKED = ("aeotnr", "\U0001F600\u00A9\U0001F1E8\u200D\U0001F44D\U0001F3FD")


def h3_emoji_marked(spark, sf):
    """The given texts hold no emoji: here some of their letters become one."""
    c = FX.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", emoji_count(F.translate("text", *MARKED)).alias("n_emoji"))


def h4_softmax(spark, sf):
    s = scored(spark, sf)
    return s.select("row_id", r6(F.col("probs")[0]).alias("p0"), r6(F.col("probs")[1]).alias("p1"))


def _logits3(s):
    return F.array("logit0", "logit1", F.col("logit0") + F.col("logit1"))


def h5_sigmoid(spark, sf):
    s = FX.scored_fx(spark, sf)
    p = S.sigmoid(_logits3(s))
    return s.select("row_id", *[r6(p[i]).alias(f"p{i}") for i in range(3)])


def h6_threshold_nhot(spark, sf):
    s = FX.scored_fx(spark, sf)
    return s.select("row_id", ints(S.threshold_nhot(S.sigmoid(_logits3(s)))).alias("nhot"))


def h7_threshold_class(spark, sf):
    s = scored(spark, sf)
    return s.select("row_id", S.threshold_class("probs", 0.5).alias("cls"))


def h8_argmax(spark, sf):
    s = FX.scored_fx(spark, sf)
    return s.select("row_id", S.argmax(_logits3(s)).alias("cls"))


def h9_active_indices(spark, sf):
    r = _raw(spark, sf)
    return r.select("conv_id", "line_num", ints(L.active_indices("gold_nhot")).alias("active"))


def h10_any_above_zero(spark, sf):
    r = _raw(spark, sf)
    return r.select("conv_id", "line_num", L.any_label_above_zero("gold_nhot").alias("flag"))


def h11_nhot_to_coarse(spark, sf):
    r = _raw(spark, sf)
    return r.select("conv_id", "line_num", L.nhot_to_coarse("gold_nhot").alias("coarse"))


def h12_clamp(spark, sf):
    r = _raw(spark, sf)
    return r.select("conv_id", "line_num", L.clamp_label("l1", 6).alias("c1"), L.clamp_label("l2", 6).alias("c2"))


def h13_two_annotators(spark, sf):
    r = _raw(spark, sf)
    return r.select("conv_id", "line_num", ints(L.two_annotators("l1", "l2", 0, 6)).alias("labels"))


def h14_merge_gold(spark, sf):
    r = _raw(spark, sf)
    merged = L.merge_gold("l1", "l2", _gold(r), "is_checked_sup", 0, 6)
    return r.select("conv_id", "line_num", ints(merged).alias("labels"))


def h15_window_certain(spark, sf):
    r = _raw(spark, sf)
    a1 = F.array("y0", "y1", "y2")
    a2 = F.array("y1", "y0")
    dec = F.array(F.col("is_checked_sup"), F.col("is_annotated_tagset_0"), F.lit(False))
    return r.select("conv_id", "line_num", L.window_certain(a1, a2, dec).alias("certain"))


def h16_verbalize_input(spark, sf):
    ex = two_sided(spark, sf)
    return ex.select(*KEYS, "target_idx", T.verbalize_input("text", "context").alias("input"))


def h17_verbalize_label(spark, sf):
    ex = two_sided(spark, sf)
    return ex.select(
        *KEYS,
        "target_idx",
        T.verbalize_label("coarse", "seq_coarse").alias("v_coarse"),
        T.verbalize_label("multi", "seq_multi").alias("v_multi"),
        T.verbalize_label("seq_multi", "seq_multi_per_utterance").alias("v_seq"),
    )


def h18_first_label(spark, sf):
    g = FX.generated_fx(spark, sf)
    return g.select("row_id", T.first_label("pred_text").alias("pred_first"),
                    T.first_label("true_text", strip=False).alias("true_first"))


def h19_split_sequence(spark, sf):
    g = FX.generated_fx(spark, sf)
    return g.select("row_id", F.posexplode(T.split_utterances("pred_seq")).alias("pos", "piece"))


def h20_is_positive(spark, sf):
    g = FX.generated_fx(spark, sf)
    return g.select("row_id", T.is_positive("pred_coarse").alias("pred"), T.is_positive("true_coarse", strip=False).alias("true"))


def _tok(spark, sf):
    c = FX.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.tokens("text").alias("tok"))


def h21_keep_last(spark, sf):
    t = _tok(spark, sf)
    return t.select("conv_id", "turn", F.array_join(T.keep_last("tok", 16), " ").alias("kept"))


def h22_keep_first(spark, sf):
    t = _tok(spark, sf)
    return t.select("conv_id", "turn", F.array_join(T.keep_first("tok", 16), " ").alias("kept"))


def h23_tokens(spark, sf):
    t = _tok(spark, sf)
    return t.select("conv_id", "turn", F.size("tok").alias("n_tokens"), F.md5(F.array_join("tok", "\u0001")).alias("tok_md5"))


def h24_round(spark, sf):
    s = scored(spark, sf).select(F.col("y_true").alias("true"), F.col("y_pred").alias("pred"))
    return M.binary_metrics(s).select(T.round4("f1").alias("f1"), T.round4("precision").alias("precision"))


def h25_to_nhot(spark, sf):
    r = _raw(spark, sf)
    return r.select("conv_id", "line_num", ints(L.to_nhot(L.two_annotators("l1", "l2", 0, 6))).alias("nhot"))


# ---------------------------------------------------------------- joins

def j2_pair_predictions(spark, sf):
    s = FX.scored_fx(spark, sf)
    pred = s.select("row_id", F.col("y_pred").alias("pred"))
    truth = s.select("row_id", F.col("y_true").alias("true"))
    return pair_by_id(pred, truth).select("row_id", "pred", "true")


def j3_zip_shortest(spark, sf):
    r = _raw(spark, sf)
    z = L.zip_shortest(F.array("y0", "y1", "y2"), F.array("l1", "l2"))
    return r.select("conv_id", "line_num", F.array_join(F.transform(z, lambda e: F.concat_ws(":", e["f0"].cast("string"), e["f1"].cast("string"))), ",").alias("zipped"))


def j4_label_lookup(spark, sf):
    g = FX.generated_fx(spark, sf)
    a = g.select("row_id", F.col("true_text").alias("true"), T.first_label("pred_text").alias("pred"))
    return generated_label_ids(a, per_utterance=False).select("row_id", "true_id", "pred_id")


def _pieces(spark, sf, mode):
    g = FX.generated_fx(spark, sf)
    preds, trues = utterance_pieces(g, "pred_seq", "true_seq")
    return align_sequences(preds, trues, "row_id", mode)


def j5_label_lookup_default(spark, sf):
    ids = generated_label_ids(_pieces(spark, sf, "batch"), per_utterance=True)
    return ids.select("row_id", "pos", "true_id", "pred_id")


def j6_class_names(spark, sf):
    s = FX.scored_fx(spark, sf)
    return s.select("row_id", class_names(F.col("true_class") % 6, T.default_class_names()).alias("name"))


def j7_align_batch(spark, sf):
    return _pieces(spark, sf, "batch")


def j7_align_utterance(spark, sf):
    return _pieces(spark, sf, "utterance")


# ---------------------------------------------------------------- jobs and reports

def k1_batch_scoring(spark, sf):
    d = FX.imbalance_fx(spark, sf)
    s = score_texts(d, char_stats_scorer, "text", keep=["row_id"])
    return s.select("row_id", r6(F.col("logits")[0]).alias("l0"), r6(F.col("logits")[1]).alias("l1"))


def _train_test(df, *keys):
    """Four fifths to fit on, one fifth to score, by a hash of ``keys``."""
    held_out = F.pmod(F.xxhash64(*keys), F.lit(5)) == 0
    return df.where(~held_out), df.where(held_out)


def k2_binary_classifier(spark, sf):
    from dialogset.plans.models import predict_binary, train_binary

    d = FX.imbalance_fx(spark, sf)
    train, test = _train_test(d, "row_id")
    p = predict_binary(train_binary(train), test, ["row_id", "label"])
    return p.select("row_id", "label", S.argmax("probs").alias("pred"))


def k2_training_rows(spark, sf):
    from dialogset.plans.models import class_weighted

    return class_weighted(FX.imbalance_fx(spark, sf)).select("row_id", "label", "copy_no", r6("weight").alias("weight"))


def k2_train_score_report(spark, sf):
    from dialogset.plans.training import train_score_report

    root, tag = _written_dataset(spark, sf)
    rep = train_score_report(spark, root, "1", tag, scratch_path(spark, "metrics"), "run-1", repeats=REPEATS)
    return rep.select("run_id", "split_id", "tag", "metric", "label", r6("value").alias("value"))


def k3_multilabel_classifier(spark, sf):
    from dialogset.plans.models import predict_multilabel, train_multilabel

    m = messages(spark, sf).select("text", F.col("label").alias("multi"), *KEYS, "line_num")
    train, test = _train_test(m, *KEYS)
    p = predict_multilabel(train_multilabel(train, 6), test, [*KEYS, "line_num"])
    return p.select(*KEYS, "line_num", ints(S.threshold_nhot("probs")).alias("pred"))


def _report(df):
    return df.select("metric", "label", r6("value").alias("value"))


def k4_binary_report(spark, sf):
    s = scored(spark, sf).select("row_id", F.col("y_true").alias("true"), "probs")
    return _report(R.binary_report(s, repeats=REPEATS))


def k5_multilabel_report(spark, sf):
    v = vectors(spark, sf)
    s = FX.scored_fx(spark, sf)
    logits = F.array(F.col("logit0"), F.col("logit1"), F.col("logit0") - F.col("logit1"))
    p = v.join(s.select("row_id", "y_true", S.sigmoid(logits).alias("probs")), "row_id")
    return _report(R.multilabel_report(p, "true", "probs", "y_true", repeats=50))


def k6_generated_coarse(spark, sf):
    g = FX.generated_fx(spark, sf)
    return _report(R.generated_report(g, "coarse", "true_coarse", "pred_coarse", repeats=REPEATS))


def k6_generated_fine(spark, sf):
    g = FX.generated_fx(spark, sf)
    return _report(R.generated_report(g, "fine", "true_text", "pred_text", repeats=REPEATS))


def k6_generated_per_utterance(spark, sf):
    g = FX.generated_fx(spark, sf)
    return _report(R.generated_report(g, "per_utterance", "true_seq", "pred_seq", repeats=REPEATS))


def _stand_in_strings(df: DataFrame) -> DataFrame:
    """Generated strings of a stand-in model: a rule on the text's length."""
    m = F.length("text") % 4
    return df.withColumn("generated", F.when(m == 0, " positive").when(m == 1, "other").otherwise("negative"))


def k7_cross_lingual(spark, sf):
    ds, _ = build_dataset(messages(spark, sf, text_col="line_text_en"), dataset_cfg(two_sided=True))
    root = scratch_path(spark, "splits")
    write_splits(ds, root, "1", "ctx256_two_en")
    test = read_two_sided(spark, root, "1", "ctx256_two_en", "test", "seq_coarse")
    rep = R.cross_lingual_report(test, _stand_in_strings, "coarse", "ctx256_two", "ctx256_two_en", repeats=REPEATS)
    return rep.select("train_tag", "test_tag", "metric", "label", r6("value").alias("value"))


QUERIES: dict[str, Query] = {
    name: fn
    for name, fn in sorted(globals().items())
    if callable(fn) and name[:1] in "spafwhjk" and name[1:2].isdigit() and "_" in name
}
