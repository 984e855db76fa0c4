"""Character-budget context windows and example rows.

Notation, per conversation in ``line_num`` order: ``idx`` is the 0-based
position, ``B`` the number of characters before the utterance, ``E = B +
length``. Utterance ``j`` with text covers the character positions
``[B_j, E_j)``.

* W1 (backward) ``start(t)``: walking left from ``t``, the first utterance
  at which at least ``ctx`` characters were collected (target excluded), else
  0. That is the utterance covering position ``B_t - ctx``.
* W2 (forward) ``end(t)``: walking right, the first utterance at which at
  least ``ctx`` characters after the target were collected, else the last one.
  That is the utterance covering position ``E_t + ctx - 1``.

By symmetry, utterance ``j`` belongs to the two-sided window of exactly the
targets ``start(j) .. end(j)`` and to the one-sided window of the targets
``j .. end(j)``.

Windows are assembled in *halo blocks*: ``HALO`` consecutive targets of a
conversation and copies of the utterances around them that their windows
need. Inside a block a window is a slice of one sorted array, so a text is
copied once per block that needs it and not once per window; work per block
is its utterances plus the windows it returns.

* Conversations of at most ``dialogset.scan.hotGroupRows`` rows take one
  exchange, by conversation, which carries the texts; positions, ``start``,
  ``end`` and blocks follow inside it (a range frame over the characters
  before an utterance, or over those up to its end, finds the one covering
  a position, as its distance is the constant ``ctx``).
* Hot conversations are never held by one task: their positions come from
  the block scan over narrow rows, the covering utterance from a lookup in
  fixed slices of characters, and the texts meet their target ranges by
  (conversation, ``line_num``) and go to their blocks by (conversation, block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogset.functions import labels as L
from dialogset.operators.scan import join_null_safe, ordered_scan, split_hot, window_scan
from dialogset.schema import CONV_KEYS

DEFAULT_CHUNK = 1 << 16  # characters per lookup partition
HALO = 128  # targets per block
_ROW_TYPE = "array<struct<kind:int,which:string,q:bigint,chunk:bigint,key:bigint,cand:bigint>>"


def utterance_positions(msgs: DataFrame, keys=CONV_KEYS) -> DataFrame:
    """Per utterance: ``idx``, ``n_turns``, ``n_chars``, ``chars_before`` (B),
    ``conv_chars``, ``first_chars``, ``is_pos`` and ``pos_before`` (A20).

    Only narrow columns take part in the scan; the texts stay where they are.
    ``line_num`` must be unique within a conversation (checked in the scan)."""
    s = ordered_scan(_measured(msgs, keys), keys, seq_col="idx", size_col="n_turns", **_SCAN)
    return _positions(s, keys)


def wide_positions(msgs: DataFrame, keys, *payload: str) -> DataFrame:
    """``utterance_positions`` and ``payload`` of conversations a task may
    hold: one exchange by conversation (none over a table bucketed by it)."""
    scanned = window_scan(_measured(msgs, keys, *payload), keys, seq_col="idx", size_col="n_turns", **_SCAN)
    return _positions(scanned, keys, *payload)


_SCAN = dict(order=[("line_num", True)], sums=["n_chars", "is_pos"], prev=["line_num"], firsts=["n_chars"])


def _measured(msgs: DataFrame, keys, *extra: str) -> DataFrame:
    return msgs.select(*keys, "line_num", F.length("text").alias("n_chars"), L.utterance_positive("label").alias("is_pos"), *extra)


def _positions(scanned: DataFrame, keys, *extra: str) -> DataFrame:
    # line_num must order a conversation; a tie would be ambiguous (and would
    # multiply rows in the text join), so it fails the query instead
    tie = (F.col("idx") > 0) & F.col("line_num_prev").eqNullSafe(F.col("line_num"))
    idx = F.when(
        tie,
        F.raise_error(F.concat(F.lit("duplicate line_num in conversation: "), F.to_json(F.struct(*keys, "line_num")))),
    ).otherwise(F.col("idx"))
    return scanned.select(
        *keys,
        "line_num",
        idx.cast("long").alias("idx"),
        "n_turns",
        "n_chars",
        F.col("n_chars_before").alias("chars_before"),
        F.col("n_chars_total").alias("conv_chars"),
        F.col("n_chars_first").alias("first_chars"),
        "is_pos",
        F.col("is_pos_before").alias("pos_before"),
        *extra,
    )


def _lookups(pos: DataFrame, ctx: int, keys, chunk: int, directions: tuple[str, ...]) -> DataFrame:
    """Answer the budget lookups of every utterance in one pass.

    Each utterance emits one query row per direction (``b``: position
    ``B - ctx``; ``f``: position ``E + ctx - 1``) and, if it has text, one
    candidate row per ``chunk``-character slice it covers. Query and
    candidates meet in a window partitioned by (conversation, slice); the
    covering utterance is the last candidate starting at or before the query
    position (a running max in position order). Slices bound the work per
    task even for one giant conversation; replication adds at most
    ``length / chunk + 1`` rows per utterance.

    Returns the query rows: the columns of ``pos`` plus ``_which`` and
    ``_hit`` (``start(j)`` for ``b``, ``end(j)`` for ``f``)."""
    payload = pos.columns
    b = F.col("chars_before")
    e = b + F.col("n_chars")
    qpos = {"b": b - ctx, "f": e + ctx - 1}

    def row(kind, which, q, ch, key, cand):
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(which).cast("string").alias("which"),
            q.cast("long").alias("q"),
            ch.cast("long").alias("chunk"),
            key.cast("long").alias("key"),
            cand.cast("long").alias("cand"),
        )

    queries = F.array(*[row(1, d, qpos[d], F.floor(qpos[d] / chunk), qpos[d], F.lit(None)) for d in directions])
    slices = F.sequence(F.floor(b / chunk), F.floor((e - 1) / chunk))
    cands = F.when(
        F.col("n_chars") > 0,
        F.transform(slices, lambda c: row(0, None, F.lit(None), c, b, F.col("idx"))),
    ).otherwise(F.array().cast(_ROW_TYPE))
    rows = pos.select(*payload, F.explode(F.concat(cands, queries)).alias("_r")).select(*payload, "_r.*")
    w = Window.partitionBy(*keys, "chunk").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    hit = rows.withColumn("_run", F.max("cand").over(w)).where(F.col("kind") == 1)
    value = (
        F.when(F.col("which") == "b", F.when(F.col("q") < 0, F.lit(0)).otherwise(F.col("_run")))
        .otherwise(F.when(F.col("q") >= F.col("conv_chars"), F.col("n_turns") - 1).otherwise(F.col("_run")))
        .cast("long")
    )
    return hit.select(*payload, F.col("which").alias("_which"), value.alias("_hit"))


def context_bounds(pos: DataFrame, ctx: int, keys=CONV_KEYS, chunk: int | None = None) -> DataFrame:
    """W1 + W2: ``start_idx`` (backward budget) and ``end_idx`` (forward
    budget) of every utterance of ``utterance_positions`` (one row each).

    ``ctx <= 0`` gives ``start = end = idx``."""
    if ctx <= 0:
        return pos.withColumn("start_idx", F.col("idx")).withColumn("end_idx", F.col("idx"))
    found = _lookups(pos, ctx, keys, chunk or max(DEFAULT_CHUNK, ctx), ("b", "f"))
    return found.groupBy(*keys, "idx").agg(
        *[F.first(c).alias(c) for c in pos.columns if c not in (*keys, "idx")],
        F.max(F.when(F.col("_which") == "b", F.col("_hit"))).alias("start_idx"),
        F.max(F.when(F.col("_which") == "f", F.col("_hit"))).alias("end_idx"),
    )


def _no_small_pieces_keep(ctx: int) -> F.Column:
    """W3 as a per-target flag. The reference stops at the first target (from
    the end) whose window reaches the start with no positive before it. The
    targets meeting that condition form a prefix 1..K of the conversation, so
    target k is kept iff it fails the condition, or k+1 fails it, or k is last."""
    b = F.col("chars_before")
    e = b + F.col("n_chars")
    budget = F.lit(ctx) + F.col("first_chars")
    cond = (b < budget) & (F.col("pos_before") == 0)
    cond_next = (e < budget) & ((F.col("pos_before") + F.col("is_pos")) == 0)
    return (~cond) | (~cond_next) | (F.col("idx") == F.col("n_turns") - 1)


def _framed(pos: DataFrame, ctx: int, keys) -> DataFrame:
    """``start_idx`` and ``end_idx`` from range frames, for conversations a task may hold."""
    if ctx <= 0:
        return context_bounds(pos, ctx, keys)
    conv = Window.partitionBy(*keys)
    spoken = F.when(F.col("n_chars") > 0, F.col("idx"))
    pos = pos.withColumn("_end", F.col("chars_before") + F.col("n_chars"))
    back = conv.orderBy("chars_before").rangeBetween(Window.unboundedPreceding, -ctx)
    ahead = conv.orderBy(F.desc("_end")).rangeBetween(Window.unboundedPreceding, -ctx)
    return pos.select(
        "*",
        F.coalesce(F.max(spoken).over(back), F.lit(0)).cast("long").alias("start_idx"),
        F.coalesce(F.min(spoken).over(ahead), F.col("n_turns") - 1).cast("long").alias("end_idx"),
    ).drop("_end")


def _block_rows(rows: DataFrame, keys, two_sided: bool) -> DataFrame:
    """keys, ``halo``, ``e``: every utterance once per block that needs it.
    ``rows``: positions with ``start_idx``, ``end_idx``, ``cut`` (the first
    target that is kept), text and label. Utterances in no kept target's
    window are left out here."""
    idx = F.col("idx")
    lo = F.col("start_idx") if two_sided else F.greatest(idx, F.col("cut"))
    hi = F.col("end_idx")
    halo = F.when(lo <= hi, F.sequence(F.floor(lo / HALO), F.floor(hi / HALO))).otherwise(F.array().cast("array<long>"))
    elem = F.struct("idx", "line_num", "text", "label", "start_idx", "end_idx", (idx >= F.col("cut")).alias("target"))
    return rows.select(*keys, F.explode(halo).alias("halo"), elem.alias("e"))


def _windows(blocks: DataFrame, keys, two_sided: bool) -> DataFrame:
    """keys and ``x``: idx, line_num, text, label, start_idx, end_idx and the
    members ``w`` of every target's window."""
    held = blocks.groupBy(*keys, "halo").agg(F.array_sort(F.collect_list("e")).alias("es"))

    def window(x):
        last = x["end_idx"] if two_sided else x["idx"]
        members = F.slice(F.col("es"), (x["start_idx"] - F.col("es")[0]["idx"] + 1).cast("int"), (last - x["start_idx"] + 1).cast("int"))
        return F.struct(x["idx"].alias("idx"), x["line_num"].alias("line_num"), x["text"].alias("text"), x["label"].alias("label"),
                        x["start_idx"].alias("start_idx"), x["end_idx"].alias("end_idx"), members.alias("w"))

    own = F.filter("es", lambda x: x["target"] & (F.floor(x["idx"] / HALO) == F.col("halo")))
    return held.select(*keys, F.explode(F.transform(own, window)).alias("x"))


def _with_cut(bounds: DataFrame, ctx: int, keys, first: int, no_small_pieces: bool, whole=None) -> DataFrame:
    """Add ``cut``, the first target that is kept: ``first``, or with W3 the
    first at or after it whose flag says so (the targets dropped are a prefix)."""
    if not (no_small_pieces and ctx > 0):
        return bounds.withColumn("cut", F.lit(first).cast("long"))
    kept = F.min(F.when(_no_small_pieces_keep(ctx) & (F.col("idx") >= first), F.col("idx")))
    if whole is not None:
        return bounds.withColumn("cut", kept.over(whole))
    return join_null_safe(bounds, bounds.groupBy(*keys).agg(kept.alias("cut")), keys)


def member_blocks(
    msgs: DataFrame, ctx: int, keys=CONV_KEYS, chunk: int | None = None, positions: DataFrame | None = None,
    two_sided: bool = False, no_small_pieces: bool = False,
) -> DataFrame:
    """The halo blocks' rows of all conversations of at least two utterances
    (P4). With ``positions`` given, or for hot conversations, positions are
    narrow rows and meet the texts by ``line_num``."""
    first = 0 if two_sided else 1
    cold, hot, _ = (None, msgs, 0) if positions is not None else split_hot(msgs, keys)
    out = []
    if cold is not None:
        rows = _framed(wide_positions(cold, keys, "text", "label").where(F.col("n_turns") >= 2), ctx, keys)
        rows = _with_cut(rows, ctx, keys, first, no_small_pieces, Window.partitionBy(*keys))
        out.append(_block_rows(rows, keys, two_sided))
    if hot is not None:
        pos = positions if positions is not None else utterance_positions(hot, keys)
        bounds = context_bounds(pos.where(F.col("n_turns") >= 2), ctx, keys, chunk)
        bounds = _with_cut(bounds, ctx, keys, first, no_small_pieces)
        narrow = bounds.select(*keys, "line_num", "idx", "start_idx", "end_idx", "cut")
        rows = join_null_safe(hot.select(*keys, "line_num", "text", "label"), narrow, [*keys, "line_num"])
        out.append(_block_rows(rows, keys, two_sided))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def one_sided_examples(
    msgs: DataFrame,
    ctx: int,
    sep: str = ";",
    no_small_pieces: bool = False,
    keys=CONV_KEYS,
    chunk: int | None = None,
    positions: DataFrame | None = None,
) -> DataFrame:
    """For targets 1..n-1 of every conversation with >= 2 utterances,
    the window ``start..target`` joined by ``sep`` with labels A2-A4.

    Columns: keys, ``target_idx``, ``start_idx``, ``target_line``, ``text``,
    ``utterances``, ``coarse``, ``multi``, ``seq_coarse``, ``seq_multi``."""
    x = _windows(member_blocks(msgs, ctx, keys, chunk, positions, False, no_small_pieces), keys, False)
    out = x.select(
        *keys,
        F.col("x.idx").alias("target_idx"),
        F.col("x.start_idx").alias("start_idx"),
        F.col("x.line_num").alias("target_line"),
        F.transform("x.w", lambda m: m["text"]).alias("utterances"),
        F.transform("x.w", lambda m: m["label"]).alias("labels"),
    )
    return out.select(
        *keys,
        "target_idx",
        "start_idx",
        "target_line",
        F.array_join("utterances", sep).alias("text"),
        "utterances",
        L.window_coarse("labels").alias("coarse"),
        L.window_multi("labels").alias("multi"),
        L.seq_coarse("labels").alias("seq_coarse"),
        F.col("labels").alias("seq_multi"),
    )


def two_sided_examples(
    msgs: DataFrame,
    ctx: int,
    sep: str = ";",
    keys=CONV_KEYS,
    chunk: int | None = None,
    positions: DataFrame | None = None,
) -> DataFrame:
    """For targets 0..n-1 of every conversation with >= 2 utterances,
    ``text`` = the target, ``context`` = ``start..end`` joined by ``sep``
    (the target included), the budget applied on each side; labels A4/A5.
    ``ctx <= 0`` gives an empty context, as in the reference."""
    x = _windows(member_blocks(msgs, ctx, keys, chunk, positions, True), keys, True)
    members = F.col("x.w") if ctx > 0 else F.filter("x.w", lambda m: F.lit(False))
    out = x.select(
        *keys,
        F.col("x.idx").alias("target_idx"),
        F.col("x.start_idx").alias("start_idx"),
        (F.col("x.end_idx") if ctx > 0 else F.col("x.idx") - 1).alias("end_idx"),
        F.col("x.line_num").alias("target_line"),
        F.col("x.text").alias("text"),
        F.col("x.label").alias("target_label"),
        F.transform(members, lambda m: m["text"]).alias("utterances"),
        F.transform(members, lambda m: m["label"]).alias("labels"),
    )
    return out.select(
        *keys,
        "target_idx",
        "start_idx",
        "end_idx",
        "target_line",
        "text",
        F.array_join("utterances", sep).alias("context"),
        "utterances",
        L.target_coarse("target_label").alias("coarse"),
        F.col("target_label").alias("multi"),
        L.seq_coarse("labels").alias("seq_coarse"),
        F.col("labels").alias("seq_multi"),
    )
