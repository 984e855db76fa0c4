"""The dataset generation job.

``messages -> annotated filter (P1) -> donor split (P2/W8) -> positions ->
windows (W1-W4) -> labels -> noise filter + dedup (P5, W5/W6) -> dev/test
cut (W7)``. Shuffles: the position scan, the join of texts to their ranges,
the window assembly, the dedup, the cut. Building the plan runs jobs: the
scans count their groups (the bounded list of hot ones is collected) and pin
intermediate tables as Parquet. ``generate_splits`` deletes these at its end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from dialogset.operators.conversations import tag_donors
from dialogset.operators.quality import EMOJI_PATTERN, first_occurrence_dedup, last_context_dedup
from dialogset.operators.splits import dev_test_cut
from dialogset.operators.windows import one_sided_examples, two_sided_examples
from dialogset.schema import CONV_KEYS
from dialogset.session import run_folder, scratch_path
from dialogset.sources.messages import quarantine_null_text


@dataclass
class DatasetConfig:
    ctx: int = 256
    sep: str = ";"
    no_small_pieces: bool = True
    noise_ratio: float = 0.2
    two_sided: bool = False
    donors: dict[str, list[int]] = field(default_factory=dict)
    noise_pattern: str = EMOJI_PATTERN
    exact_context_dedup: bool = False


def tagged_messages(msgs: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Annotated messages of the listed donors with their ``split``. Rows
    with NULL text or ``line_num`` cannot be placed in a window; they are
    left out here (``sources.messages.quarantine_null_text`` returns them)."""
    good, _ = quarantine_null_text(msgs)
    return tag_donors(good, cfg.donors)


def examples(msgs: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Examples of all splits before dedup (``split`` is carried as a
    conversation attribute: a donor belongs to one split)."""
    tagged = tagged_messages(msgs, cfg)
    keys = [*CONV_KEYS, "split"]
    if cfg.two_sided:
        return two_sided_examples(tagged, cfg.ctx, cfg.sep, keys=keys)
    return one_sided_examples(tagged, cfg.ctx, cfg.sep, cfg.no_small_pieces, keys=keys)


def build_dataset(msgs: DataFrame, cfg: DatasetConfig) -> tuple[DataFrame, DataFrame | None]:
    """Returns ``(dataset, rejections)``. ``dataset`` has one row per kept
    example with ``split`` (donor split) and ``part`` (train/dev/test);
    ``rejections`` (one-sided only) counts rejected occurrences per text."""
    ex = examples(msgs, cfg)
    if cfg.two_sided:
        kept = last_context_dedup(ex, cfg.noise_ratio, pattern=cfg.noise_pattern, exact=cfg.exact_context_dedup)
        rejections = None
    else:
        kept, rejections = first_occurrence_dedup(ex, cfg.noise_ratio, pattern=cfg.noise_pattern)
    return dev_test_cut(kept), rejections


def generate_splits(msgs: DataFrame, cfg: DatasetConfig, root: str, split_id: str, tag: str) -> DataFrame:
    """W10 + S7 in one call: build the dataset and write it under ``root``
    partitioned by ``split_id / tag / part``. Returns the rejection counts of
    the one-sided build (None for two-sided), written to a table of their own;
    everything else pinned on the way is deleted."""
    from dialogset.sources.splitfiles import write_splits

    spark = msgs.sparkSession
    rejected = scratch_path(spark, "rejections")
    with run_folder(spark):
        dataset, rejections = build_dataset(msgs, cfg)
        write_splits(dataset, root, split_id, tag)
        if rejections is None:
            return None
        rejections.write.parquet(rejected)
    return spark.read.parquet(rejected)
