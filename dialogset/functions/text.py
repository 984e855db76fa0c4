"""Text expressions (H1, H2, H16-H24). All JVM-side.

Generated label strings: labels of one utterance are joined by ``", "``,
utterances by ``"; "``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven chat placeholders that must stay one token.
PLACEHOLDERS = ["<PHOTO>", "<VIDEO>", "<GIFS>", "<DELETED>", "<STICKER>", "<AUDIO_FILES>", "<FILES>"]
TOKEN_PATTERN = "|".join(PLACEHOLDERS) + "|[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"

# Characters that Python's str.strip() removes (str.isspace()).
PY_SPACE = "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"

LABEL_SEP = ", "
UTTERANCE_SEP = "; "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def join_texts(texts, sep: str) -> Column:
    """H1."""
    return F.array_join(_c(texts), sep)


def n_chars(text) -> Column:
    """H2: length in code points."""
    return F.length(_c(text))


def py_strip(s) -> Column:
    """Python ``str.strip()`` (all Unicode white space, both ends)."""
    return F.regexp_replace(_c(s), f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def verbalize_input(text, context) -> Column:
    """``"Utterance: %s\\nContext: %s"``."""
    return F.concat(F.lit("Utterance: "), _c(text), F.lit("\nContext: "), _c(context))


def default_class_names(n: int = 6) -> list[str]:
    return [f"c{i}" for i in range(n)]


def _names_of(vec: Column, names: list[str]) -> Column:
    """Class names of the non-zero positions of an n-hot vector (J6); a set
    position without a name is an error."""
    table = F.array(*[F.lit(n) for n in names])
    missing = lambda i: F.raise_error(F.concat(F.lit("no class name for position "), i.cast("string"))).cast("string")
    marked = F.transform(vec, lambda v, i: F.when(v != 0, F.coalesce(F.get(table, i), missing(i))))
    return F.filter(marked, lambda x: x.isNotNull())


def verbalize_label(label, granularity: str, class_names: list[str] | None = None) -> Column:
    """``positive``/``negative`` for a coarse label; class names joined by
    ``", "`` for a vector; per utterance joined by ``"; "`` for a sequence of
    vectors. Other granularities are an error (raised when planning)."""
    label = _c(label)
    names = class_names or default_class_names()
    if granularity == "seq_coarse":
        return F.when(label != 0, "positive").otherwise("negative")
    if granularity == "seq_multi":
        return F.array_join(_names_of(label, names), LABEL_SEP)
    if granularity == "seq_multi_per_utterance":
        return F.array_join(F.transform(label, lambda u: F.array_join(_names_of(u, names), LABEL_SEP)), UTTERANCE_SEP)
    raise ValueError(granularity)


def first_label(s, strip: bool = True) -> Column:
    """Text before the first comma; stripped for generated strings,
    unstripped for the verbalised truths (as in the reference)."""
    head = F.substring_index(_c(s), ",", 1)
    return py_strip(head) if strip else head


def split_utterances(s) -> Column:
    """Generated or true sequence -> per-utterance strings."""
    return F.split(_c(s), UTTERANCE_SEP, -1)


def is_positive(s, strip: bool = True) -> Column:
    """1 iff the (stripped) string equals ``positive``; NULL -> 0."""
    v = py_strip(s) if strip else _c(s)
    return F.when(v == "positive", 1).otherwise(0)


def tokens(text, pattern: str = TOKEN_PATTERN) -> Column:
    """Placeholders as single tokens, then letter/digit runs, then
    single symbols."""
    return F.regexp_extract_all(_c(text), F.lit(pattern), 0)


def keep_last(tok, n: int) -> Column:
    """The last ``n`` tokens (left truncation)."""
    tok = _c(tok)
    return F.slice(tok, F.greatest(F.size(tok) - n + 1, F.lit(1)), n)


def keep_first(tok, n: int) -> Column:
    """The first ``n`` tokens (right truncation)."""
    return F.slice(_c(tok), 1, n)


def interval_text(name: str, method, lower, upper, mean) -> Column:
    """``"<name> F-scores (<method>) interval: (<lo>; <hi>), mean: <mean>"``
    (fixed value: the line's format)."""
    return F.format_string(
        f"{name} F-scores (%s) interval: (%s; %s), mean: %s", _c(method), _c(lower), _c(upper), _c(mean)
    )


def round4(x) -> Column:
    """Round half up to 4 digits."""
    return F.round(_c(x), 4)
