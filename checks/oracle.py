"""DuckDB oracle SQL for the registered queries.

Each statement recomputes a query's result with plain SQL over the driver
tables (pre-registered as views): window functions with range frames for the
character budgets, self-joins for window assembly, ``row_number`` for dedup
and cuts. These are the straightforward single-node formulations; the Spark
side uses the distributed ones. Column names and types follow the Spark
results; arrays are rendered as ``1,0,0`` / ``1,0|0,1`` strings and doubles
are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from dialogset.operators.quality import EMOJI_PATTERN
from dialogset.plans.registry import CTX, CTX_LONG, NOISE_RATIO, REPEATS, SYMBOL_PATTERN

KEYS = "user_id, thread_id, conv_id"


MARKED = "\U0001F600\u00A9\U0001F1E8\u200D\U0001F44D\U0001F3FD"  # what some letters become, to have emoji in the given texts


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- fixture views

def _labels(order_col: str) -> str:
    m = "length(text) % 8"
    return f"""
       CASE WHEN {m} < 4 THEN 1 ELSE 0 END AS y0,
       CASE WHEN {m} IN (4, 7) THEN 1 ELSE 0 END AS y1,
       CASE WHEN {m} = 5 THEN 1 ELSE 0 END AS y2,
       CASE WHEN {m} IN (6, 7) THEN 1 ELSE 0 END AS y3,
       0 AS y4,
       CASE WHEN {m} = 5 AND {order_col} % 2 = 1 THEN 1 ELSE 0 END AS y5,
       CAST(CASE WHEN {m} < 4 THEN 0 ELSE {m} - 3 END AS INTEGER) AS l1,
       (length(text) + {order_col}) % 9 AS l2,
       conv_id % 5 = 0 AS is_checked_sup"""


FLAG = """CASE WHEN conv_id % 10 = 9 THEN CAST(NULL AS BOOLEAN)
            WHEN conv_id % 10 = 8 THEN FALSE ELSE TRUE END AS is_annotated_tagset_0"""

MX = f"""SELECT 2000 + conv_id % 22 AS user_id, conv_id % 7 AS thread_id, conv_id,
       turn AS line_num, role AS author, text AS line_text, lower(text) AS line_text_en,
       {FLAG}, {_labels("turn")}
  FROM conversations"""

LX = f"""SELECT 2000 + conv_id % 22 AS user_id, conv_id % 7 AS thread_id, conv_id, line_num, author,
       text AS line_text, lower(text) AS line_text_en, {FLAG}, {_labels("line_num")}
  FROM (SELECT doc_id AS conv_id, source AS author, CAST(i - 1 AS BIGINT) AS line_num, parts[i] AS text
          FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
                  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)))"""

SCORED = """SELECT vec_id AS row_id, label AS true_class,
       CASE WHEN label < 3 THEN 1 ELSE 0 END AS y_true,
       CAST(embedding[1] AS DOUBLE) * 8 AS logit0, CAST(embedding[2] AS DOUBLE) * 8 AS logit1,
       CASE WHEN embedding[3] > 0 THEN 1 ELSE 0 END AS y_pred
  FROM embeddings"""

GENERATED = """SELECT vec_id AS row_id,
       CASE WHEN label < 3 THEN 'positive' ELSE 'negative' END AS true_coarse,
       CASE WHEN vec_id % 4 = 0 THEN ' positive' WHEN vec_id % 4 = 1 THEN 'other' ELSE 'negative' END AS pred_coarse,
       concat('c', CAST(label AS VARCHAR), CASE WHEN vec_id % 3 = 0 THEN ', c1' ELSE '' END) AS true_text,
       concat(' c', CAST((label + vec_id) % 11 AS VARCHAR), ', c2') AS pred_text,
       concat('c', CAST(label AS VARCHAR), repeat('; c1', CAST(vec_id % 3 AS INT))) AS true_seq,
       concat('c', CAST((label + vec_id) % 11 AS VARCHAR), repeat('; c2', CAST((vec_id + 1) % 3 AS INT))) AS pred_seq
  FROM embeddings"""

IMBALANCE = """SELECT d.doc_id AS row_id, d.text, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def msgs(src: str = "mx", text: str = "line_text") -> str:
    return f"""SELECT user_id, thread_id, conv_id, line_num, author, {text} AS text,
       [y0, y1, y2, y3, y4, y5] AS label, is_annotated_tagset_0 AS is_annotated
  FROM {src} WHERE is_annotated_tagset_0 IS TRUE"""


SPLIT = "CASE WHEN user_id BETWEEN 2000 AND 2004 THEN 'test' WHEN user_id BETWEEN 2005 AND 2021 THEN 'train' END"

PY_SPACE = "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


def first_label(x: str, strip: bool) -> str:
    head = f"split_part({x}, ',', 1)"
    return py_strip(head) if strip else head


def ints(x: str) -> str:
    return f"array_to_string({x}, ',')"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def with_views(body: str, *views: str) -> str:
    named = {
        "mx": MX, "lx": LX, "scored": SCORED, "generated": GENERATED, "imbalance": IMBALANCE,
    }
    parts = [f"{v} AS ({named[v]})" for v in views]
    if not parts:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body.lstrip()[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------- positions and windows

def positions(src: str) -> str:
    """Per message of ``src``: idx, n_turns, b (chars before), n_chars, pos_before."""
    return f"""SELECT *, row_number() OVER w - 1 AS idx,
       count(*) OVER (PARTITION BY {KEYS}) AS n_turns,
       CAST(coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b,
       length(text) AS n_chars,
       CAST(coalesce(sum(CASE WHEN label[1] = 1 THEN 0 ELSE 1 END)
            OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos_before
  FROM {src} WINDOW w AS (PARTITION BY {KEYS} ORDER BY line_num)"""


def bounds(src: str, ctx: int) -> str:
    if ctx <= 0:
        return f"SELECT *, idx AS start_idx, idx AS end_idx FROM ({positions(src)})"
    return f"""SELECT *,
       coalesce(max(idx) OVER (PARTITION BY {KEYS} ORDER BY b
                RANGE BETWEEN UNBOUNDED PRECEDING AND {ctx} PRECEDING), 0) AS start_idx,
       coalesce(min(idx) OVER (PARTITION BY {KEYS} ORDER BY b + n_chars
                RANGE BETWEEN {ctx} FOLLOWING AND UNBOUNDED FOLLOWING), n_turns - 1) AS end_idx
  FROM ({positions(src)})"""


def _multi(alias: str = "m") -> str:
    cols = ", ".join(f"max(CASE WHEN {alias}.label[{i}] > 0 THEN 1 ELSE 0 END)" for i in range(2, 7))
    return f"""CASE WHEN sum({alias}.label[1]) = count(*) THEN '1,0,0,0,0,0'
            ELSE concat_ws(',', 0, {cols}) END"""


def one_sided(src: str, ctx: int, nsp: bool, extra: str = "") -> str:
    """One row per kept target: keys, target_idx, start_idx, text, labels."""
    ex = f"""SELECT t.user_id, t.thread_id, t.conv_id{extra}, t.idx AS target_idx, t.start_idx,
       any_value(t.pos_before) AS pos_before,
       string_agg(m.text, ';' ORDER BY m.idx) AS text,
       CASE WHEN sum(m.label[1]) = count(*) THEN 0 ELSE 1 END AS coarse,
       {_multi()} AS multi,
       string_agg(CASE WHEN m.label[1] = 1 THEN '0' ELSE '1' END, ',' ORDER BY m.idx) AS seq_coarse,
       string_agg(array_to_string(m.label, ','), '|' ORDER BY m.idx) AS seq_multi
  FROM bnd t JOIN bnd m
    ON m.user_id = t.user_id AND m.thread_id = t.thread_id AND m.conv_id = t.conv_id
   AND m.idx BETWEEN t.start_idx AND t.idx
 WHERE t.idx >= 1 AND t.n_turns >= 2
 GROUP BY t.user_id, t.thread_id, t.conv_id{extra}, t.idx, t.start_idx"""
    body = f"WITH bnd AS ({bounds(src, ctx)}), ex AS ({ex})"
    if nsp and ctx > 0:
        return body + f""",
cut AS (SELECT *, max(CASE WHEN start_idx = 0 AND pos_before = 0 THEN target_idx END)
                  OVER (PARTITION BY {KEYS}) AS cut FROM ex)
SELECT * EXCLUDE (cut, pos_before) FROM cut WHERE target_idx >= coalesce(cut, 1)"""
    return body + "\nSELECT * EXCLUDE (pos_before) FROM ex"


def two_sided(src: str, ctx: int, extra: str = "") -> str:
    members = "m.idx BETWEEN t.start_idx AND t.end_idx" if ctx > 0 else "FALSE"
    return f"""WITH bnd AS ({bounds(src, ctx)})
SELECT t.user_id, t.thread_id, t.conv_id{extra}, t.idx AS target_idx, t.start_idx,
       {"t.end_idx" if ctx > 0 else "t.idx - 1"} AS end_idx, t.text,
       coalesce(string_agg(m.text, ';' ORDER BY m.idx), '') AS context,
       CASE WHEN t.label[1] = 1 THEN 0 ELSE 1 END AS coarse,
       array_to_string(t.label, ',') AS multi,
       coalesce(string_agg(CASE WHEN m.label[1] = 1 THEN '0' ELSE '1' END, ',' ORDER BY m.idx), '') AS seq_coarse,
       coalesce(string_agg(array_to_string(m.label, ','), '|' ORDER BY m.idx), '') AS seq_multi,
       list(m.label ORDER BY m.idx) FILTER (WHERE m.label IS NOT NULL) AS labels,
       t.label AS target_label
  FROM bnd t LEFT JOIN bnd m
    ON m.user_id = t.user_id AND m.thread_id = t.thread_id AND m.conv_id = t.conv_id AND {members}
 WHERE t.n_turns >= 2
 GROUP BY t.user_id, t.thread_id, t.conv_id{extra}, t.idx, t.start_idx, t.end_idx, t.text, t.label"""


def noise(text: str, pattern: str) -> str:
    return (f"(length({text}) > 30 AND len(regexp_extract_all({text}, {_lit(pattern)})) "
            f"> length({text}) * CAST({NOISE_RATIO} AS DOUBLE))")


def tagged(src_view: str, text: str = "line_text") -> str:
    return f"SELECT *, {SPLIT} AS split FROM ({msgs(src_view, text)}) WHERE {SPLIT} IS NOT NULL"


def dedup_first(ex_sql: str, pattern: str) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY split, text
                               ORDER BY user_id, thread_id, conv_id, target_idx DESC) AS rn
    FROM ({ex_sql}) WHERE NOT {noise("text", pattern)}) WHERE rn = 1"""


def dedup_last_context(ex_sql: str, pattern: str) -> str:
    return f"""SELECT * EXCLUDE (prev) FROM (
  SELECT *, lag(context) OVER (PARTITION BY split, text
                               ORDER BY user_id, thread_id, conv_id, target_idx DESC) AS prev
    FROM ({ex_sql}) WHERE NOT {noise("text || context", pattern)})
 WHERE prev IS NULL OR prev <> context"""


def cut(kept_sql: str) -> str:
    return f"""SELECT *, CASE WHEN split = 'test' AND
         row_number() OVER (PARTITION BY split ORDER BY user_id, thread_id, conv_id, target_idx DESC) - 1
           < count(*) OVER (PARTITION BY split) // 4 THEN 'dev' ELSE split END AS part
  FROM ({kept_sql})"""


def dataset(src_view: str, ctx: int, two: bool, pattern: str, text: str = "line_text") -> str:
    src = f"({tagged(src_view, text)})"
    if two:
        return cut(dedup_last_context(two_sided(src, ctx, ", t.split"), pattern))
    return cut(dedup_first(one_sided(src, ctx, True, ", t.split"), pattern))


# ---------------------------------------------------------------- metric helpers

def class_counts(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""SELECT {g}label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
       CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(support) AS BIGINT) AS support FROM (
  SELECT {g}"true" AS label, CASE WHEN "true" = pred THEN 1 ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN "true" = pred THEN 0 ELSE 1 END AS fn, 1 AS support FROM ({src})
  UNION ALL
  SELECT {g}pred AS label, 0, CASE WHEN "true" = pred THEN 0 ELSE 1 END, 0, 0 FROM ({src}))
 GROUP BY {g}label"""


def f1(tp: str, fp: str, fn: str) -> str:
    return f"coalesce(CAST(2 * ({tp}) AS DOUBLE) / nullif(2 * ({tp}) + ({fp}) + ({fn}), 0), 0.0)"


def f1_averages(counts: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""WITH per AS (SELECT *, {f1("tp", "fp", "fn")} AS f1 FROM ({counts})),
agg AS (SELECT {g}{f1("sum(tp)", "sum(fp)", "sum(fn)")} AS micro, avg(f1) AS macro,
               coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0) AS weighted FROM per {gb})
SELECT {g}'weighted' AS average, weighted AS f1 FROM agg
UNION ALL SELECT {g}'micro', micro FROM agg
UNION ALL SELECT {g}'macro', macro FROM agg"""


def multilabel_counts(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""SELECT {g}label, CAST(sum(CASE WHEN t = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(sum(CASE WHEN t = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN t = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN t = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) AS BIGINT) AS support
  FROM (SELECT {g}CAST(i - 1 AS INTEGER) AS label, "true"[i] AS t, pred[i] AS p
          FROM (SELECT *, unnest(range(1, len("true") + 1)) AS i FROM ({src})))
 GROUP BY {g}label"""


VECTORS = """SELECT row_id,
       [y_true, CASE WHEN true_class % 2 = 1 THEN 1 ELSE 0 END, CASE WHEN true_class >= 7 THEN 1 ELSE 0 END] AS "true",
       [y_pred, CASE WHEN logit0 > 0 THEN 1 ELSE 0 END, CASE WHEN logit1 > 0 THEN 1 ELSE 0 END] AS pred
  FROM scored"""

PRED_CLASS = "CAST(CAST(floor(abs(logit0) * 10) AS BIGINT) % 10 AS INTEGER)"
SOFTMAX1 = "exp(logit1 - greatest(logit0, logit1)) / (exp(logit0 - greatest(logit0, logit1)) + exp(logit1 - greatest(logit0, logit1)))"
SOFTMAX0 = "exp(logit0 - greatest(logit0, logit1)) / (exp(logit0 - greatest(logit0, logit1)) + exp(logit1 - greatest(logit0, logit1)))"


def binary_counts(src: str) -> str:
    return f"""SELECT CAST(sum(CASE WHEN "true" = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN "true" <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN "true" = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN "true" <> 1 AND pred <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM ({src})"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


def subsample(src: str, repeats: int, k: str, multilabel: bool = False, pooled: bool = False, seed: int = 0) -> str:
    """A17 rows mode: per repeat the k rows with the smallest md5(seed:repeat:row_id)."""
    picked = f"""SELECT * FROM (
  SELECT r.repeat, s.*, row_number() OVER (PARTITION BY r.repeat ORDER BY
           md5(concat_ws(':', '{seed}', CAST(r.repeat AS VARCHAR), CAST(s.row_id AS VARCHAR))), s.row_id) - 1 AS pos
    FROM ({src}) s, (SELECT CAST(range AS BIGINT) AS repeat FROM range({repeats})) r)
 WHERE pos < ({k})"""
    return intervals(picked, multilabel, pooled)


def hypergeometric(n: str, w: str, k: str, u: str) -> str:
    """Quantile ``u`` of how many of ``w`` among ``n`` are in a draw of ``k``."""
    low, high = f"greatest(0, {k} - ({n} - {w}))", f"least({w}, {k})"
    lg = lambda x: f"lgamma(CAST({x} AS DOUBLE) + 1.0)"
    ways = lambda a, b: f"{lg(a)} - {lg(b)} - {lg(f'({a}) - ({b})')}"
    p = f"[exp({ways(w, 'j')} + {ways(f'({n} - {w})', f'({k} - j)')} - ({ways(n, k)})) FOR j IN range({low}, {high} + 1)]"
    return f"least({high}, {low} + len([m FOR m IN range(1, {high} - {low} + 2) IF list_sum(({p})[1:m]) <= {u}]))"


def cell_draws(src: str, repeats: int, k: str, arrays: bool, seed: int = 0) -> str:
    """A17 cells mode: repeat, true, pred, drawn. The sample is split over the
    cells' hash blocks, and each share over the block's cells."""
    key = lambda c: f"array_to_string({c}, ',')" if arrays else f"CAST({c} AS VARCHAR)"
    u = lambda name: (
        f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', CAST(d.r AS VARCHAR), {name})), 1, 13)) AS BIGINT) / 4503599627370496.0"
    )
    return f"""WITH RECURSIVE cell AS (
  SELECT "true", pred, count(*) AS w, md5(concat_ws('|', coalesce({key('"true"')}, ''), coalesce({key('pred')}, ''))) AS h
    FROM ({src}) GROUP BY "true", pred),
c AS (SELECT *, substr(h, 1, 2) AS b, row_number() OVER (PARTITION BY substr(h, 1, 2) ORDER BY h) AS i FROM cell),
blk AS (SELECT b, CAST(sum(w) AS BIGINT) AS w, row_number() OVER (ORDER BY b) AS i FROM c GROUP BY b),
d1 AS (
  SELECT CAST(t.range AS BIGINT) AS r, CAST(0 AS BIGINT) AS i, n.n AS n, least(n.n, ({k})) AS k, CAST(0 AS BIGINT) AS x
    FROM range({repeats}) t, (SELECT CAST(sum(w) AS BIGINT) AS n FROM blk) n
  UNION ALL
  SELECT r, i, n - w, k - x, x FROM (
    SELECT d.r, blk.i, d.n, d.k, blk.w, CAST({hypergeometric('d.n', 'blk.w', 'd.k', u('blk.b'))} AS BIGINT) AS x
      FROM d1 d JOIN blk ON blk.i = d.i + 1)),
d2 AS (
  SELECT d.r, blk.b, CAST(0 AS BIGINT) AS i, blk.w AS n, d.x AS k, CAST(0 AS BIGINT) AS x FROM d1 d JOIN blk ON blk.i = d.i
  UNION ALL
  SELECT r, b, i, n - w, k - x, x FROM (
    SELECT d.r, d.b, c.i, d.n, d.k, c.w, CAST({hypergeometric('d.n', 'c.w', 'd.k', u('c.h'))} AS BIGINT) AS x
      FROM d2 d JOIN c ON c.b = d.b AND c.i = d.i + 1))
SELECT d2.r AS repeat, c."true", c.pred, d2.x AS drawn FROM d2 JOIN c ON c.b = d2.b AND c.i = d2.i WHERE d2.x > 0"""


def subsample_cells(src: str, repeats: int, k: str, multilabel: bool = False, pooled: bool = False, seed: int = 0) -> str:
    """A17 cells mode: intervals of the F1 of drawn cell counts."""
    drawn = cell_draws(src, repeats, k, multilabel, seed)
    return intervals('SELECT repeat, "true", pred, unnest(range(drawn)) AS one FROM draws', multilabel, pooled, f"draws AS MATERIALIZED ({drawn})")


def intervals(picked: str, multilabel: bool, pooled: bool, view: str = "") -> str:
    counts = multilabel_counts(picked, "repeat") if multilabel else class_counts(picked, "repeat")
    per = f1_averages(counts, "repeat")
    if pooled:
        per = f"""SELECT repeat, a.average, f1 FROM ({per}) p JOIN
  (SELECT * FROM (VALUES ('weighted', 0), ('micro', 1), ('macro', 2)) v(average, rk)) a
  ON a.rk >= CASE p.average WHEN 'weighted' THEN 0 WHEN 'micro' THEN 1 ELSE 2 END"""
    return f"""{f'WITH {view} ' if view else ''}SELECT average, {r6("q[1]")} AS lower, {r6("q[2]")} AS upper, {r6("m")} AS mean FROM (
  SELECT average, quantile_cont(f1, [0.025, 0.975]) AS q, avg(f1) AS m FROM ({per}) GROUP BY average)"""


def auc_scores(src: str) -> str:
    """Pair-counting ROC AUC with half credit for ties (midrank form)."""
    return f"""WITH g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM ({src}) GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN NULL
            ELSE CAST(sum(pos * (nb + neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc FROM c"""


def hard_auc(tp: str, fp: str, fn: str, tn: str) -> str:
    return f"((CAST({tp} AS DOUBLE) / nullif({tp} + {fn}, 0)) + (CAST({tn} AS DOUBLE) / nullif({tn} + {fp}, 0))) / 2.0"


def confusion(src: str) -> str:
    return f"""WITH l AS (SELECT DISTINCT v FROM (SELECT "true" AS v FROM ({src}) UNION ALL SELECT pred FROM ({src}))),
c AS (SELECT "true", pred, count(*) AS n FROM ({src}) GROUP BY ALL)
SELECT a.v AS "true", b.v AS pred, coalesce(c.n, 0) AS count
  FROM l a CROSS JOIN l b LEFT JOIN c ON c."true" = a.v AND c.pred = b.v"""


def names_of(vec: str) -> str:
    return (f"array_to_string(list_filter(list_transform(range(1, len({vec}) + 1), "
            f"lambda i: CASE WHEN {vec}[i] <> 0 THEN 'c' || CAST(i - 1 AS VARCHAR) END), lambda x: x IS NOT NULL), ', ')")


def label_ids(vocab: str) -> str:
    return f"SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM ({vocab}) WHERE label IS NOT NULL)"


def pieces(batch: int = 32) -> str:
    """H18/H19 pieces of generated sequences: preds cut at the first comma and stripped first."""
    pred = first_label("pred_seq", True)
    return f"""preds AS (SELECT row_id // {batch} AS batch_id, row_id, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS piece
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT row_id, string_split({pred}, '; ') AS parts FROM generated))),
trues AS (SELECT row_id // {batch} AS batch_id, row_id, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS piece
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT row_id, string_split(true_seq, '; ') AS parts FROM generated)))"""


ALIGN_BATCH = """SELECT t.batch_id, t.row_id, t.pos, p.piece AS pred, t.piece AS "true"
  FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY row_id, pos) AS k FROM trues) t
  JOIN (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY row_id, pos) AS k FROM preds) p
    ON t.batch_id = p.batch_id AND t.k = p.k"""

ALIGN_UTT = """SELECT t.batch_id, t.row_id, t.pos, p.piece AS pred, t.piece AS "true"
  FROM trues t JOIN preds p ON t.row_id = p.row_id AND t.pos = p.pos"""


def tokens(x: str) -> str:
    from dialogset.functions.text import TOKEN_PATTERN

    return f"regexp_extract_all({x}, {_lit(TOKEN_PATTERN)})"


# ---------------------------------------------------------------- statements

def _src(view: str, text: str = "line_text") -> str:
    return f"({msgs(view, text)})"


def _sel(cols: str, inner: str, *views: str, where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return with_views(f"SELECT {cols} FROM ({inner}){w}", *views)


W4A_COLS = f"{KEYS}, target_idx, start_idx, text, coarse, multi, seq_coarse, seq_multi"
W4B_COLS = f"{KEYS}, target_idx, start_idx, end_idx, text, context, coarse, multi, seq_coarse, seq_multi"

Y = "[y0, y1, y2, y3, y4, y5]"
ACTIVE = f"list_filter(range(0, 6), lambda i: {Y}[i + 1] = 1)"
C1 = "CASE WHEN l1 >= 6 THEN 0 ELSE l1 END"
C2 = "CASE WHEN l2 >= 6 THEN 0 ELSE l2 END"
TWO_ANN = f"""CASE WHEN {C1} = 0 AND {C2} = 0 THEN [0] WHEN {C1} = {C2} THEN [CAST({C1} AS BIGINT)]
                   ELSE [CAST({C1} AS BIGINT), {C2}] END"""
GOLD = f"list_filter(list_concat({ACTIVE}, [l2]), lambda g: g < 6)"
MERGED = f"""CASE WHEN len({GOLD}) > 0 THEN {GOLD}
                  WHEN is_checked_sup THEN [0]
                  WHEN {C1} = 0 AND {C2} = 0 THEN [0]
                  WHEN {C1} = {C2} THEN [CAST({C1} AS BIGINT)]
                  ELSE list_filter([CAST({C1} AS BIGINT), {C2}], lambda v: v > 0) END"""

SIG = "1.0 / (1.0 + exp(-({x})))"
L3 = ["logit0", "logit1", "logit0 + logit1"]

SCORED_PROBS = f"SELECT *, {SOFTMAX0} AS p0, {SOFTMAX1} AS p1 FROM scored"
K4_INPUT = f"""SELECT row_id, y_true AS "true", CASE WHEN p0 >= 0.5 THEN 0 WHEN p1 >= 0.5 THEN 1 ELSE 0 END AS pred,
       CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS argmax, p1 AS score FROM ({SCORED_PROBS})"""

SAMPLE_K = "SELECT CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) FROM ({src})"


def _ci_rows(src: str, repeats: int, multilabel: bool = False, prefix: str = "", k: str | None = None) -> str:
    k = k or SAMPLE_K.format(src=src)
    ci = subsample_cells(src, repeats, k, multilabel)
    return " UNION ALL ".join(
        f"SELECT '{prefix}ci_{p}' AS metric, average AS label, {p} AS value FROM ({ci})" for p in ("lower", "upper", "mean")
    )


def _k4_rows() -> str:
    src = f"SELECT * FROM ({K4_INPUT})"
    bc = binary_counts(src)
    f1v = f"SELECT 'test_f1' AS metric, CAST(NULL AS VARCHAR) AS label, round({f1('tp', 'fp', 'fn')}, 4) AS value FROM ({bc})"
    cfm = confusion(f'SELECT "true", argmax AS pred FROM ({src})')
    cfm_rows = f"SELECT 'cfm' AS metric, concat_ws(',', \"true\", pred) AS label, CAST(count AS DOUBLE) AS value FROM ({cfm})"
    auc = auc_scores(f'SELECT "true" AS y, score FROM ({src})')
    auc_rows = f"SELECT 'auc' AS metric, CAST(NULL AS VARCHAR) AS label, auc AS value FROM ({auc})"
    ci = _ci_rows(f'SELECT row_id, "true", pred FROM ({src})', REPEATS)
    return f"{f1v} UNION ALL {cfm_rows} UNION ALL {auc_rows} UNION ALL {ci}"


def _k5_rows() -> str:
    probs = "[" + ", ".join(SIG.format(x=x) for x in ["logit0", "logit1", "logit0 - logit1"]) + "]"
    p = f"""SELECT v.row_id, v."true", list_transform({probs}, lambda q: CASE WHEN q >= 0.5 THEN 1 ELSE 0 END) AS pred,
       s.y_true AS coarse_true FROM ({VECTORS}) v JOIN scored s ON v.row_id = s.row_id"""
    mlc = multilabel_counts(p)
    f1s = f1_averages(f"SELECT label, tp, fp, fn, support FROM ({mlc})")
    f1_rows = f"SELECT concat('multi_f1_', average) AS metric, CAST(NULL AS VARCHAR) AS label, round(f1, 4) AS value FROM ({f1s})"
    auc = f"""SELECT 'auc' AS metric, 'm2m' AS label,
       sum(CASE WHEN support > 0 THEN {hard_auc('tp', 'fp', 'fn', 'tn')} * support END)
         / sum(CASE WHEN support > 0 THEN support END) AS value FROM ({mlc})"""
    ci = _ci_rows(f'SELECT row_id, "true", pred FROM ({p})', 50, multilabel=True)
    mcm = " UNION ALL ".join(
        f"SELECT 'mcm' AS metric, concat_ws(',', CAST(label AS VARCHAR), '{c}') AS label, CAST({c} AS DOUBLE) AS value FROM ({mlc})"
        for c in ("tn", "fp", "fn", "tp")
    )
    c = f"""SELECT row_id, coarse_true AS "true", CASE WHEN pred[2] = 1 OR pred[3] = 1 THEN 1 ELSE 0 END AS pred FROM ({p})"""
    bc = binary_counts(c)
    c_f1 = f"SELECT 'm2c_test_f1' AS metric, CAST(NULL AS VARCHAR) AS label, round({f1('tp', 'fp', 'fn')}, 4) AS value FROM ({bc})"
    c_auc = f"SELECT 'auc' AS metric, 'm2c' AS label, {hard_auc('tp', 'fp', 'fn', 'tn')} AS value FROM ({bc})"
    c_ci = _ci_rows(c, 50, prefix="m2c_")
    cfm = f"SELECT 'm2c_cfm' AS metric, concat_ws(',', \"true\", pred) AS label, CAST(count AS DOUBLE) AS value FROM ({confusion(c)})"
    return " UNION ALL ".join([f1_rows, auc, ci, mcm, c_f1, c_auc, c_ci, cfm])


def _fine_ids() -> str:
    t = first_label("true_text", False)
    p = first_label("pred_text", True)
    vocab = f"SELECT {t} AS label FROM generated UNION ALL SELECT {p} FROM generated"
    return f"""WITH ids AS ({label_ids(vocab)})
SELECT g.row_id, ti.label_id AS true_id, pi.label_id AS pred_id FROM generated g
  JOIN ids ti ON ti.label = {first_label("g.true_text", False)}
  JOIN ids pi ON pi.label = {first_label("g.pred_text", True)}"""


def _utt_ids(align: str = ALIGN_BATCH) -> str:
    return f"""WITH {pieces()}, al AS ({align}),
ids AS ({label_ids(f'SELECT {first_label(chr(34) + "true" + chr(34), False)} AS label FROM al')})
SELECT al.row_id, al.pos, ti.label_id AS true_id, coalesce(pi.label_id, 0) AS pred_id FROM al
  JOIN ids ti ON ti.label = {first_label('al."true"', False)}
  LEFT JOIN ids pi ON pi.label = al.pred"""


def _k6_rows(pairs: str, k: str | None = None) -> str:
    src = f'SELECT row_id, true_id AS "true", pred_id AS pred FROM ({pairs})'
    f1s = f1_averages(class_counts(src))
    return f"SELECT 'f1' AS metric, average AS label, f1 AS value FROM ({f1s}) UNION ALL " + _ci_rows(src, REPEATS, k=k)


K6_COARSE = f"""SELECT row_id, CASE WHEN true_coarse = 'positive' THEN 1 ELSE 0 END AS true_id,
       CASE WHEN {py_strip('pred_coarse')} = 'positive' THEN 1 ELSE 0 END AS pred_id FROM generated"""


def _report(rows: str, *views: str, prefix_cols: str = "") -> str:
    return with_views(f"SELECT {prefix_cols}metric, label, {r6('value')} AS value FROM ({rows})", *views)


def _bleu() -> str:
    def toks(x):
        return f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> '')"

    def grams(col):
        return f"""SELECT row_id, n, array_to_string({col}[i : i + n - 1], chr(1)) AS gram
  FROM (SELECT row_id, {col}, n, unnest(range(1, len({col}) - n + 2)) AS i
          FROM toks, (SELECT unnest([1, 2, 3, 4]) AS n) ns WHERE len({col}) >= n)"""

    return f"""WITH pairs AS (SELECT concat_ws(':', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS row_id,
                      text AS reference, replace(text, 'e', 'a') AS hypothesis FROM conversations),
toks AS (SELECT row_id, {toks('reference')} AS rt, {toks('hypothesis')} AS ht FROM pairs),
hc AS (SELECT row_id, n, gram, count(*) AS hc FROM ({grams('ht')}) GROUP BY ALL),
rc AS (SELECT row_id, n, gram, count(*) AS rc FROM ({grams('rt')}) GROUP BY ALL),
cl AS (SELECT hc.n, sum(least(hc.hc, coalesce(rc.rc, 0))) AS match, sum(hc.hc) AS total
         FROM hc LEFT JOIN rc ON hc.row_id = rc.row_id AND hc.n = rc.n AND hc.gram = rc.gram GROUP BY hc.n),
le AS (SELECT sum(len(rt)) AS r_len, sum(len(ht)) AS h_len FROM toks),
pr AS (SELECT count(CASE WHEN match > 0 THEN 1 END) AS n_pos,
              sum(CASE WHEN match > 0 THEN ln(CAST(match AS DOUBLE) / total) END) AS log_p FROM cl)
SELECT {r6('''CASE WHEN n_pos < 4 OR h_len = 0 THEN 0.0
            ELSE (CASE WHEN h_len >= r_len THEN 1.0 ELSE exp(1.0 - CAST(r_len AS DOUBLE) / h_len) END) * exp(log_p / 4) END''')} AS bleu
  FROM pr, le"""


def statements() -> dict[str, str]:
    mx, lx = _src("mx"), _src("lx")
    one = one_sided(mx, CTX, False)
    two = two_sided(mx, CTX)
    lines_one_tagged = one_sided(f"({tagged('lx')})", CTX, True, ", t.split")
    lines_two_tagged = two_sided(f"({tagged('lx')})", CTX, ", t.split")
    w5 = dedup_first(lines_one_tagged, SYMBOL_PATTERN)
    ds1 = dataset("mx", CTX, False, EMOJI_PATTERN)
    ds2 = dataset("mx", CTX, True, EMOJI_PATTERN)
    sq = {}

    # sources
    sq["s1_load_messages"] = _sel(f"{KEYS}, line_num, author, text, {ints('label')} AS label, is_annotated", msgs("mx"), "mx")
    sq["s2_english_text"] = _sel(f"{KEYS}, line_num, text", msgs("mx", "line_text_en"), "mx")
    sq["s3_read_split"] = _sel("text, coarse AS label", ds1, "mx", where="part = 'test'")
    v_seq = f"array_to_string(list_transform(labels, lambda l: {names_of('l')}), '; ')"
    sq["s5_read_two_sided"] = _sel(f"text, context, {v_seq} AS label", ds2, "mx", where="part = 'dev'")
    sq["s7_write_splits"] = with_views(
        f"SELECT '1' AS split_id, 'ctx256' AS tag, part, count(*) AS n, CAST(sum(coarse) AS BIGINT) AS n_positive "
        f"FROM ({ds1}) GROUP BY part", "mx")
    sq["s6_legacy_import"] = _sel("thread_id, conv_id, text, coarse, multi, seq_coarse, seq_multi", one, "mx")
    sq["a19_granularity_counts"] = _sel(", ".join(
        f"CAST(count(*) AS BIGINT) AS n_{g}" for g in ("coarse", "multi", "seq_coarse", "seq_multi")), one, "mx")
    sq["s8_run_configs"] = with_views(f"""SELECT CAST(row_id AS VARCHAR) AS run_id, concat('fx', true_class) AS tag,
       concat('0,', true_class) AS target_names, CAST(true_class + 1 AS INTEGER) AS epochs,
       {r6("logit0 / 8")} AS learning_rate, CAST(NULL AS VARCHAR) AS model_name FROM scored""", "scored")
    sq["s9_metrics_sink"] = _report(_k4_rows(), "scored", prefix_cols="'run-1' AS run_id, '1' AS split_id, 'fx' AS tag, ")

    # filters
    sq["p1_annotated"] = with_views(f"SELECT {KEYS}, line_num FROM mx WHERE is_annotated_tagset_0 IS TRUE", "mx")
    sq["p2_donor_split"] = _sel(f"{KEYS}, line_num, split", tagged("mx"), "mx")
    sq["p4_min_turns"] = _sel(f"{KEYS}, count(*) AS n_turns", msgs("lx"), "lx") + f" GROUP BY {KEYS} HAVING count(*) >= 2"
    sq["p5_noise_filter"] = _sel(
        f"{KEYS}, line_num, CAST(len(regexp_extract_all(text, {_lit(SYMBOL_PATTERN)})) AS INTEGER) AS n_symbols, "
        f"{noise('text', SYMBOL_PATTERN)} AS is_noise", msgs("lx"), "lx")
    sq["p6_gold_filter"] = with_views(f"SELECT conv_id, line_num, array_to_string({GOLD}, ',') AS gold FROM mx", "mx")

    # aggregations
    sq["a1_conversations"] = with_views(f"""SELECT {KEYS}, CAST(idx // 10000 AS BIGINT) AS part_no, n_turns,
       string_agg(CAST(line_num AS VARCHAR), ',' ORDER BY idx) AS line_nums,
       md5(string_agg(text, chr(1) ORDER BY idx)) AS texts_md5,
       string_agg(array_to_string(label, ','), '|' ORDER BY idx) AS labels,
       string_agg(author, ',' ORDER BY idx) AS authors
  FROM ({positions(mx)}) GROUP BY {KEYS}, part_no, n_turns""", "mx")
    sq["a2_window_coarse"] = _sel(f"{KEYS}, target_idx, coarse", one, "mx")
    sq["a3_window_multi"] = _sel(f"{KEYS}, target_idx, multi", one, "mx")
    sq["a4_seq_labels"] = _sel(f"{KEYS}, target_idx, seq_coarse, seq_multi", one, "mx")
    sq["a5_two_sided_labels"] = _sel(f"{KEYS}, target_idx, coarse, multi", two, "mx")
    nz = noise("text", SYMBOL_PATTERN)
    sq["a6_rejections"] = with_views(f"""SELECT split, text, n_duplicate, n_noise, n_duplicate + n_noise AS n_rejected FROM (
  SELECT split, text, CAST(greatest(sum(CASE WHEN nz THEN 0 ELSE 1 END) - 1, 0) AS BIGINT) AS n_duplicate,
         CAST(sum(CASE WHEN nz THEN 1 ELSE 0 END) AS BIGINT) AS n_noise
    FROM (SELECT *, {nz} AS nz FROM ({lines_one_tagged})) GROUP BY split, text)
 WHERE n_duplicate + n_noise > 0""", "lx")
    sq["a7_class_ratio"] = with_views(
        f"SELECT {r6('1.0 - pos')} AS neg, {r6('pos')} AS pos FROM (SELECT CAST(sum(label) AS DOUBLE) / count(*) AS pos FROM imbalance)",
        "imbalance")
    sq["a8_confusion_matrix"] = with_views(confusion(f'SELECT true_class AS "true", {PRED_CLASS} AS pred FROM scored'), "scored")
    sq["a9_multilabel_confusion"] = with_views(f"SELECT label, tn, fp, fn, tp FROM ({multilabel_counts(VECTORS)})", "scored")
    bc = binary_counts('SELECT y_true AS "true", y_pred AS pred FROM scored')
    sq["a10_binary_metrics"] = with_views(f"""SELECT {r6(ratio('tp + tn', 'tp + fp + fn + tn'))} AS accuracy,
       {r6(ratio('tp', 'tp + fp'))} AS precision, {r6(ratio('tp', 'tp + fn'))} AS recall, {r6(f1('tp', 'fp', 'fn'))} AS f1
  FROM ({bc})""", "scored")
    mc_src = f'SELECT row_id, true_class AS "true", {PRED_CLASS} AS pred FROM scored'
    sq["a11_f1_multiclass"] = with_views(f"SELECT average, {r6('f1')} AS f1 FROM ({f1_averages(class_counts(mc_src))})", "scored")
    mlc = f"SELECT label, tp, fp, fn, support FROM ({multilabel_counts(VECTORS)})"
    sq["a12_f1_multilabel"] = with_views(f"SELECT average, {r6('f1')} AS f1 FROM ({f1_averages(mlc)})", "scored")
    sq["a13_subset_accuracy"] = with_views(
        f"SELECT {r6('avg(CASE WHEN \"true\" = pred THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM ({VECTORS})", "scored")
    sq["a14_roc_auc"] = with_views(f"SELECT {r6('auc')} AS auc FROM ({auc_scores(f'SELECT y_true AS y, {SOFTMAX1} AS score FROM scored')})", "scored")
    mlc_all = multilabel_counts(VECTORS)
    sq["a15_roc_auc_hard"] = with_views(f"""SELECT {r6(hard_auc('tp', 'fp', 'fn', 'tn'))} AS binary,
       (SELECT {r6(hard_auc('sum(tp)', 'sum(fp)', 'sum(fn)', 'sum(tn)'))} FROM ({mlc_all})) AS micro,
       (SELECT {r6(f"sum(CASE WHEN support > 0 THEN {hard_auc('tp', 'fp', 'fn', 'tn')} * support END) / sum(CASE WHEN support > 0 THEN support END)")}
          FROM ({mlc_all})) AS weighted
  FROM ({bc})""", "scored")
    sq["a16_mean_quantiles"] = with_views(f"""SELECT true_class, {r6('q[1]')} AS lower, {r6('q[2]')} AS upper, {r6('m')} AS mean
  FROM (SELECT true_class, quantile_cont(logit0, [0.025, 0.975]) AS q, avg(logit0) AS m FROM scored GROUP BY true_class)""", "scored")
    sq["a17_subsample_ci_rows"] = with_views(subsample(mc_src, REPEATS, SAMPLE_K.format(src=mc_src)), "scored")
    sq["a17_subsample_ci"] = with_views(subsample_cells(mc_src, REPEATS, SAMPLE_K.format(src=mc_src)), "scored")
    sq["a17_subsample_ci_cells"] = sq["a17_subsample_ci"]
    bin_src = 'SELECT row_id, y_true AS "true", y_pred AS pred FROM scored'
    sq["a17_subsample_ci_pooled"] = with_views(subsample_cells(bin_src, REPEATS, SAMPLE_K.format(src=bin_src), pooled=True), "scored")
    sq["a17_subsample_ci_multilabel"] = with_views(subsample_cells(VECTORS, REPEATS, SAMPLE_K.format(src=VECTORS), multilabel=True), "scored")
    enc = """SELECT CASE WHEN code = 1 THEN 1 WHEN code >= 10 THEN code % 10 ELSE 0 END AS "true",
       CASE WHEN code >= 10 THEN 1 ELSE 0 END AS pred FROM (SELECT y_true + 10 * y_pred AS code FROM scored)"""
    sq["a18_encoded_f1"] = with_views(f"SELECT {r6(f1('tp', 'fp', 'fn'))} AS f1 FROM ({binary_counts(enc)})", "scored")
    sq["a21_bleu"] = _bleu()

    # windows
    sq["w1_backward_context"] = _sel(f"{KEYS}, idx, start_idx", bounds(mx, CTX), "mx")
    sq["w1_backward_context_lines"] = _sel(f"{KEYS}, idx, start_idx", bounds(lx, CTX), "lx")
    sq["w2_forward_context"] = _sel(f"{KEYS}, idx, end_idx", bounds(mx, CTX), "mx")
    sq["w2_forward_context_lines"] = _sel(f"{KEYS}, idx, end_idx", bounds(lx, CTX), "lx")
    sq["w3_no_small_pieces"] = _sel(f"{KEYS}, target_idx, start_idx", one_sided(mx, CTX, True), "mx")
    sq["w3_no_small_pieces_lines"] = _sel(f"{KEYS}, target_idx, start_idx", one_sided(lx, CTX, True), "lx")
    sq["w4a_one_sided"] = _sel(W4A_COLS, one, "mx")
    sq["w4a_one_sided_1000"] = _sel(W4A_COLS, one_sided(mx, CTX_LONG, False), "mx")
    sq["w4a_one_sided_lines"] = _sel(W4A_COLS, one_sided(lx, CTX, False), "lx")
    sq["w4a_one_sided_bucketed"] = sq["w4a_one_sided_lines"]
    sq["a1_conversations_bucketed"] = sq["a1_conversations"]
    sq["w4b_two_sided"] = _sel(W4B_COLS, two, "mx")
    sq["w4b_two_sided_1000"] = _sel(W4B_COLS, two_sided(mx, CTX_LONG), "mx")
    sq["w4b_two_sided_lines"] = _sel(W4B_COLS, two_sided(lx, CTX), "lx")
    sq["w5_first_dedup"] = _sel(f"split, {KEYS}, target_idx, text", w5, "lx")
    sq["w6_last_context_dedup"] = _sel(f"split, {KEYS}, target_idx, text", dedup_last_context(lines_two_tagged, SYMBOL_PATTERN), "lx")
    sq["w6_exact_pair_dedup"] = _sel(f"split, {KEYS}, target_idx, text", f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY split, text, context
                               ORDER BY user_id, thread_id, conv_id, target_idx DESC) AS rn
    FROM ({lines_two_tagged}) WHERE NOT {noise("text || context", SYMBOL_PATTERN)}) WHERE rn = 1""", "lx")
    sq["w7_dev_test_cut"] = _sel(f"split, part, {KEYS}, target_idx", cut(w5), "lx")
    sq["w9_batches"] = with_views(
        "SELECT vec_id, row_id, row_id // 32 AS batch_id FROM (SELECT row_id AS vec_id, row_number() OVER (ORDER BY row_id) - 1 AS row_id FROM scored)",
        "scored")
    sq["w10_build_dataset"] = _sel(f"split, part, {KEYS}, target_idx, start_idx, text, coarse, multi, seq_coarse, seq_multi", ds1, "mx")
    sq["w10_build_dataset_two_sided"] = _sel(
        f"split, part, {KEYS}, target_idx, start_idx, end_idx, text, context, coarse, multi, seq_coarse, seq_multi",
        dataset("mx", CTX_LONG, True, EMOJI_PATTERN), "mx")

    # sorts, limits, sampling
    vocab = f"SELECT {first_label('true_text', False)} AS label FROM generated UNION ALL SELECT {first_label('pred_text', True)} FROM generated"
    sq["f2_label_ids"] = with_views(label_ids(vocab), "generated")
    sq["f3_prefix_limit"] = with_views("SELECT row_id, true_text, pred_text FROM generated ORDER BY row_id LIMIT 200", "generated")
    over = """WITH st AS (SELECT CAST(sum(label) AS DOUBLE) / count(*) AS pos FROM imbalance),
pl AS (SELECT CASE WHEN pos < 1.0 - pos THEN 1 ELSE 0 END AS minority_label,
              CASE WHEN least(pos, 1.0 - pos) * 2 <= greatest(pos, 1.0 - pos) AND least(pos, 1.0 - pos) > 0
                   THEN CAST(trunc(1.0 / least(pos, 1.0 - pos) - 1.0) AS INTEGER) ELSE 0 END AS extra FROM st)
SELECT row_id, label, CAST(unnest(range(0, CASE WHEN label = minority_label THEN extra ELSE 0 END + 1)) AS INTEGER) AS copy_no
  FROM imbalance, pl"""
    sq["f4_oversample"] = with_views(f"SELECT * FROM ({over})", "imbalance")
    sq["k2_training_rows"] = with_views(f"""SELECT row_id, label, copy_no, {r6("CASE WHEN label = 0 THEN 1.0 - pos ELSE pos END")} AS weight
  FROM ({over}), (SELECT CAST(sum(label) AS DOUBLE) / count(*) AS pos FROM ({over}))""", "imbalance")
    sq["f5_seeded_shuffle"] = with_views(
        f"""SELECT *, row_number() OVER (ORDER BY shuffle_key, row_id, copy_no) - 1 AS position FROM (
  SELECT row_id, copy_no, md5(concat_ws(':', '1', CAST(row_id AS VARCHAR), CAST(copy_no AS VARCHAR))) AS shuffle_key FROM ({over}))""",
        "imbalance")

    # scalar functions
    sq["h1_join_texts"] = with_views(f"""SELECT {KEYS}, CAST(idx // 10000 AS BIGINT) AS part_no,
       string_agg(text, ';' ORDER BY idx) AS joined
  FROM ({positions(mx)}) GROUP BY {KEYS}, part_no""", "mx")
    sq["h2_n_chars"] = with_views("SELECT conv_id, line_num, CAST(length(line_text) AS INTEGER) AS n_chars FROM mx", "mx")
    sq["h3_emoji_count"] = f"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, {_lit(EMOJI_PATTERN)})) AS INTEGER) AS n_emoji FROM conversations"
    sq["h3_emoji_marked"] = (
        f"SELECT conv_id, turn, CAST(len(regexp_extract_all(translate(text, 'aeotnr', {_lit(MARKED)}), {_lit(EMOJI_PATTERN)})) AS INTEGER) AS n_emoji "
        "FROM conversations"
    )
    sq["h4_softmax"] = with_views(f"SELECT row_id, {r6(SOFTMAX0)} AS p0, {r6(SOFTMAX1)} AS p1 FROM scored", "scored")
    sq["h5_sigmoid"] = with_views("SELECT row_id, " + ", ".join(f"{r6(SIG.format(x=x))} AS p{i}" for i, x in enumerate(L3)) + " FROM scored", "scored")
    sq["h6_threshold_nhot"] = with_views(
        "SELECT row_id, concat_ws(',', " + ", ".join(f"CASE WHEN {SIG.format(x=x)} >= 0.5 THEN 1 ELSE 0 END" for x in L3) + ") AS nhot FROM scored",
        "scored")
    sq["h7_threshold_class"] = with_views(
        f"SELECT row_id, CASE WHEN p0 >= 0.5 THEN 0 WHEN p1 >= 0.5 THEN 1 ELSE 0 END AS cls FROM ({SCORED_PROBS})", "scored")
    sq["h8_argmax"] = with_views("""SELECT row_id, CASE WHEN logit0 >= logit1 AND logit0 >= logit0 + logit1 THEN 0
       WHEN logit1 >= logit0 + logit1 THEN 1 ELSE 2 END AS cls FROM scored""", "scored")
    sq["h9_active_indices"] = with_views(f"SELECT conv_id, line_num, array_to_string({ACTIVE}, ',') AS active FROM mx", "mx")
    sq["h10_any_above_zero"] = with_views(
        "SELECT conv_id, line_num, CASE WHEN y1 = 1 OR y2 = 1 OR y3 = 1 OR y4 = 1 OR y5 = 1 THEN 1 ELSE 0 END AS flag FROM mx", "mx")
    sq["h11_nhot_to_coarse"] = with_views(
        "SELECT conv_id, line_num, CASE WHEN y0 = 1 THEN 0 WHEN y1 + y2 + y3 + y4 + y5 > 0 THEN 1 END AS coarse FROM mx", "mx")
    sq["h12_clamp"] = with_views(f"SELECT conv_id, line_num, {C1} AS c1, {C2} AS c2 FROM mx", "mx")
    sq["h13_two_annotators"] = with_views(f"SELECT conv_id, line_num, array_to_string({TWO_ANN}, ',') AS labels FROM mx", "mx")
    sq["h14_merge_gold"] = with_views(f"SELECT conv_id, line_num, array_to_string({MERGED}, ',') AS labels FROM mx", "mx")
    sq["h15_window_certain"] = with_views("""SELECT conv_id, line_num,
       NOT ((y0 IS DISTINCT FROM y1 AND is_checked_sup IS NOT DISTINCT FROM FALSE)
         OR (y1 IS DISTINCT FROM y0 AND is_annotated_tagset_0 IS NOT DISTINCT FROM FALSE)) AS certain FROM mx""", "mx")
    sq["h16_verbalize_input"] = _sel(f"{KEYS}, target_idx, concat('Utterance: ', text, chr(10), 'Context: ', context) AS input", two, "mx")
    sq["h17_verbalize_label"] = _sel(
        f"{KEYS}, target_idx, CASE WHEN coarse <> 0 THEN 'positive' ELSE 'negative' END AS v_coarse, "
        f"{names_of('target_label')} AS v_multi, {v_seq} AS v_seq", two, "mx")
    sq["h18_first_label"] = with_views(
        f"SELECT row_id, {first_label('pred_text', True)} AS pred_first, {first_label('true_text', False)} AS true_first FROM generated",
        "generated")
    sq["h19_split_sequence"] = with_views("""SELECT row_id, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS piece
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT row_id, string_split(pred_seq, '; ') AS parts FROM generated))""",
                                          "generated")
    sq["h20_is_positive"] = with_views(
        f"SELECT row_id, CASE WHEN {py_strip('pred_coarse')} = 'positive' THEN 1 ELSE 0 END AS pred, "
        "CASE WHEN true_coarse = 'positive' THEN 1 ELSE 0 END AS \"true\" FROM generated", "generated")
    tok = f"SELECT conv_id, turn, {tokens('text')} AS tok FROM conversations"
    sq["h21_keep_last"] = f"SELECT conv_id, turn, array_to_string(tok[greatest(len(tok) - 15, 1) : greatest(len(tok) - 15, 1) + 15], ' ') AS kept FROM ({tok})"
    sq["h22_keep_first"] = f"SELECT conv_id, turn, array_to_string(tok[1 : 16], ' ') AS kept FROM ({tok})"
    sq["h23_tokens"] = f"SELECT conv_id, turn, CAST(len(tok) AS INTEGER) AS n_tokens, md5(array_to_string(tok, chr(1))) AS tok_md5 FROM ({tok})"
    sq["h24_round"] = with_views(
        f"SELECT round({f1('tp', 'fp', 'fn')}, 4) AS f1, round({ratio('tp', 'tp + fp')}, 4) AS precision FROM ({bc})", "scored")
    sq["h25_to_nhot"] = with_views(
        f"SELECT conv_id, line_num, array_to_string(list_transform(range(0, 6), lambda i: CASE WHEN list_contains({TWO_ANN}, i) THEN 1 ELSE 0 END), ',') AS nhot FROM mx",
        "mx")

    # joins
    sq["j2_pair_predictions"] = with_views('SELECT row_id, y_pred AS pred, y_true AS "true" FROM scored', "scored")
    sq["j3_zip_shortest"] = with_views(
        "SELECT conv_id, line_num, concat(y0, ':', l1, ',', y1, ':', l2) AS zipped FROM mx", "mx")
    sq["j4_label_lookup"] = with_views(_fine_ids(), "generated")
    sq["j5_label_lookup_default"] = with_views(_utt_ids(), "generated")
    sq["j6_class_names"] = with_views("SELECT row_id, 'c' || CAST(true_class % 6 AS VARCHAR) AS name FROM scored", "scored")
    sq["j7_align_batch"] = with_views(f"WITH {pieces()} {ALIGN_BATCH}", "generated")
    sq["j7_align_utterance"] = with_views(f"WITH {pieces()} {ALIGN_UTT}", "generated")

    # jobs and reports
    vowels = "length(text) - length(regexp_replace(text, '[aeiouAEIOU]', '', 'g'))"
    sq["k1_batch_scoring"] = with_views(
        f"SELECT row_id, {r6('ln(1 + length(text)) / 4.0')} AS l0, "
        f"{r6(f'CASE WHEN length(text) > 0 THEN CAST({vowels} AS DOUBLE) / length(text) ELSE 0.0 END * 8.0 - 2.0')} AS l1 FROM imbalance",
        "imbalance")
    sq["k4_binary_report"] = _report(_k4_rows(), "scored")
    sq["k5_multilabel_report"] = _report(_k5_rows(), "scored")
    sq["k6_generated_coarse"] = _report(_k6_rows(K6_COARSE), "generated")
    sq["k6_generated_fine"] = _report(_k6_rows(_fine_ids()), "generated")
    utt_pairs = f"SELECT concat_ws(':', CAST(row_id AS VARCHAR), CAST(pos AS VARCHAR)) AS row_id, true_id, pred_id FROM ({_utt_ids()})"
    sq["k6_generated_per_utterance"] = _report(_k6_rows(utt_pairs, k="SELECT count(*) // 10 FROM generated"), "generated")
    k7 = f"""SELECT row_number() OVER (ORDER BY text, context, coarse <> 0) - 1 AS row_id,
       CASE WHEN coarse <> 0 THEN 1 ELSE 0 END AS true_id, CASE WHEN length(text) % 4 = 0 THEN 1 ELSE 0 END AS pred_id
  FROM ({dataset("mx", CTX, True, EMOJI_PATTERN, "line_text_en")}) WHERE part = 'test'"""
    sq["k7_cross_lingual"] = _report(_k6_rows(k7), "mx", prefix_cols="'ctx256_two' AS train_tag, 'ctx256_two_en' AS test_tag, ")
    return sq
