"""DuckDB SQL for every registered query that SQL can express.

Written from the operator definitions, not from the Spark code: windows are
spelled out, ideal DCG ranks labels instead of using the closed form, AUC
counts pairs by score, and so on.  Views A-D are repeated here as CTEs.
"""

from __future__ import annotations

SERVED = """
served AS (
  SELECT l_orderkey AS list_id,
         (row_number() OVER (PARTITION BY l_orderkey
                             ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::BIGINT AS slot,
         l_partkey AS item_id,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS cate,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label,
         1.0 / (1.0 + exp(-((l_quantity - 25) / 10))) AS pred
  FROM lineitem)"""


def lm_ctes(src: str, order: str, p: str = "", scopes=(1, 5, 7)) -> str:
    """Per-list metric CTEs over ``src`` (list_id, slot, pred, label), ranked
    by ``order``; the result CTE is ``{p}lm``."""
    ks = ", ".join(str(k) for k in scopes)
    return f"""
{p}ranked AS (SELECT *, {order} AS r FROM {src}),
{p}hit AS (SELECT *, sum(CASE WHEN label >= 1 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY list_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS h
        FROM {p}ranked),
{p}ks AS (SELECT unnest([{ks}]) AS k),
{p}per AS (
  SELECT list_id, k,
         sum((pow(2, label) - 1) / log2(r + 1)) AS dcg,
         sum(CASE WHEN label >= 1 THEN h / r END) AS apv,
         sum(CASE WHEN label >= 1 THEN 1 ELSE 0 END) AS apc,
         sum(label) AS util
  FROM {p}hit JOIN {p}ks ON r <= k GROUP BY list_id, k),
{p}ideal AS (
  SELECT list_id, k, sum((pow(2, label) - 1) / log2(ir + 1)) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY label DESC, slot) AS ir
        FROM {src}) JOIN {p}ks ON ir <= k
  GROUP BY list_id, k),
{p}lm AS (
  SELECT {p}per.list_id, {p}per.k,
         CASE WHEN idcg <> 0 THEN dcg / idcg ELSE 0 END AS ndcg,
         CASE WHEN apc <> 0 THEN apv / apc ELSE 0 END AS map,
         util::DOUBLE AS utility
  FROM {p}per JOIN {p}ideal USING (list_id, k))"""


def _rank_metrics(order: str) -> str:
    return f"""
WITH {SERVED},
ranked AS (SELECT *, {order} AS r FROM served),
hit AS (SELECT *, sum(CASE WHEN label >= 1 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY list_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS h
        FROM ranked),
ks AS (SELECT unnest([1, 5, 7]) AS k),
per AS (
  SELECT list_id, k,
         sum((pow(2, label) - 1) / log2(r + 1)) AS dcg,
         sum(CASE WHEN label >= 1 THEN h / r END) AS apv,
         sum(CASE WHEN label >= 1 THEN 1 ELSE 0 END) AS apc,
         sum(label) AS util
  FROM hit JOIN ks ON r <= k GROUP BY list_id, k),
ideal AS (
  SELECT list_id, k, sum((pow(2, label) - 1) / log2(ir + 1)) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY label DESC, slot) AS ir
        FROM served) JOIN ks ON ir <= k
  GROUP BY list_id, k),
lm AS (
  SELECT per.list_id, per.k,
         CASE WHEN idcg <> 0 THEN dcg / idcg ELSE 0 END AS ndcg,
         CASE WHEN apc <> 0 THEN apv / apc ELSE 0 END AS map,
         util::DOUBLE AS utility
  FROM per JOIN ideal USING (list_id, k))"""


RANK_ORDER = "row_number() OVER (PARTITION BY list_id ORDER BY pred DESC, slot)"

EXPOSURE = f"""
WITH {SERVED},
top AS (SELECT cate FROM (
          SELECT cate, row_number() OVER (PARTITION BY list_id ORDER BY pred DESC, slot) AS r
          FROM served) WHERE r <= 5),
cats AS (SELECT unnest([0, 1, 2]) AS cate),
cnt AS (SELECT c.cate, count(t.cate) AS exposure FROM cats c LEFT JOIN top t ON c.cate = t.cate
        GROUP BY c.cate),
expo AS (SELECT cate, exposure, exposure / sum(exposure) OVER () AS ratio FROM cnt),
tgt AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 0.4::DOUBLE), (2, 0.1::DOUBLE)) t(cate, target))"""

SQL: dict[str, str] = {}

SQL["rank_metrics"] = _rank_metrics(RANK_ORDER) + """
SELECT k, count(*) AS n_lists, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map,
       round(avg(utility), 6) AS utility
FROM lm GROUP BY k"""

SQL["initial_rank_metrics"] = _rank_metrics("slot + 1") + """
SELECT k, count(*) AS n_lists, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map,
       round(avg(utility), 6) AS utility
FROM lm GROUP BY k"""

SQL["list_metrics"] = _rank_metrics(RANK_ORDER) + """
SELECT list_id, k, round(ndcg, 6) AS ndcg, round(map, 6) AS map, round(utility, 6) AS utility
FROM lm"""

SQL["rerank"] = f"""
WITH {SERVED}
SELECT list_id, slot,
       row_number() OVER (PARTITION BY list_id ORDER BY pred DESC, slot)::BIGINT AS rank
FROM served"""

SQL["khot_pick"] = f"""
WITH {SERVED}
SELECT list_id, slot,
       CASE WHEN row_number() OVER (PARTITION BY list_id ORDER BY pred DESC, slot) <= 5
            THEN 1 ELSE 0 END AS pick
FROM served"""

SQL["exposure_ratio"] = EXPOSURE + """
SELECT cate, exposure::BIGINT AS exposure, round(ratio, 6) AS ratio FROM expo"""

SQL["exposure_js"] = EXPOSURE + """,
d AS (SELECT target AS p, ratio AS q, (target + ratio) / 2 AS m FROM expo JOIN tgt USING (cate))
SELECT round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END)
           + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END), 6) AS js
FROM d"""

SQL["kl_divergence"] = EXPOSURE + """,
d AS (SELECT ratio / sum(ratio) OVER () AS p, target / sum(target) OVER () AS q
      FROM expo JOIN tgt USING (cate))
SELECT round(sum(CASE WHEN p <= 0 THEN 0 WHEN q <= 0 THEN 'inf'::DOUBLE
                      ELSE p * ln(p / q) END), 6) AS kl
FROM d"""

SQL["log_loss"] = f"""
WITH {SERVED}
SELECT round(-avg(label * ln(pred + 1e-7) + (1 - label) * ln(1 - pred + 1e-7)), 6) AS log_loss
FROM served"""

SQL["auc"] = f"""
WITH {SERVED},
pos AS (SELECT pred FROM served WHERE label >= 1),
neg AS (SELECT pred, count(*) AS c FROM served WHERE label < 1 GROUP BY pred),
pairs AS (
  SELECT sum(CASE WHEN n.pred < p.pred THEN n.c WHEN n.pred = p.pred THEN 0.5 * n.c ELSE 0 END) AS w
  FROM pos p JOIN neg n ON n.pred <= p.pred)
SELECT round((SELECT w FROM pairs)
             / ((SELECT count(*) FROM pos) * (SELECT sum(c) FROM neg)), 6) AS auc"""

SQL["lists_without_positive"] = f"""
WITH {SERVED}
SELECT list_id, sum(label)::BIGINT AS n_pos, count(*) AS n_slots
FROM served GROUP BY list_id HAVING sum(label) = 0"""

SQL["score_heads"] = f"""
WITH {SERVED},
s AS (SELECT list_id, slot, (pred - 0.5) * 4 AS logit FROM served),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY list_id)) AS e FROM s)
SELECT list_id, slot, round(1 / (1 + exp(-logit)), 6) AS sigmoid,
       round(e / sum(e) OVER (PARTITION BY list_id), 6) AS softmax
FROM e"""

# ------------------------------------------------------------------ view A
IMPS = """
imps_base AS (
  SELECT event_id AS imp_id, user_id, ts,
         CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS label,
         value / 500 AS score,
         (k % 10)::VARCHAR AS pos, (k // 10)::VARCHAR AS pagenum,
         (event_id % 3)::VARCHAR AS sex,
         least(floor(value / 50), 7)::BIGINT::VARCHAR AS price_level,
         (user_id % 5)::VARCHAR AS age_level, (k % 3 + 1)::VARCHAR AS bc_type,
         round_even(value / 500 * 10, 0)::INT::VARCHAR AS score_bucket,
         (user_id % 2)::VARCHAR AS user_os, (user_id % 3)::VARCHAR AS user_gender,
         (user_id % 5)::VARCHAR AS user_age_level, (user_id % 7)::VARCHAR AS user_purchase_level,
         hour(ts)::VARCHAR AS user_hour, k
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)),
imps AS (
  SELECT *, CASE WHEN label <> 0 THEN len(hist) ELSE 0 END AS hist_len FROM (
    SELECT *, coalesce(list_filter(
             list(CASE WHEN label = 1 THEN [pos, pagenum, sex, price_level, age_level, bc_type] END)
               OVER (PARTITION BY user_id ORDER BY ts, imp_id
                     ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
             lambda x: x IS NOT NULL), []::VARCHAR[][]) AS hist
    FROM imps_base)),
fhist AS (SELECT * FROM imps WHERE label = 0 OR hist_len > 0),
elig AS (SELECT split, user_id FROM fhist GROUP BY split, user_id
         HAVING sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END) >= 1
            AND sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) >= 1),
flog AS (SELECT f.* FROM fhist f JOIN elig e USING (split, user_id))"""


def hstr(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda s: array_to_string(s, ',')), ';')"


SQL["hist_asof"] = f"""
WITH {IMPS}
SELECT imp_id, len(hist)::INT AS hist_len, {hstr('hist')} AS hist_str FROM imps"""

SQL["score_bucket"] = f"""
WITH {IMPS}
SELECT imp_id, score_bucket::INT AS score_bucket FROM imps_base"""

SQL["pos_neg_split"] = f"""
WITH {IMPS}
SELECT split, CASE WHEN label <> 0 THEN 'pos' ELSE 'neg' END AS kind, count(*) AS n_items
FROM imps_base GROUP BY ALL"""

# the log's parallel sequences of a positive and their parsed prefix
PARSED = """
steps AS (
  SELECT imp_id, list_transform(hist, lambda s: CASE WHEN s[1] IN ('0', '5')
                                               THEN ['0','0','0','0','0','0'] ELSE s END)
                 || list_transform(range(30 - len(hist)), lambda i: ['0','0','0','0','0','0']) AS st
  FROM imps WHERE label = 1),
seqs AS (
  SELECT imp_id, list_transform(range(1, 7), lambda f: string_split(
           array_to_string(list_transform(st, lambda s: s[f]), ','), ',')) AS f
  FROM steps),
sums AS (
  SELECT imp_id, f, list_transform(range(1, len(f[1]) + 1),
           lambda i: f[1][i]::INT + f[2][i]::INT + f[3][i]::INT + f[4][i]::INT + f[5][i]::INT
                + f[6][i]::INT) AS s
  FROM seqs),
stops AS (
  SELECT imp_id, f, s,
         coalesce(nullif(list_position(list_transform(range(1, len(s) + 1),
           lambda i: CASE WHEN s[i] = 0 AND i < len(s) AND s[i + 1] = 0 THEN 1 ELSE 0 END), 1), 0),
           len(s) + 1) AS stop_at
  FROM sums),
cnt AS (SELECT imp_id, f, len(list_filter(s[1:stop_at - 1], lambda x: x <> 0)) AS n FROM stops)"""

SQL["hist_parse"] = f"""
WITH {IMPS},{PARSED}
SELECT imp_id, n::INT AS hist_len,
       array_to_string(list_transform(range(1, n + 1),
         lambda i: f[1][i] || ',' || f[2][i] || ',' || f[3][i] || ',' || f[4][i] || ',' || f[5][i]
              || ',' || f[6][i]), ';') AS hist_str
FROM cnt"""

SQL["filter_history"] = f"""
WITH {IMPS}
SELECT split, imp_id, label, hist_len::INT AS hist_len FROM fhist"""

SQL["filter_users"] = f"""
WITH {IMPS}
SELECT split, user_id, imp_id, label FROM flog"""

SQL["user_profile"] = f"""
WITH {IMPS}
SELECT split, user_id,
       arg_min(user_os, imp_id) AS user_os, arg_min(user_gender, imp_id) AS user_gender,
       arg_min(user_age_level, imp_id) AS user_age_level,
       arg_min(user_purchase_level, imp_id) AS user_purchase_level,
       arg_min(user_hour, imp_id) AS user_hour
FROM imps_base GROUP BY split, user_id"""

SQL["score_range"] = f"""
WITH {IMPS}
SELECT split, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
FROM imps_base GROUP BY split"""

SQL["user_counts"] = f"""
WITH {IMPS}
SELECT split, user_id, count(*) FILTER (WHERE label <> 0) AS n_pos,
       count(*) FILTER (WHERE label = 0) AS n_neg
FROM flog GROUP BY split, user_id"""

_LADDER_RUNGS = {
    "pos_ge1": "p >= 1", "pos_ge2": "p >= 2", "neg_ge1": "n >= 1", "neg_ge9": "n >= 9",
    "pos1_neg1": "p >= 1 AND n >= 1", "pos1_neg2": "p >= 1 AND n >= 2",
    "pos1_neg5": "p >= 1 AND n >= 5", "pos1_neg9": "p >= 1 AND n >= 9",
}

SQL["user_ladder"] = f"""
WITH {IMPS},
uc AS (SELECT split, user_id, count(*) FILTER (WHERE label <> 0) AS p,
              count(*) FILTER (WHERE label = 0) AS n FROM imps GROUP BY split, user_id),
lad AS (SELECT split, count(*) AS n_users,
        {", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _LADDER_RUNGS.items())}
        FROM uc GROUP BY split)
SELECT split, n_users, {", ".join(_LADDER_RUNGS)},
       {", ".join(f"round({k} / n_users, 6) AS {k}_share" for k in _LADDER_RUNGS)}
FROM lad"""

SQL["hist_buckets"] = f"""
WITH {IMPS},
b AS (SELECT split, count(*) AS n_pos, sum(hist_len)::BIGINT AS total_len,
             count(*) FILTER (WHERE hist_len = 0) AS e0,
             count(*) FILTER (WHERE hist_len BETWEEN 1 AND 5) AS le5,
             count(*) FILTER (WHERE hist_len BETWEEN 6 AND 10) AS le10,
             count(*) FILTER (WHERE hist_len > 10) AS g10
      FROM imps WHERE label <> 0 GROUP BY split)
SELECT split, n_pos, total_len, round(total_len / n_pos, 6) AS avg_len, e0, le5, le10, g10,
       round(e0 / n_pos, 6) AS e0_share, round(le5 / n_pos, 6) AS le5_share,
       round(le10 / n_pos, 6) AS le10_share, round(g10 / n_pos, 6) AS g10_share
FROM b"""

SQL["cate_histogram"] = f"""
WITH {IMPS},
u AS (SELECT split, 'item' AS kind, bc_type AS cate FROM imps
      UNION ALL SELECT split, 'pos', bc_type FROM imps WHERE label <> 0
      UNION ALL SELECT split, 'hist', step[6] FROM
        (SELECT split, unnest(hist) AS step FROM imps WHERE label <> 0)),
c AS (SELECT split, kind, cate, count(*) AS n FROM u GROUP BY ALL)
SELECT split, kind, cate, n, round(n / sum(n) OVER (PARTITION BY split, kind), 6) AS share
FROM c"""

_CARD = """
SELECT split, count(DISTINCT user_id) AS n_users, count(*) AS n_items,
       count(*) FILTER (WHERE label <> 0) AS n_pos,
       round(count(*) FILTER (WHERE label <> 0) / count(*), 6) AS pos_share
FROM {src} GROUP BY split"""

SQL["dataset_cardinality"] = f"WITH {IMPS}" + _CARD.format(src="flog")

SQL["profile_stages"] = f"""
WITH {IMPS},
st AS (SELECT 'before' AS stage, * FROM imps UNION ALL SELECT 'after', * FROM flog),
uc AS (SELECT stage, split, user_id, count(*) FILTER (WHERE label <> 0) AS p,
              count(*) FILTER (WHERE label = 0) AS n FROM st GROUP BY ALL),
lad AS (SELECT stage, split, count(*) FILTER (WHERE p >= 1) AS pos_ge1,
               count(*) FILTER (WHERE n >= 1) AS neg_ge1,
               count(*) FILTER (WHERE p >= 1 AND n >= 1) AS pos1_neg1,
               count(*) FILTER (WHERE p >= 1 AND n >= 9) AS pos1_neg9 FROM uc GROUP BY ALL),
card AS (SELECT stage, split, count(DISTINCT user_id) AS n_users, count(*) AS n_items,
                count(*) FILTER (WHERE label <> 0) AS n_pos,
                round(count(*) FILTER (WHERE label <> 0) / count(*), 6) AS pos_share
         FROM st GROUP BY ALL)
SELECT * FROM card JOIN lad USING (stage, split)"""

_LADDER_ROWS = " UNION ALL ".join(
    f"SELECT stage, split, 'ladder', '{k}', count(*) FILTER (WHERE {c}), count(*) FILTER (WHERE {c}) / count(*)"
    f" FROM uc GROUP BY stage, split" for k, c in _LADDER_RUNGS.items())
_BUCKETS = {"e0": "hist_len = 0", "le5": "hist_len BETWEEN 1 AND 5", "le10": "hist_len BETWEEN 6 AND 10", "g10": "hist_len > 10"}
_BUCKET_ROWS = " UNION ALL ".join(
    f"SELECT stage, split, 'hist', '{k}', count(*) FILTER (WHERE {c}), count(*) FILTER (WHERE {c}) / count(*)"
    f" FROM st WHERE label <> 0 GROUP BY stage, split" for k, c in _BUCKETS.items())

SQL["profile_full"] = f"""
WITH {IMPS},
st AS (SELECT 'before' AS stage, * FROM imps UNION ALL SELECT 'after', * FROM flog),
uc AS (SELECT stage, split, user_id, count(*) FILTER (WHERE label <> 0) AS p,
              count(*) FILTER (WHERE label = 0) AS n FROM st GROUP BY ALL),
ct AS (SELECT stage, split, 'cate_item' AS section, bc_type AS name FROM st
       UNION ALL SELECT stage, split, 'cate_pos', bc_type FROM st WHERE label <> 0
       UNION ALL SELECT stage, split, 'cate_hist', step[6] FROM
         (SELECT stage, split, unnest(hist) AS step FROM st WHERE label <> 0)),
cc AS (SELECT stage, split, section, name, count(*) AS n FROM ct GROUP BY ALL),
parts(stage, split, section, name, value, share) AS (
  SELECT stage, split, 'card', 'n_users', count(DISTINCT user_id)::DOUBLE, NULL::DOUBLE FROM st GROUP BY stage, split
  UNION ALL SELECT stage, split, 'card', 'n_items', count(*), NULL FROM st GROUP BY stage, split
  UNION ALL SELECT stage, split, 'card', 'n_pos', count(*) FILTER (WHERE label <> 0),
    count(*) FILTER (WHERE label <> 0) / count(*) FROM st GROUP BY stage, split
  UNION ALL {_LADDER_ROWS}
  UNION ALL {_BUCKET_ROWS}
  UNION ALL SELECT stage, split, 'hist', 'total_len', sum(hist_len), NULL FROM st WHERE label <> 0 GROUP BY stage, split
  UNION ALL SELECT stage, split, 'hist', 'avg_len', avg(hist_len), NULL FROM st WHERE label <> 0 GROUP BY stage, split
  UNION ALL SELECT stage, split, section, name, n, n / sum(n) OVER (PARTITION BY stage, split, section) FROM cc)
SELECT stage, split, section, name, round(value, 6) AS value, round(share, 6) AS share FROM parts"""

SQL["pad_history"] = f"""
WITH {IMPS}
SELECT imp_id, least(len(hist), 30)::INT AS hist_len,
       {hstr("(hist[1:30] || list_transform(range(greatest(30 - len(hist), 0)), lambda i: ['0','0','0','0','0','0']))")} AS hist_str
FROM flog WHERE label = 1"""

# ------------------------------------------------------------------ vocabulary
_ITEM = [("item:pos", "pos"), ("item:pagenum", "pagenum"), ("item:sex", "sex"),
         ("item:price_level", "price_level"), ("item:age_level", "age_level"),
         ("item:bc_type", "bc_type"), ("item:score", "score_bucket")]
_USER = [("user:user_os", "user_os"), ("user:user_gender", "user_gender"),
         ("user:user_age_level", "user_age_level"),
         ("user:user_purchase_level", "user_purchase_level"), ("user:user_hour", "user_hour")]


def _vocab_ctes(src: str, base: str, name: str = "vocab") -> str:
    """Vocabulary over filtered log ``src`` whose unfiltered rows are ``base``."""
    items = "\n      UNION ALL ".join(
        f"SELECT '{ns}' AS ns, {c} AS value, 0 AS phase, CASE WHEN split = 'train' THEN 0 ELSE 1 END"
        f" AS so, imp_id AS pos, {i} AS sub FROM {src}" for i, (ns, c) in enumerate(_ITEM))
    hist = "\n      UNION ALL ".join(
        f"SELECT '{ns}', s[{i + 1}], 1, CASE WHEN split = 'train' THEN 0 ELSE 1 END, imp_id,"
        f" (step - 1) * 6 + {i} FROM {name}_steps" for i, (ns, _) in enumerate(_ITEM[:6]))
    users = "\n      UNION ALL ".join(
        [f"SELECT 'uid', user_id::VARCHAR, 2, CASE WHEN split = 'train' THEN 0 ELSE 1 END,"
         f" first_imp, 0 FROM {name}_prof"] +
        [f"SELECT '{ns}', {c}, 2, CASE WHEN split = 'train' THEN 0 ELSE 1 END, first_imp, {j + 1}"
         f" FROM {name}_prof" for j, (ns, c) in enumerate(_USER)])
    return f"""
{name}_steps AS (SELECT split, imp_id, unnest(hist) AS s, generate_subscripts(hist, 1) AS step
           FROM {src} WHERE label <> 0),
{name}_prof AS (
  SELECT split, user_id, min(imp_id) AS first_imp,
         arg_min(user_os, imp_id) AS user_os, arg_min(user_gender, imp_id) AS user_gender,
         arg_min(user_age_level, imp_id) AS user_age_level,
         arg_min(user_purchase_level, imp_id) AS user_purchase_level,
         arg_min(user_hour, imp_id) AS user_hour
  FROM {base} WHERE (split, user_id) IN (SELECT DISTINCT split, user_id FROM {src})
  GROUP BY split, user_id),
{name}_app AS ({items}
      UNION ALL {hist}
      UNION ALL {users}),
{name}_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ns, value
                                              ORDER BY phase, so, pos, sub) AS rn
                 FROM {name}_app) WHERE rn = 1),
{name} AS (SELECT ns, value, row_number() OVER (ORDER BY phase, so, pos, sub)::BIGINT AS id
           FROM {name}_first)"""


VOCAB = f"WITH RECURSIVE {IMPS},{_vocab_ctes('flog', 'imps')}"

SQL["vocab"] = VOCAB + "\nSELECT ns, value, id FROM vocab"
SQL["vocab_sizes"] = VOCAB + "\nSELECT ns, count(*) AS n_values FROM vocab GROUP BY ns"
SQL["cate_index"] = VOCAB + """
SELECT value AS cate_value, id AS cate_id,
       (row_number() OVER (ORDER BY id) - 1)::BIGINT AS cate_idx
FROM vocab WHERE ns = 'item:bc_type'"""


def _enc(alias: str, ns: str, col: str, src: str = "l") -> str:
    return (f"coalesce((SELECT id FROM vocab v WHERE v.ns = '{ns}' AND v.value = {src}.{col}::VARCHAR),"
            f" 0)::BIGINT AS {alias}")


SQL["encode_items"] = VOCAB + f"""
SELECT imp_id, {", ".join(_enc(c + "_id", ns, c) for ns, c in _ITEM)}
FROM flog l"""

SQL["encode_users"] = VOCAB + f"""
SELECT split, user_id, {_enc("user_id_id", "uid", "user_id")},
       {", ".join(_enc(c + "_id", ns, c) for ns, c in _USER)}
FROM vocab_prof l"""

SQL["encode_history"] = VOCAB + """,
st AS (SELECT imp_id, step, f, s[f] AS v FROM vocab_steps CROSS JOIN range(1, 7) t(f)),
enc AS (SELECT st.imp_id, st.step, st.f, coalesce(v.id, 0) AS id
        FROM st LEFT JOIN vocab v
          ON v.ns = ['item:pos', 'item:pagenum', 'item:sex', 'item:price_level',
                     'item:age_level', 'item:bc_type'][st.f] AND v.value = st.v),
steps AS (SELECT imp_id, step, string_agg(id::VARCHAR, ',' ORDER BY f) AS s
          FROM enc GROUP BY imp_id, step),
per AS (SELECT imp_id, string_agg(s, ';' ORDER BY step) AS h FROM steps GROUP BY imp_id)
SELECT l.imp_id, coalesce(per.h, '') AS hist_ids
FROM flog l LEFT JOIN per USING (imp_id) WHERE l.label = 1"""

SQL["vocab_increment"] = f"""
WITH {IMPS},
tr AS (SELECT * FROM imps WHERE split = 'train'),
trf_h AS (SELECT * FROM tr WHERE label = 0 OR hist_len > 0),
trf AS (SELECT * FROM trf_h WHERE (split, user_id) IN (
          SELECT split, user_id FROM trf_h GROUP BY ALL
          HAVING count(*) FILTER (WHERE label <> 0) >= 1 AND count(*) FILTER (WHERE label = 0) >= 1)),
{_vocab_ctes('trf', 'tr', 'base')},
te AS (SELECT * FROM flog WHERE split = 'test'),
new AS ({" UNION ALL ".join(f"SELECT '{ns}' AS ns, {c} AS value, imp_id * 8 + {i} AS ord FROM te"
                            for i, (ns, c) in enumerate(_ITEM))}),
fresh AS (SELECT ns, value, min(ord) AS ord FROM new
          WHERE (ns, value) NOT IN (SELECT ns, value FROM base) GROUP BY ns, value)
SELECT ns, value, id FROM base
UNION ALL
SELECT ns, value, ((SELECT coalesce(max(id), 0) FROM base)
                   + row_number() OVER (ORDER BY ord, ns, value))::BIGINT FROM fresh"""



def _day(name: str, rows: str) -> str:
    """The filtered log of one day and its vocabulary's first appearances."""
    return f"""
{name}_in AS (SELECT * FROM imps WHERE {rows}),
{name}_h AS (SELECT * FROM {name}_in WHERE label = 0 OR hist_len > 0),
{name}_log AS (SELECT * FROM {name}_h WHERE (split, user_id) IN (
          SELECT split, user_id FROM {name}_h GROUP BY ALL
          HAVING count(*) FILTER (WHERE label <> 0) >= 1 AND count(*) FILTER (WHERE label = 0) >= 1)),
{_vocab_ctes(f"{name}_log", f"{name}_in", name)}"""


SQL["vocab_days"] = f"""
WITH {IMPS},{_day("d0", "split = 'train'")},
{_day("d1", "split = 'test' AND (imp_id // 5) % 2 = 0")},
{_day("d2", "split = 'test' AND (imp_id // 5) % 2 = 1")},
v0 AS (SELECT ns, value, id, 0 AS segment FROM d0),
v1 AS (SELECT * FROM v0 UNION ALL
       SELECT ns, value, ((SELECT coalesce(max(id), 0) FROM v0) + row_number() OVER (ORDER BY phase, so, pos, sub))::BIGINT, 1
       FROM d1_first WHERE (ns, value) NOT IN (SELECT ns, value FROM v0)),
v2 AS (SELECT * FROM v1 UNION ALL
       SELECT ns, value, ((SELECT coalesce(max(id), 0) FROM v1) + row_number() OVER (ORDER BY phase, so, pos, sub))::BIGINT, 2
       FROM d2_first WHERE (ns, value) NOT IN (SELECT ns, value FROM v1))
SELECT ns, value, id, segment FROM v2"""

# ------------------------------------------------------------------ sampling / lists


def h60(*keys: str) -> str:
    ks = ", ".join(f"{k}::VARCHAR" for k in keys)
    return f"('0x' || substr(md5(concat_ws('|', '42', {ks})), 1, 15))::BIGINT"


_NEGS = f"""
pos AS (SELECT split, user_id, imp_id AS list_id FROM flog WHERE label <> 0),
neg AS (SELECT split, user_id, imp_id AS neg_id, {h60('imp_id')} AS h FROM flog WHERE label = 0),
nidx AS (SELECT *, row_number() OVER (PARTITION BY split, user_id ORDER BY h, neg_id) - 1 AS j
         FROM neg),
nu AS (SELECT split, user_id, count(*) AS n FROM neg GROUP BY ALL),
pool AS (SELECT split, neg_id, user_id AS owner,
                row_number() OVER (PARTITION BY split ORDER BY h, neg_id) - 1 AS g FROM neg),
gn AS (SELECT split, count(*) AS gsize FROM neg GROUP BY split),
p AS (SELECT pos.*, coalesce(nu.n, 0) AS n, gn.gsize
      FROM pos LEFT JOIN nu USING (split, user_id) LEFT JOIN gn USING (split))"""

# Draws without replacement, from the definition: draw t of a positive is value t
# of its permutation of 0..m-1 -- 8 Feistel rounds over the square of side
# a = ceil(sqrt(m)), again and again until the value is below m.
_EXACT = f"""
tries AS (SELECT split, list_id, user_id, n, 'own' AS src, t, n AS m FROM p, range(9) t(t)
          WHERE t < least(n, 9)
          UNION ALL
          SELECT split, list_id, user_id, n, 'pool', t, gsize FROM p, range(9) t(t)
          WHERE n < 9 AND t < least(gsize, 9)),
walk AS (
  SELECT split, list_id, src, t, m, ceil(sqrt(m))::BIGINT AS a, 0 AS k,
         t // ceil(sqrt(m))::BIGINT AS l, t % ceil(sqrt(m))::BIGINT AS r
  FROM tries WHERE m > 9
  UNION ALL
  SELECT split, list_id, src, t, m, a, k % 8 + 1, r, (l + {h60('list_id', 'src', '(k % 8)', 'r')} % a) % a
  FROM walk WHERE NOT (k = 8 AND l * a + r < m)),
drawn AS MATERIALIZED (
  SELECT x.split, x.list_id, x.user_id, x.n, x.src, x.t,
         CASE WHEN x.m <= 9 THEN x.t ELSE w.l * w.a + w.r END AS i
  FROM tries x LEFT JOIN walk w ON w.split = x.split AND w.list_id = x.list_id AND w.src = x.src
                                AND w.t = x.t AND w.k = 8 AND w.l * w.a + w.r < w.m)"""

# Consecutive indices from a hash offset.
_ROTATE = f"""
drawn AS MATERIALIZED (
  SELECT split, list_id, user_id, n, 'own' AS src, t, ({h60('list_id')} % n + t) % n AS i
  FROM p, range(9) t(t) WHERE t < least(n, 9)
  UNION ALL
  SELECT split, list_id, user_id, n, 'pool', t, ({h60('list_id', "'pool'")} % gsize + t) % gsize
  FROM p, range(9) t(t) WHERE n < 9 AND t < least(gsize, 9))"""

_PICKED = """
own AS (SELECT d.split, d.list_id, d.user_id, x.neg_id, 'own' AS src, d.t::INT AS t
        FROM drawn d JOIN nidx x ON x.split = d.split AND x.user_id = d.user_id AND x.j = d.i
        WHERE d.src = 'own'),
cand AS (SELECT d.split, d.list_id, d.user_id, d.n, d.t AS u, pl.neg_id
         FROM drawn d JOIN pool pl ON pl.split = d.split AND pl.g = d.i
         WHERE d.src = 'pool' AND pl.owner <> d.user_id),
fill AS (SELECT split, list_id, user_id, neg_id, 'pool' AS src, (n + r - 1)::INT AS t
         FROM (SELECT *, row_number() OVER (PARTITION BY split, list_id ORDER BY u) AS r FROM cand)
         WHERE r <= 9 - n),
negs AS (SELECT * FROM own UNION ALL SELECT * FROM fill)"""

SAMPLING = f"""{_NEGS},{_EXACT},{_PICKED},
cands AS (
  SELECT *, (row_number() OVER (PARTITION BY split, list_id ORDER BY {h60('list_id', 'imp_id')}, imp_id)
             - 1)::BIGINT AS slot
  FROM (SELECT split, list_id, user_id, list_id AS imp_id, 1 AS label FROM pos
        UNION ALL SELECT split, list_id, user_id, neg_id, 0 FROM negs))"""

SQL["neg_sample"] = VOCAB + "," + SAMPLING + "\nSELECT split, list_id, neg_id, src, t FROM negs"
SQL["neg_sample_rotate"] = VOCAB + f",{_NEGS},{_ROTATE},{_PICKED}" + "\nSELECT split, list_id, neg_id, src, t FROM negs"
SQL["neg_fill"] = VOCAB + "," + SAMPLING + "\nSELECT split, list_id, neg_id, src, t FROM fill"
SQL["candidates"] = VOCAB + "," + SAMPLING + "\nSELECT split, list_id, slot, imp_id, label FROM cands"
SQL["shuffle_lists"] = VOCAB + "," + SAMPLING + f"""
SELECT split, list_id,
       (row_number() OVER (PARTITION BY split ORDER BY {h60('list_id')}, list_id) - 1)::BIGINT
         AS list_order
FROM pos"""

_Z6 = "[0::BIGINT, 0, 0, 0, 0, 0]"
DATASET = VOCAB + "," + SAMPLING + f""",
iv AS (SELECT f.split, f.imp_id, f.k, coalesce(v.id, 0) AS id
       FROM (SELECT split, imp_id, unnest(range(1, 8)) AS k,
                    unnest([pos, pagenum, sex, price_level, age_level, bc_type, score_bucket]) AS val
             FROM flog) f
       LEFT JOIN vocab v ON v.ns = ['item:pos', 'item:pagenum', 'item:sex', 'item:price_level',
                                     'item:age_level', 'item:bc_type', 'item:score'][f.k]
                        AND v.value = f.val),
items AS (SELECT split, imp_id, list(id ORDER BY k) AS ids FROM iv GROUP BY split, imp_id),
lists AS (SELECT c.split, c.list_id, list(i.ids ORDER BY c.slot) AS candi,
                 list(c.label ORDER BY c.slot) AS labels
          FROM cands c JOIN items i USING (split, imp_id) GROUP BY c.split, c.list_id),
hv AS (SELECT st.split, st.imp_id, st.step, st.f, coalesce(v.id, 0) AS id
       FROM (SELECT split, imp_id, step, f, s[f] AS val FROM vocab_steps CROSS JOIN range(1, 7) t(f)) st
       LEFT JOIN vocab v ON v.ns = ['item:pos', 'item:pagenum', 'item:sex', 'item:price_level',
                                     'item:age_level', 'item:bc_type'][st.f] AND v.value = st.val),
hsteps AS (SELECT split, imp_id, step, list(id ORDER BY f) AS st FROM hv GROUP BY split, imp_id, step),
hl AS (SELECT split, imp_id, list(st ORDER BY step) AS h FROM hsteps GROUP BY split, imp_id),
uv AS (SELECT p.split, p.user_id,
              [coalesce((SELECT id FROM vocab WHERE ns = 'uid' AND value = p.user_id::VARCHAR), 0),
               coalesce((SELECT id FROM vocab WHERE ns = 'user:user_os' AND value = p.user_os), 0),
               coalesce((SELECT id FROM vocab WHERE ns = 'user:user_gender' AND value = p.user_gender), 0),
               coalesce((SELECT id FROM vocab WHERE ns = 'user:user_age_level' AND value = p.user_age_level), 0),
               coalesce((SELECT id FROM vocab WHERE ns = 'user:user_purchase_level'
                         AND value = p.user_purchase_level), 0),
               coalesce((SELECT id FROM vocab WHERE ns = 'user:user_hour' AND value = p.user_hour), 0)]
                ::BIGINT[] AS usr
       FROM vocab_prof p),
ds AS (
  SELECT pos.split, pos.list_id, pos.user_id, uv.usr, lists.candi, lists.labels,
         coalesce(hl.h, []::BIGINT[][])[1:30]
           || list_transform(range(greatest(30 - len(coalesce(hl.h, []::BIGINT[][])), 0)),
                             lambda i: {_Z6}) AS hist,
         least(len(coalesce(hl.h, []::BIGINT[][])), 30)::INT AS hist_len
  FROM pos JOIN uv USING (split, user_id) JOIN lists USING (split, list_id)
       LEFT JOIN hl ON hl.split = pos.split AND hl.imp_id = pos.list_id),
cmap AS (SELECT id AS cate_id, (row_number() OVER (ORDER BY id) - 1)::INT AS cate_idx
         FROM vocab WHERE ns = 'item:bc_type')"""


def ids(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda s: array_to_string(s, ',')), ';')"


SQL["dataset"] = DATASET + f"""
SELECT split, list_id, user_id, array_to_string(usr, ',') AS usr, {ids('candi')} AS candi,
       array_to_string(labels, ',') AS labels, {ids('hist')} AS hist, hist_len
FROM ds"""

SQL["pages_per_user"] = DATASET + """
SELECT split, count(*) AS n_lists,
       round(sum(count(*)) OVER () / (SELECT count(*) FROM vocab WHERE ns = 'uid'), 6)
         AS pages_per_user
FROM ds GROUP BY split"""

_Z7 = "[0::BIGINT, 0, 0, 0, 0, 0, 0]"
SQL["pad_candidates"] = DATASET + f"""
SELECT list_id,
       {ids(f"(candi[1:10] || list_transform(range(greatest(10 - len(candi), 0)), lambda i: {_Z7}))")}
         AS full_candi,
       array_to_string(labels[1:10] || list_transform(range(greatest(10 - len(labels), 0)),
                                                      lambda i: 0), ',') AS full_labels,
       least(len(candi), 10)::INT AS candi_len
FROM ds"""

_CSPLIT = DATASET + f""",
dk AS (SELECT *, split || ':' || list_id::VARCHAR AS key FROM ds),
slots AS (SELECT d.key, s.i, d.candi[s.i] AS item, d.labels[s.i] AS label, m.cate_idx
          FROM dk d CROSS JOIN LATERAL (SELECT unnest(range(1, len(d.candi) + 1)) AS i) s
          JOIN cmap m ON m.cate_id = d.candi[s.i][6]),
grid AS (SELECT d.key, d.split, d.list_id, c.c FROM dk d CROSS JOIN (SELECT cate_idx AS c FROM cmap) c),
per AS (SELECT g.key, g.split, g.list_id, g.c,
               coalesce(list(s.item ORDER BY s.i) FILTER (WHERE s.item IS NOT NULL), []) AS items,
               coalesce(list(s.label ORDER BY s.i) FILTER (WHERE s.item IS NOT NULL), []) AS lbs
        FROM grid g LEFT JOIN slots s ON s.key = g.key AND s.cate_idx = g.c
        GROUP BY ALL),
pad AS (SELECT key, split, list_id, c, least(len(items), 10) AS n,
               items[1:10] || list_transform(range(greatest(10 - len(items), 0)), lambda i: {_Z7})
                 AS items,
               lbs[1:10] || list_transform(range(greatest(10 - len(lbs), 0)), lambda i: 0) AS lbs
        FROM per)"""

SQL["cate_split_candidates"] = _CSPLIT + f"""
SELECT list_id, string_agg({ids('items')}, '|' ORDER BY c) AS candi_c,
       string_agg(array_to_string(lbs, ','), '|' ORDER BY c) AS labels_c,
       string_agg(n::VARCHAR, ',' ORDER BY c) AS candi_len_c
FROM pad GROUP BY key, list_id"""

SQL["slot_layout"] = _CSPLIT + """
SELECT split, list_id, (c * 10 + p.i - 1)::BIGINT AS slot, c::INT AS cate,
       array_to_string(items[p.i], ',') AS item, lbs[p.i] AS label,
       CASE WHEN p.i - 1 < n THEN 1 ELSE 0 END AS mask
FROM pad CROSS JOIN range(1, 11) p(i)"""

SQL["cate_split_history"] = DATASET + f""",
hs AS (SELECT d.list_id, s.i, d.hist[s.i] AS step, m.cate_idx
       FROM ds d CROSS JOIN LATERAL (SELECT unnest(range(1, d.hist_len + 1)) AS i) s
       JOIN cmap m ON m.cate_id = d.hist[s.i][6]),
grid AS (SELECT d.list_id, c.c FROM ds d CROSS JOIN (SELECT cate_idx AS c FROM cmap) c),
per AS (SELECT g.list_id, g.c,
               coalesce(list(h.step ORDER BY h.i) FILTER (WHERE h.step IS NOT NULL), []) AS st
        FROM grid g LEFT JOIN hs h ON h.list_id = g.list_id AND h.cate_idx = g.c
        GROUP BY g.list_id, g.c),
pad AS (SELECT list_id, c, least(len(st), 20) AS n,
               CASE WHEN len(st) >= 20 THEN st[len(st) - 19:]
                    ELSE st || list_transform(range(20 - len(st)), lambda i: {_Z6}) END AS st
        FROM per)
SELECT list_id, string_agg({ids('st')}, '|' ORDER BY c) AS cate_hist,
       string_agg(n::VARCHAR, ',' ORDER BY c) AS cate_hist_len
FROM pad GROUP BY list_id"""

SQL["union_history"] = DATASET + f""",
u AS (SELECT list_id, greatest(hist_len - 3, 0) AS n,
             CASE WHEN hist_len > 3 THEN hist[1:hist_len - 3] ELSE []::BIGINT[][] END AS st
      FROM ds)
SELECT list_id,
       {ids(f"(CASE WHEN n >= 30 THEN st[n - 29:] ELSE st || list_transform(range(30 - n), lambda i: {_Z6}) END)")}
         AS union_hist,
       least(n, 30)::INT AS union_hist_len
FROM u"""

SQL["seq_mask"] = DATASET + """
SELECT list_id, array_to_string(list_transform(range(30),
         lambda i: CASE WHEN i < hist_len THEN 1 ELSE 0 END), ',') AS mask
FROM ds"""

SQL["feature_split"] = DATASET + f"""
SELECT list_id, {ids("list_transform(candi, lambda f: f[1:6])")} AS sparse,
       {ids("list_transform(candi, lambda f: f[7:])")} AS dense
FROM ds"""

SQL["batch_assign"] = f"""
WITH {SERVED},
l AS (SELECT DISTINCT list_id FROM served),
o AS (SELECT list_id, (row_number() OVER (ORDER BY {h60('list_id')}, list_id) - 1) AS i FROM l)
SELECT list_id, (i // 128)::BIGINT AS batch FROM o
WHERE i // 128 < (SELECT count(*) FROM l) // 128"""

# ------------------------------------------------------------------ picks / losses
GUMBEL = f"-ln(-ln(({h60('list_id', 'slot')} >> 7) / 9007199254740992.0 + 1e-10) + 1e-10)"

SQL["gumbel_topk"] = f"""
WITH {SERVED}
SELECT list_id, slot,
       CASE WHEN row_number() OVER (PARTITION BY list_id ORDER BY pred + {GUMBEL} DESC, slot) <= 5
            THEN 1 ELSE 0 END AS pick
FROM served"""

SQL["relaxed_topk"] = f"""
WITH {SERVED},
l AS (SELECT list_id, list(slot ORDER BY slot) AS slots,
             list(pred + {GUMBEL} ORDER BY slot) AS s1 FROM served GROUP BY list_id),
r1 AS (SELECT *, list_transform(s1, lambda v: exp(v - list_max(s1))) AS e1 FROM l),
o1 AS (SELECT *, list_transform(e1, lambda v: v / list_sum(e1)) AS p1 FROM r1),
r2 AS (SELECT *, list_transform(range(1, len(s1) + 1),
                  lambda i: s1[i] + ln(greatest(1 - p1[i], 1e-20))) AS s2 FROM o1),
e2 AS (SELECT *, list_transform(s2, lambda v: exp(v - list_max(s2))) AS e2 FROM r2),
o2 AS (SELECT *, list_transform(e2, lambda v: v / list_sum(e2)) AS p2 FROM e2),
k AS (SELECT list_id, unnest(slots) AS slot,
             unnest(list_transform(range(1, len(p1) + 1), lambda i: p1[i] + p2[i])) AS khot FROM o2)
SELECT list_id, slot, round(khot, 6) AS khot,
       CASE WHEN row_number() OVER (PARTITION BY list_id ORDER BY khot DESC, slot) <= 2
            THEN 1 ELSE 0 END AS pick
FROM k"""

BATCHED = f"""
WITH {SERVED},
bl AS (SELECT DISTINCT list_id FROM served),
bo AS (SELECT list_id, row_number() OVER (ORDER BY {h60('list_id')}, list_id) - 1 AS i FROM bl),
bs AS (SELECT list_id, i // 128 AS batch FROM bo WHERE i // 128 < (SELECT count(*) FROM bl) // 128),
slots AS (SELECT s.*, b.batch FROM served s JOIN bs b USING (list_id)),
bll AS (SELECT batch, -avg(label * ln(pred + 1e-7) + (1 - label) * ln(1 - pred + 1e-7)) AS log_loss
        FROM slots GROUP BY batch),
picks AS (SELECT batch, cate FROM (
            SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY pred DESC, slot) AS r
            FROM slots) WHERE r <= 5),
tgt AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 0.4::DOUBLE), (2, 0.1::DOUBLE)) t(cate, target)),
grid AS (SELECT b.batch, t.cate, t.target FROM (SELECT DISTINCT batch FROM slots) b CROSS JOIN tgt t),
pc AS (SELECT g.batch, g.cate, g.target, count(p.cate) AS n
       FROM grid g LEFT JOIN picks p ON p.batch = g.batch AND p.cate = g.cate
       GROUP BY g.batch, g.cate, g.target),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY batch) AS share FROM pc),
mm AS (SELECT *, (share + target) / 2 AS m FROM sh),
bjs AS (SELECT batch,
               0.5 * sum(CASE WHEN share > 0 THEN share * ln(share / (m + 1e-9)) ELSE 0 END)
             + 0.5 * sum(CASE WHEN target > 0 THEN target * ln(target / (m + 1e-9)) ELSE 0 END) AS js
        FROM mm GROUP BY batch)"""

SQL["batch_loss"] = BATCHED + """
SELECT count(*) AS n_batches, round(avg(log_loss), 6) AS loss FROM bll"""

SQL["batch_js_loss"] = BATCHED + """
SELECT batch, round(js, 6) AS js FROM bjs"""

SQL["combined_loss"] = BATCHED + """
SELECT batch, round(log_loss, 6) AS log_loss, round(js, 6) AS js,
       round(2 * 0.5 * log_loss + 2 * (1 - 0.5) * js, 6) AS loss
FROM bll JOIN bjs USING (batch)"""

# ------------------------------------------------------------------ embeddings
EMB = DATASET + """,
nv AS (SELECT count(*) AS n FROM embeddings),
ev AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
cf AS (SELECT d.list_id, (s.i - 1)::BIGINT AS slot, f.f, d.candi[s.i][f.f] AS id
       FROM ds d CROSS JOIN LATERAL (SELECT unnest(range(1, len(d.candi) + 1)) AS i) s
       CROSS JOIN range(1, 8) f(f)),
cfv AS (SELECT cf.*, CASE WHEN id <> 0 THEN ev.v END AS v
        FROM cf LEFT JOIN ev ON ev.vec_id = cf.id % (SELECT n FROM nv)),
dims AS (SELECT unnest(range(1, 65)) AS k),
qd AS (SELECT c.list_id, c.slot, k.k, sum(coalesce(c.v[k.k], 0)) AS x
       FROM cfv c CROSS JOIN dims k WHERE c.f <= 6 GROUP BY c.list_id, c.slot, k.k),
hf AS (SELECT d.list_id, s.i - 1 AS step, f.f, d.hist[s.i][f.f] AS id
       FROM ds d CROSS JOIN LATERAL (SELECT unnest(range(1, d.hist_len + 1)) AS i) s
       CROSS JOIN range(1, 7) f(f)),
hfv AS (SELECT hf.*, CASE WHEN id <> 0 THEN ev.v END AS v
        FROM hf LEFT JOIN ev ON ev.vec_id = hf.id % (SELECT n FROM nv)),
kd AS (SELECT h.list_id, h.step, k.k, sum(coalesce(h.v[k.k], 0)) AS x
       FROM hfv h CROSS JOIN dims k GROUP BY h.list_id, h.step, k.k)"""


def _stats(vec_expr: str) -> str:
    return (f"len({vec_expr})::INT AS dim, "
            f"round(sqrt(list_sum(list_transform({vec_expr}, lambda x: x * x))), 6) AS norm, "
            f"round(list_sum({vec_expr}), 6) AS vsum")


SQL["embed_lookup"] = EMB + """,
cv AS (SELECT c.list_id, c.slot, c.f, k.k, coalesce(c.v[k.k], 0.0) AS x
       FROM cfv c CROSS JOIN dims k)
SELECT list_id, slot, count(*)::INT AS dim, round(sqrt(sum(x * x)), 6) AS norm,
       round(sum(x), 6) AS vsum
FROM cv GROUP BY list_id, slot"""

SQL["attn_pool"] = EMB + """,
keyed AS (SELECT list_id, step FROM kd GROUP BY list_id, step HAVING sum(x) <> 0),
sc AS (SELECT q.list_id, q.slot, k.step, sum(q.x * k.x) / 8.0 AS s
       FROM qd q JOIN kd k ON k.list_id = q.list_id AND k.k = q.k
       WHERE (k.list_id, k.step) IN (SELECT list_id, step FROM keyed)
       GROUP BY q.list_id, q.slot, k.step),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY list_id, slot)) AS e FROM sc),
wt AS (SELECT *, e / sum(e) OVER (PARTITION BY list_id, slot) AS w FROM ex),
pooled AS (SELECT w.list_id, w.slot, k.k, sum(w.w * k.x) AS x
           FROM wt w JOIN kd k ON k.list_id = w.list_id AND k.step = w.step
           GROUP BY w.list_id, w.slot, k.k),
allc AS (SELECT DISTINCT list_id, slot FROM qd)
SELECT a.list_id, a.slot, 64::INT AS dim, round(sqrt(coalesce(sum(p.x * p.x), 0)), 6) AS norm,
       round(coalesce(sum(p.x), 0), 6) AS vsum
FROM allc a LEFT JOIN pooled p ON p.list_id = a.list_id AND p.slot = a.slot
GROUP BY a.list_id, a.slot"""

SQL["recency_pool"] = EMB + """,
sc AS (SELECT h.list_id, h.step, m.cate_idx AS cate FROM hf h JOIN cmap m ON m.cate_id = h.id
       WHERE h.f = 6),
aged AS (SELECT *, row_number() OVER (PARTITION BY list_id, cate ORDER BY step DESC) - 1 AS age
         FROM sc),
kept AS (SELECT * FROM aged WHERE age < 20),
pooled AS (SELECT a.list_id, a.cate, k.k, sum(pow(0.8, a.age) * k.x) AS x, count(*) AS n
           FROM kept a JOIN kd k ON k.list_id = a.list_id AND k.step = a.step
           GROUP BY a.list_id, a.cate, k.k),
grid AS (SELECT d.list_id, c.c::INT AS cate FROM ds d CROSS JOIN (SELECT cate_idx AS c FROM cmap) c)
SELECT g.list_id, g.cate, coalesce(max(p.n), 0)::BIGINT AS n_steps, 64::INT AS dim,
       round(sqrt(coalesce(sum(p.x * p.x), 0)), 6) AS norm, round(coalesce(sum(p.x), 0), 6) AS vsum
FROM grid g LEFT JOIN pooled p ON p.list_id = g.list_id AND p.cate = g.cate
GROUP BY g.list_id, g.cate"""

# ------------------------------------------------------------------ sources / sinks / streams
SQL["src_csv_impressions"] = f"""
WITH {IMPS},
seqs AS (
  SELECT imp_id, list_transform(hist, lambda s: CASE WHEN s[1] IN ('0', '5')
                                               THEN ['0','0','0','0','0','0'] ELSE s END)
                 || list_transform(range(30 - len(hist)), lambda i: ['0','0','0','0','0','0']) AS st
  FROM imps WHERE label = 1),
sums AS (SELECT imp_id, list_transform(st, lambda s: s[1]::INT + s[2]::INT + s[3]::INT + s[4]::INT
                                               + s[5]::INT + s[6]::INT) AS s FROM seqs),
stops AS (SELECT imp_id, s, coalesce(nullif(list_position(list_transform(range(1, len(s) + 1),
            lambda i: CASE WHEN s[i] = 0 AND i < len(s) AND s[i + 1] = 0 THEN 1 ELSE 0 END), 1), 0),
            len(s) + 1) AS stop_at FROM sums),
hl AS (SELECT imp_id, len(list_filter(s[1:stop_at - 1], lambda x: x <> 0)) AS n FROM stops)
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label <> 0) AS n_pos,
       count(DISTINCT user_id) AS n_users,
       sum(round_even(score * 10, 0)::INT)::BIGINT AS sum_bucket,
       sum(hl.n)::BIGINT AS total_hist_len
FROM imps LEFT JOIN hl USING (imp_id) GROUP BY split"""

# ------------------------------------------------------------------ CSV log
# View A as its CSV files give it back: ids are row numbers of each split, and
# the history is parsed from the sequences (keyed on the event until then).
_CSV_RAW, _CSV_REST = IMPS.split("fhist AS", 1)
CSV_IMPS = f"""{_CSV_RAW.replace("imps AS (", "imps_ev AS (", 1)}
{PARSED.strip().replace("FROM imps ", "FROM imps_ev ")},
imps AS (
  SELECT e.* EXCLUDE (imp_id, hist, hist_len),
         row_number() OVER (PARTITION BY e.split ORDER BY e.imp_id) - 1 AS imp_id,
         coalesce(list_transform(range(1, c.n + 1),
           lambda i: [c.f[1][i], c.f[2][i], c.f[3][i], c.f[4][i], c.f[5][i], c.f[6][i]]),
           []::VARCHAR[][]) AS hist,
         coalesce(c.n, 0) AS hist_len
  FROM imps_ev e LEFT JOIN cnt c USING (imp_id)),
fhist AS{_CSV_REST}"""

SQL["csv_log"] = f"""
WITH {CSV_IMPS}
SELECT split, imp_id, user_id, label, bc_type, score_bucket, hist_len::INT AS hist_len,
       {hstr('hist')} AS hist_str
FROM imps"""

SQL["csv_dataset"] = SQL["dataset"].replace(IMPS, CSV_IMPS)

SQL["sink_parquet_roundtrip"] = f"""
WITH {SERVED}
SELECT count(*) AS n_rows, count(DISTINCT list_id) AS n_lists, sum(label)::BIGINT AS n_pos,
       round(sum(pred), 6) AS sum_pred
FROM served"""

SQL["dataset_roundtrip"] = DATASET + """
SELECT split, count(*) AS n_lists, sum(hist_len)::BIGINT AS sum_hist_len,
       sum(list_sum(labels))::BIGINT AS sum_labels,
       sum(list_sum(flatten(candi)))::BIGINT AS sum_candi_ids
FROM ds GROUP BY split"""

SQL["dataset_stat"] = VOCAB + """,
cm AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM vocab WHERE ns = 'item:bc_type')
SELECT 7 AS itm_fnum, (SELECT count(*) FROM cm)::INT AS cate_num, 10 AS list_len, 30 AS hist_len,
       (SELECT max(id) + 1 FROM vocab)::INT AS ft_num,
       (SELECT count(*) FROM vocab WHERE ns = 'uid')::INT AS user_num, 6 AS hist_fnum,
       6 AS usr_fnum, 5 AS cate_idx,
       (SELECT '[' || string_agg('{"key":"' || id::VARCHAR || '","value":' || idx::VARCHAR || '}', ','
                                 ORDER BY id::VARCHAR) || ']' FROM cm) AS cate_idx_map"""

REQUESTS = _CSPLIT + f""",
mr AS (SELECT d.key, d.usr, d.hist_len,
              (SELECT list(n ORDER BY c) FROM pad WHERE pad.key = d.key) AS candi_len,
              (SELECT list(lbs ORDER BY c) FROM pad WHERE pad.key = d.key) AS lb
       FROM dk d),
rec AS (SELECT key, 'user-tracking' AS topic, ({h60('key')} % 4)::INT AS part, usr, candi_len, lb,
               least(greatest(hist_len - 3, 0), 30)::INT AS uhl FROM mr),
recs AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY key) - 1)::BIGINT AS "offset"
         FROM rec)"""

SQL["request_publish"] = REQUESTS + """
SELECT key, topic, part AS partition, "offset",
       '[[' || array_to_string(usr, ',') || ']]' AS usr_ph,
       '[[' || array_to_string(candi_len, ',') || ']]' AS candi_list_len,
       '[' || uhl::VARCHAR || ']' AS union_hist_len
FROM recs"""

SQL["request_parse"] = REQUESTS + """
SELECT key, array_to_string(usr, ',') AS usr,
       array_to_string(list_transform(lb, lambda x: array_to_string(x, ',')), '|') AS labels,
       array_to_string(candi_len, ',') AS candi_len, uhl AS union_hist_len,
       1.0::DOUBLE AS keep_prob, false AS is_train
FROM recs"""

SQL["request_quarantine"] = REQUESTS + """
SELECT 'parsed' AS kind, count(*) AS n FROM recs
UNION ALL SELECT 'quarantine', count(*) FROM recs"""

def _linear(weights, bias) -> str:
    """The linear scorer's formula; bias + t0 + t1 + ... associates left to right,
    as the scorer sums."""
    z = " + ".join(f"{w} * ((items[p.i][{f + 1}] % 97) / 97.0)" for f, w in enumerate(weights))
    return f"round(1.0 / (1.0 + exp(-({bias} + {z}))), 12)"


_FIRST = _linear((0.8, -0.5, 0.3, 0.6, -0.2, 0.4, 0.1), -0.3)
_SECOND = _linear((-0.2, 0.7, 0.1, -0.4, 0.5, 0.3, -0.6), 0.2)
SCORES = _CSPLIT + f""",
sc AS (SELECT key, (c * 10 + p.i - 1)::BIGINT AS slot,
              CASE WHEN p.i - 1 < n THEN {_FIRST} ELSE 0.0 END AS pred
       FROM pad CROSS JOIN range(1, 11) p(i))"""

SQL["batch_score"] = SCORES + "\nSELECT key, slot, round(pred, 6) AS pred FROM sc"
SQL["stream_score"] = SCORES + "\nSELECT key, slot, round(pred, 6) AS pred FROM sc"

SQL["stream_versions"] = _CSPLIT + f"""
SELECT key, (c * 10 + p.i - 1)::BIGINT AS slot,
       round(CASE WHEN p.i - 1 >= n THEN 0.0 WHEN {h60('key')} % 4 < 2 THEN {_FIRST} ELSE {_SECOND} END, 6) AS pred
FROM pad CROSS JOIN range(1, 11) p(i)"""

SQL["paced_replay"] = REQUESTS + """
SELECT key, topic, part AS partition, "offset", 1::BIGINT AS n FROM recs"""

# dense features by the ids they are made of; padding adds nothing
SQL["request_dense"] = _CSPLIT + f""",
item AS (SELECT key, string_agg({ids('items')}, '|' ORDER BY c) AS candi,
                sum(list_sum(list_transform(items, lambda f: (f[1] % 97) / 97 + (f[7] % 97) / 97))) AS item
         FROM pad GROUP BY key),
steps AS (SELECT d.key, s.i, d.hist_len, (d.hist[s.i][2] % 97) / 97 AS x, m.cate_idx
          FROM dk d CROSS JOIN LATERAL (SELECT unnest(range(1, d.hist_len + 1)) AS i) s
          LEFT JOIN cmap m ON m.cate_id = d.hist[s.i][6]),
aged AS (SELECT *, row_number() OVER (PARTITION BY key, cate_idx ORDER BY i DESC) AS age FROM steps),
hist AS (SELECT key, sum(CASE WHEN cate_idx IS NOT NULL AND age <= 20 THEN x END) AS cate,
                sum(CASE WHEN i <= hist_len - 3 THEN x END) AS uni FROM aged GROUP BY key)
SELECT key, candi, round(item, 6) AS item, round(coalesce(cate, 0), 6) AS cate,
       round(coalesce(uni, 0), 6) AS uni
FROM item LEFT JOIN hist USING (key)"""

SQL["serve_fitted"] = _CSPLIT + """
SELECT mode, sum(n)::BIGINT AS n_slots, sum(n)::BIGINT AS n_equal, sum(n)::BIGINT AS n_in_range
FROM pad CROSS JOIN (SELECT unnest(['batch', 'stream']) AS mode) GROUP BY mode"""

# ------------------------------------------------------------------ learning / selection
SQL["metrics_compare"] = f"""
WITH {SERVED},{lm_ctes("served", "slot + 1", "i_")},{lm_ctes("served", RANK_ORDER, "r_")}
SELECT k, count(*) AS n_lists, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map,
       round(avg(utility), 6) AS utility, 'rerank' AS stage FROM r_lm GROUP BY k
UNION ALL
SELECT k, count(*), round(avg(ndcg), 6), round(avg(map), 6), round(avg(utility), 6), 'initial'
FROM i_lm GROUP BY k"""

_RUNS = {"by_pred": "pred", "by_inverse_pred": "1 - pred", "by_gumbel": f"pred + {GUMBEL}"}


def _run_ctes() -> str:
    parts = []
    for name, expr in _RUNS.items():
        src = f"src_{name}"
        parts.append(f"""
{src} AS (SELECT list_id, slot, cate, label, {expr} AS pred FROM served),{lm_ctes(src, RANK_ORDER, name + "_", (5,))},
{name}_top AS (SELECT cate FROM (SELECT cate, row_number() OVER (PARTITION BY list_id
                ORDER BY pred DESC, slot) AS r FROM {src}) WHERE r <= 5),
{name}_cnt AS (SELECT c.cate, count(t.cate) AS e FROM (SELECT unnest([0, 1, 2]) AS cate) c
               LEFT JOIN {name}_top t ON c.cate = t.cate GROUP BY c.cate),
{name}_d AS (SELECT g.target AS p, e / sum(e) OVER () AS q FROM {name}_cnt
             JOIN (VALUES (0, 0.5::DOUBLE), (1, 0.4::DOUBLE), (2, 0.1::DOUBLE)) g(cate, target)
             USING (cate)),
{name}_rm AS (
  SELECT '{name}' AS run, 'ndcg@5' AS metric, avg(ndcg) AS value FROM {name}_lm
  UNION ALL SELECT '{name}', 'map@5', avg(map) FROM {name}_lm
  UNION ALL SELECT '{name}', 'js',
    0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END)
  + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) FROM {name}_d)""")
    union = " UNION ALL ".join(f"SELECT * FROM {n}_rm" for n in _RUNS)
    return ",".join(parts) + f",\nrm AS ({union})"


SQL["ranker_select"] = f"""
WITH {SERVED},{_run_ctes()}
SELECT metric, 'max' AS direction, arg_max(run, value) AS best_run, round(max(value), 6) AS best_value
FROM rm WHERE metric = 'ndcg@5' GROUP BY metric
UNION ALL
SELECT metric, 'min', arg_min(run, value), round(min(value), 6) FROM rm WHERE metric = 'js'
GROUP BY metric"""

SQL["batch_early_stop"] = BATCHED + f""",{lm_ctes("slots", RANK_ORDER, "e_", (5,))},
ev AS (SELECT b.batch AS step, b.batch // 2 AS epoch, avg(m.ndcg) AS value
       FROM e_lm m JOIN (SELECT DISTINCT list_id, batch FROM slots) b USING (list_id)
       GROUP BY b.batch),
pr AS (SELECT *, coalesce(max(value) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING
                                            AND 1 PRECEDING), 0.0) AS prev,
              row_number() OVER (ORDER BY step) AS n_evals FROM ev)
SELECT 'by_pred' AS run, step, epoch::BIGINT AS epoch, round(value, 6) AS value,
       round(greatest(prev, value), 6) AS best, n_evals::BIGINT AS n_evals,
       CASE WHEN value <= prev AND n_evals > 2 AND epoch > 40 AND prev - value > 0.08
            THEN 1 ELSE 0 END AS stop
FROM pr"""

# ------------------------------------------------------------------ scored lists
SCORED = SCORES + """,
lab AS (SELECT key, (c * 10 + p.i - 1)::BIGINT AS slot, c AS cate, lbs[p.i] AS label,
               CASE WHEN p.i - 1 < n THEN 1 ELSE 0 END AS mask
        FROM pad CROSS JOIN range(1, 11) p(i)),
ss AS (SELECT l.key AS list_id, l.slot, l.cate, s.pred, l.label, l.mask
       FROM sc s JOIN lab l ON l.key = s.key AND l.slot = s.slot)"""

_MEANS = """
SELECT k, count(*) AS n_lists, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map,
       round(avg(utility), 6) AS utility
FROM {p}lm GROUP BY k"""

SQL["scored_metrics"] = SCORED + "," + lm_ctes("ss", RANK_ORDER, "s_")[1:] + _MEANS.format(p="s_")
SQL["slot_order_metrics"] = SCORED + "," + lm_ctes("ss", "slot + 1", "s_")[1:] + _MEANS.format(p="s_")
SQL["csv_scored_metrics"] = (SCORED + "," + lm_ctes("ss", RANK_ORDER, "s_")[1:] + """
SELECT k, count(*) AS n_lists, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map,
       round(avg(utility), 6) AS utility, (SELECT count(*) FROM lab) AS n_slots
FROM s_lm GROUP BY k""").replace(IMPS, CSV_IMPS)

SQL["graded_metrics"] = f"""
WITH {SERVED},
graded AS (SELECT list_id, slot, pred, (item_id % 5)::INT AS label FROM served),""" + lm_ctes(
    "graded", RANK_ORDER, "g_") + _MEANS.format(p="g_")


def js_ctes(src: str, order: str, p: str) -> str:
    """JS divergence of the top five's categories from the target: CTE ``{p}js``."""
    return f"""
{p}top AS (SELECT cate FROM (SELECT cate, {order} AS r FROM {src}) WHERE r <= 5),
{p}cnt AS (SELECT g.cate, g.target, count(t.cate) AS e
           FROM (VALUES (0, 0.5::DOUBLE), (1, 0.4::DOUBLE), (2, 0.1::DOUBLE)) g(cate, target)
           LEFT JOIN {p}top t ON g.cate = t.cate GROUP BY g.cate, g.target),
{p}d AS (SELECT target AS p, e / sum(e) OVER () AS q FROM {p}cnt),
{p}js AS (SELECT 0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END)
               + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) AS js FROM {p}d)"""


SQL["scored_exposure_js"] = SCORED + "," + js_ctes("ss", RANK_ORDER, "r_") + "," + js_ctes("ss", "slot + 1", "i_") + """
SELECT 'rerank' AS stage, round(js, 6) AS js FROM r_js UNION ALL SELECT 'initial', round(js, 6) FROM i_js"""

# every positive against every negative, by score
_MASKED_PAIRS = """,
pp AS (SELECT pred, count(*) AS c FROM ss WHERE mask = 1 AND label >= 1 GROUP BY pred),
nn AS (SELECT pred, count(*) AS c FROM ss WHERE mask = 1 AND label < 1 GROUP BY pred),
tot AS (SELECT (SELECT sum(c) FROM pp) * (SELECT sum(c) FROM nn) AS pairs)"""
SQL["scored_auc"] = SCORED + _MASKED_PAIRS + """
SELECT round((SELECT sum(p.c * n.c * CASE WHEN n.pred = p.pred THEN 0.5 ELSE 1 END)
              FROM pp p JOIN nn n ON n.pred <= p.pred) / (SELECT pairs FROM tot), 6) AS auc"""
SQL["scored_auc_binned"] = SCORED + _MASKED_PAIRS + """,
pb AS (SELECT least(floor(pred * 64), 63) AS b, sum(c) AS c FROM pp GROUP BY b),
nb AS (SELECT least(floor(pred * 64), 63) AS b, sum(c) AS c FROM nn GROUP BY b),
w AS (SELECT (SELECT sum(p.c * n.c) FROM pb p JOIN nb n ON n.b < p.b) / pairs AS won,
             (SELECT sum(p.c * n.c) FROM pb p JOIN nb n ON n.b = p.b) / pairs AS opened FROM tot)
SELECT round(coalesce(won, 0), 6) AS auc_low, round(coalesce(won, 0) + 0.5 * coalesce(opened, 0), 6) AS auc,
       round(coalesce(won, 0) + coalesce(opened, 0), 6) AS auc_high, round(0.5 * coalesce(opened, 0), 6) AS error,
       1 AS inside
FROM w"""

SQL["log_loss_slots"] = SCORED + """
SELECT round(-avg(label * ln(pred + 1e-7) + (1 - label) * ln(1 - pred + 1e-7))
             FILTER (WHERE mask = 1), 6) AS masked,
       round(-avg(label * ln(pred + 1e-7) + (1 - label) * ln(1 - pred + 1e-7)), 6) AS unmasked
FROM ss"""

# ------------------------------------------------------------------ training runs
_RATES = {"rate_1": 1.0, "rate_03": 0.3}
_EVALS, _BETWEEN = 2, 2


def _gradient_run(run: str, rate: float) -> str:
    """Weights w<k> after k steps of gradient descent on the mean log loss, and the
    evaluation of every second step."""
    pred = lambda k: "1 / (1 + exp(-(b.b" + "".join(
        f" + coalesce(w{f}.w, 0)" for f in range(7)) + ")))"
    joins = lambda k: f"CROSS JOIN (SELECT coalesce(sum(w), 0) AS b FROM {run}_w{k} WHERE field = -1) b" + "".join(
        f"\n  LEFT JOIN {run}_w{k} w{f} ON w{f}.field = {f} AND w{f}.id = x.f{f}" for f in range(7))
    out = [f"{run}_w0 AS (SELECT 0 AS field, 0::BIGINT AS id, 0.0::DOUBLE AS w WHERE false)"]
    for k in range(_EVALS * _BETWEEN):
        moves = "\n  UNION ALL ".join(f"SELECT {f}, f{f}, sum(g) FROM {run}_g{k} GROUP BY f{f}" for f in range(7))
        out.append(f"""
{run}_g{k} AS MATERIALIZED (SELECT x.*, {pred(k)} - x.label AS g FROM tr x {joins(k)}),
{run}_w{k + 1} AS MATERIALIZED (
  SELECT field, id, sum(w) AS w FROM (
    SELECT field, id, w FROM {run}_w{k}
    UNION ALL SELECT field, id, -{rate}::DOUBLE * g / (SELECT count(*) FROM tr) FROM (
      SELECT -1 AS field, 0::BIGINT AS id, sum(g) AS g FROM {run}_g{k}
  UNION ALL {moves}))
  GROUP BY field, id)""")
    for e in range(_EVALS + 1):
        k, p = e * _BETWEEN, f"{run}_{e}_"
        out.append(f"""
{p}src AS MATERIALIZED (
  SELECT x.split, x.list_id AS own, x.split || ':' || x.list_id AS list_id, x.slot, x.cate, x.label,
         round({pred(k)}, 10) AS pred FROM te x {joins(k)}),{lm_ctes(p + "src", RANK_ORDER, p, (5,))},{js_ctes(p + "src", RANK_ORDER, p)},
{p}byp AS (SELECT pred, sum(label) AS pc, sum(1 - label) AS nc FROM {p}src GROUP BY pred),
{p}auc AS (SELECT sum(pc * (below + 0.5 * nc)) / (sum(pc) * sum(nc)) AS auc FROM (
             SELECT *, coalesce(sum(nc) OVER (ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS below FROM {p}byp)),
{p}rl AS (
  SELECT '{run}' AS run, {k}::BIGINT AS step, {e}::BIGINT AS epoch, metric, value FROM (
    SELECT 'ndcg@5' AS metric, avg(ndcg) AS value FROM {p}lm UNION ALL SELECT 'map@5', avg(map) FROM {p}lm
    UNION ALL SELECT 'js', js FROM {p}js UNION ALL SELECT 'auc', auc FROM {p}auc
    UNION ALL SELECT 'log_loss', -avg(label * ln(pred + 1e-7) + (1 - label) * ln(1 - pred + 1e-7)) FROM {p}src)),
{p}out AS (SELECT DISTINCT '{run}' AS run, {k}::BIGINT AS step, s.split, s.own AS list_id, m.k, m.ndcg, m.map, m.utility
           FROM {p}lm m JOIN {p}src s USING (list_id))""")
    return ",\n".join(out)


_STEPS = [f"{r}_{e}_" for r in _RATES for e in range(_EVALS + 1)]
TRAINED = DATASET + """,
sl AS MATERIALIZED (
  SELECT d.split, d.list_id, s.i - 1 AS slot, d.labels[s.i] AS label, m.cate_idx AS cate,
         d.candi[s.i][1] AS f0, d.candi[s.i][2] AS f1, d.candi[s.i][3] AS f2, d.candi[s.i][4] AS f3,
         d.candi[s.i][5] AS f4, d.candi[s.i][6] AS f5, d.candi[s.i][7] AS f6
  FROM ds d CROSS JOIN LATERAL (SELECT unnest(range(1, len(d.candi) + 1)) AS i) s
  JOIN cmap m ON m.cate_id = d.candi[s.i][6]),
tr AS MATERIALIZED (SELECT * FROM sl WHERE split = 'train'),
te AS MATERIALIZED (SELECT * FROM sl WHERE split = 'test'),
""" + ",\n".join(_gradient_run(r, rate) for r, rate in _RATES.items()) + """,
rl AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT * FROM {p}rl" for p in _STEPS) + """),
mon AS (SELECT run, step, value, max(value) OVER (PARTITION BY run ORDER BY step
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM rl WHERE metric = 'ndcg@5')"""

SQL["run_log"] = TRAINED + "\nSELECT run, step, epoch, metric, round(value, 6) AS value FROM rl"
SQL["run_list_metrics"] = TRAINED + """
SELECT o.run, o.step, split, list_id, k, round(ndcg, 6) AS ndcg, round(map, 6) AS map, round(utility, 6) AS utility
FROM (""" + " UNION ALL ".join(f"SELECT * FROM {p}out" for p in _STEPS) + """) o
JOIN mon ON mon.run = o.run AND mon.step = o.step WHERE prev IS NULL OR value > prev"""
_PICK = """
SELECT metric, '{d}' AS direction, run AS best_run, step AS best_step, round(value, 6) AS best_value FROM (
  SELECT * FROM rl WHERE metric = '{m}' ORDER BY value {o}, run, step LIMIT 1)"""
SQL["best_run"] = TRAINED + " UNION ALL ".join(
    _PICK.format(m=m, d=d, o="DESC" if d == "max" else "ASC")
    for m, d in (("ndcg@5", "max"), ("js", "min"), ("log_loss", "min")))
_STOP = """
SELECT '{m}' AS metric, run, step, epoch, round({s}v, 6) AS value, round({s}greatest(coalesce(prev, v), v), 6) AS best, n_evals,
       CASE WHEN v <= prev AND n_evals > 1 AND epoch > 0 AND prev - v > 0.001 THEN 1 ELSE 0 END AS stop
FROM (SELECT *, {z} AS prev FROM (
  SELECT run, step, epoch, {s}value AS v, max({s}value) OVER w AS before,
         (row_number() OVER (PARTITION BY run ORDER BY step))::BIGINT AS n_evals
  FROM rl WHERE metric = '{m}'
  WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
SQL["early_stop"] = TRAINED + " UNION ALL ".join([
    _STOP.format(m="ndcg@5", s="", z="coalesce(before, 0.0)"), _STOP.format(m="js", s="-", z="before")])

SQL["union_history_reversed"] = DATASET + f""",
u AS (SELECT list_id, hist_len AS n, list_reverse(hist[1:hist_len]) AS st FROM ds)
SELECT list_id,
       {ids(f"(CASE WHEN n >= 30 THEN st[1:30] ELSE st || list_transform(range(30 - n), lambda i: {_Z6}) END)")}
         AS union_hist,
       least(n, 30)::INT AS union_hist_len
FROM u"""

# The same results by another way through the operators.
SQL["staged_reuse"] = SQL["sink_parquet_roundtrip"]
SQL["job_rerank"] = SQL["rerank"]
SQL["request_parse_unbatched"] = SQL["request_parse"]
SQL["batch_replay"] = SQL["batch_score"]
