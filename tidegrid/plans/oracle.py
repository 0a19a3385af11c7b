"""DuckDB SQL for the rows of plans.catalog."""

from __future__ import annotations

import math

from tidegrid.config import ALPHAS, PHONE_CLASSES, STOP_LEMMAS

_INTERVALS = """iv AS (SELECT user_id AS story, CAST(row_number() OVER w AS BIGINT) AS ord, event_type, value, h AS t0,
  least(COALESCE(lead(h) OVER w, h + 6), h + 6) AS t1
  FROM (SELECT *, (epoch_us(ts) / 1000000.0::DOUBLE - 1704067200) / 3600.0::DOUBLE AS h FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY h, event_id))"""
_GRID = _INTERVALS + """, sz AS (SELECT story, CAST(ceil(max(t1)) AS BIGINT) AS n FROM iv GROUP BY story),
  cell AS (SELECT iv.*, CAST(floor(t0) AS BIGINT) AS s, least(CAST(ceil(t1) AS BIGINT), n) AS e FROM iv JOIN sz USING (story)),
  smp AS (SELECT story, unnest(range(0, n)) AS k FROM sz)"""
_OWN = """own AS (SELECT story, k, max(ord) AS ord FROM (SELECT story, ord, unnest(range(s, e)) AS k FROM cell {where}) GROUP BY story, k)"""
_DOCS = r"""tk AS (SELECT doc, lang, source, pos, token FROM (SELECT doc_id AS doc, lang, source, unnest(l) AS token, unnest(range(0, len(l))) AS pos
  FROM (SELECT *, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS l FROM documents WHERE text IS NOT NULL)) WHERE token <> '')"""
_CLEAN = "lower(regexp_replace({}, '[^a-zA-Z'']', '', 'g'))"
_NOISE = r"regexp_matches(trim({}), '(?i)[\[\]{{}}<>]|spn|^(sp|sil|br|lg)$')"
_TRANSCRIPT = _INTERVALS + """, tr AS (SELECT story, ord, event_type, event_type IN ('click', 'view') AS pause, CASE WHEN event_type IN ('click', 'view') THEN (CAST(ord AS DOUBLE) + value / 100) - CAST(ord AS DOUBLE) END AS d FROM iv),
  nth AS (SELECT *, sum(CAST(NOT pause AS INT)) OVER (PARTITION BY story ORDER BY ord) AS nth FROM tr),
  gp AS (SELECT *, max(d) OVER (PARTITION BY story, nth) AS gap FROM nth),
  pw AS (SELECT story, ord, event_type AS word, CASE WHEN gap >= 0.65::DOUBLE THEN '.' WHEN gap >= 0.35::DOUBLE THEN ',' ELSE '' END AS mark FROM gp WHERE NOT pause)"""
_OFFSETS = ", ofs AS (SELECT story, ord, word, mark, CAST(COALESCE(sum(length(word) + length(mark) + 1) OVER (PARTITION BY story ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM pw)"
_HOURLY = _INTERVALS + """, hc AS (SELECT story, CAST(floor(t0) AS BIGINT) AS k, count(*) AS n FROM iv GROUP BY ALL),
  hr AS (SELECT g.story, g.k, COALESCE(n, 0) AS n FROM (SELECT story, unnest(range(0, max(k) + 1)) AS k FROM hc GROUP BY story) g LEFT JOIN hc USING (story, k))"""
_LONG = "lg AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(range(0, 64)) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_PRED = _LONG + """, ml AS (SELECT label, t, avg(v) AS f FROM lg GROUP BY ALL), ma AS (SELECT t, avg(v) AS l FROM lg GROUP BY t),
  pr AS (SELECT vec_id, label, t, v, f, l FROM lg JOIN ml USING (label, t) JOIN ma USING (t)),
  r2 AS (SELECT vec_id, label, 1 - sum((v - f) * (v - f)) / (count(*) * var_pop(v)) AS rg, 1 - sum((v - l) * (v - l)) / (count(*) * var_pop(v)) AS rr FROM pr GROUP BY ALL)"""
_NULL = _PRED + """, nu AS (SELECT a.vec_id, s, round((sum((a.v - b.l) * (a.v - b.l)) - sum((a.v - b.f) * (a.v - b.f))) / (count(*) * var_pop(a.v)), 9) AS delta
    FROM pr a, range(10, 54) sh(s), pr b WHERE b.vec_id = a.vec_id AND b.t = (a.t - s + 64) % 64 GROUP BY a.vec_id, s),
  ob AS (SELECT vec_id, label, rg AS r2_global, rr AS r2_restricted, round(rg - rr, 9) AS obs FROM r2),
  pv AS (SELECT vec_id, any_value(label) AS label, any_value(r2_global) AS r2_global, any_value(r2_restricted) AS r2_restricted, any_value(obs) AS delta, count(*) AS n_shifts, count(*) FILTER (s BETWEEN 16 AND 48) AS n_shifts_sensitivity,
    round((count(*) FILTER (delta >= obs) + 1)::DOUBLE / (count(*) + 1), 9) AS p_value, round((count(*) FILTER (delta >= obs AND s BETWEEN 16 AND 48) + 1)::DOUBLE / (count(*) FILTER (s BETWEEN 16 AND 48) + 1), 9) AS p_value_sensitivity FROM nu JOIN ob USING (vec_id) GROUP BY vec_id)"""


def _bh(source: str, p: str, name: str) -> str:
    return f"""(SELECT *, least(1.0, min(q_) OVER (PARTITION BY label ORDER BY {p} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {name} FROM
      (SELECT *, {p} * count(*) OVER (PARTITION BY label) / count(*) OVER (PARTITION BY label ORDER BY {p}) AS q_ FROM {source}))"""


_CEIL = """ce AS (SELECT label, CASE WHEN max(r) >= 2 AND var_pop(m) > 0 THEN least(1.0, greatest(0.0, var_pop(m) - avg(w) * max(r) / (max(r) - 1) / max(r)) / var_pop(m)) END AS ceiling
    FROM (SELECT label, t, avg(v) AS m, var_pop(v) AS w, count(v) AS r FROM lg GROUP BY ALL) GROUP BY label)"""
_RESULTS = f"""{_NULL}, {_CEIL}, f1 AS {_bh("pv", "p_value", "p_value_fdr")}, f2 AS {_bh("(SELECT * EXCLUDE (q_) FROM f1)", "p_value_sensitivity", "p_value_fdr_sensitivity")},
  rs AS (SELECT *, delta AS delta_r2, CASE WHEN ceiling > 0.01 THEN r2_global / ceiling END AS rn, CASE WHEN ceiling > 0.01 THEN r2_global / ceiling - r2_restricted / ceiling END AS dn FROM f2 JOIN ce USING (label)),
  mt AS (SELECT label, count(*) AS total, median(r2_global) AS r2_global_median, max(r2_global) AS r2_global_max, avg((r2_global > 0)::INT) * 100 AS r2_global_positive_pct, median(delta_r2) AS delta_median,
    quantile_cont(delta_r2, 0.75) - quantile_cont(delta_r2, 0.25) AS delta_iqr, quantile_cont(delta_r2, 0.05) AS delta_p5, quantile_cont(delta_r2, 0.95) AS delta_p95, avg((delta_r2 > 0)::INT) * 100 AS delta_positive_pct,
    avg((p_value_fdr < 0.05)::INT) * 100 AS sig_pct, avg((dn IS NOT NULL)::INT) * 100 AS ceiling_pct, avg((p_value_fdr_sensitivity < 0.05)::INT) * 100 AS sig_sensitivity_pct, count(*) FILTER (p_value_fdr < 0.05) AS sig_count,
    count(*) FILTER (p_value_fdr_sensitivity < 0.05) AS sig_sensitivity_count, COALESCE(printf('%.5f', avg(delta_r2) FILTER (p_value_fdr < 0.05)), 'N/A') AS sig_delta_mean,
    COALESCE(printf('%.5f', median(delta_r2) FILTER (p_value_fdr < 0.05)), 'N/A') AS sig_delta_median, COALESCE(printf('%.5f', max(delta_r2) FILTER (p_value_fdr < 0.05)), 'N/A') AS sig_delta_max, min(delta_r2) AS delta_min, max(delta_r2) AS delta_max,
    COALESCE(printf('%.5f', median(rn) FILTER (dn IS NOT NULL)), 'N/A') AS r2_global_normalized_median, COALESCE(printf('%.5f', median(dn)), 'N/A') AS delta_normalized_median, COALESCE(printf('%.5f', quantile_cont(dn, 0.95)), 'N/A') AS delta_normalized_p95, COALESCE(printf('%.5f', avg(dn) FILTER (p_value_fdr < 0.05)), 'N/A') AS sig_delta_normalized_mean,
    max(n_shifts) AS n_exhaustive_shifts, max(1.0::DOUBLE / (n_shifts + 1)) AS p_resolution_min, max(n_shifts_sensitivity) AS n_far, max(1.0::DOUBLE / (n_shifts_sensitivity + 1)) AS p_far,
    COALESCE(printf('%.2f', count(*) FILTER (p_value_fdr < 0.05 AND p_value_fdr_sensitivity < 0.05) * 100.0::DOUBLE / nullif(count(*) FILTER (p_value_fdr < 0.05), 0)), 'N/A') AS sensitivity_stability_pct FROM rs GROUP BY label)"""


def _rounded(names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) + 0.0 AS {n}" for n in names.split())


_PHONES = ", ".join(f"sum(CAST(ph IN ({', '.join(repr(x) for x in PHONE_CLASSES[c].split())}) AS INT) * n)::BIGINT AS {c}" for c in PHONE_CLASSES)
_TERMS = _DOCS + f", te AS (SELECT doc, source, term FROM (SELECT doc, source, {_CLEAN.format('token')} AS term FROM tk) WHERE length(term) > 1)"


def _said(level: str = "0.05") -> str:
    """A participant's section, from mt."""
    f = lambda c, n: f"printf('%.{n}f', round({c}, {n}))"
    n = lambda c: f"format('{{:,}}', {c})"
    lines = [
        "'### ' || label || chr(10)",
        f"'- Targets: ' || {n('total')}",
        f"'- Full model: median R2 ' || {f('r2_global_median', 4)} || ', largest R2 ' || {f('r2_global_max', 4)} || ', above zero in ' || {f('r2_global_positive_pct', 2)} || '% of targets'",
        f"'- Gain over the controls, all targets: median ' || {f('delta_median', 5)} || ', interquartile range ' || {f('delta_iqr', 5)} || ', 5th percentile ' || {f('delta_p5', 5)} || ', 95th ' || {f('delta_p95', 5)} || ', from ' || {f('delta_min', 5)} || ' to ' || {f('delta_max', 5)} || ', above zero in ' || {f('delta_positive_pct', 2)} || '%'",
        f"'- Significant (q < {level}): ' || {n('sig_count')} || ' targets (' || {f('sig_pct', 2)} || '%)'",
        "CASE WHEN sig_count > 0 THEN '  - their gain: mean ' || sig_delta_mean || ', median ' || sig_delta_median || ', largest ' || sig_delta_max ELSE '  - their gain: N/A, no target passed the corrected level' END",
        f"'  - resolution: ' || {n('n_exhaustive_shifts')} || ' shifts, smallest p ' || {f('p_resolution_min', 5)}",
        f"CASE WHEN ceiling_pct > 0 THEN '- Against the noise ceiling (estimable in ' || {f('ceiling_pct', 2)} || '% of targets): median R2 ' || r2_global_normalized_median || ', median gain ' || delta_normalized_median || ', 95th percentile of gain ' || delta_normalized_p95 || ', mean gain where significant ' || sig_delta_normalized_mean ELSE '- Against the noise ceiling: N/A, no target has repeats that agree' END",
        f"'- With the larger margin (' || {n('n_far')} || ' shifts, smallest p ' || {f('p_far', 5)} || '): ' || {n('sig_sensitivity_count')} || ' significant targets (' || {f('sig_sensitivity_pct', 2)} || '%)' || CASE WHEN sig_count > 0 THEN ', which keep ' || sensitivity_stability_pct || '% of those above' ELSE '' END",
    ]
    return f"concat_ws(chr(10), {', '.join(lines)})"


def _document() -> str:
    f = lambda c, n: f"printf('%.{n}f', round(avg({c}), {n}))"
    return f"""concat_ws(chr(10) || chr(10), '# Report', '## Each participant', string_agg({_said()}, chr(10) || chr(10) ORDER BY label), concat_ws(chr(10), '## All participants' || chr(10),
      '- Significant targets (q < 0.05) in ' || count(*) FILTER (sig_count > 0) || ' of ' || count(*), '- Full model: mean of medians R2 ' || {f('r2_global_median', 4)} || ', above zero in ' || {f('r2_global_positive_pct', 2)} || '% of targets on average',
      '- Gain: mean of medians ' || {f('delta_median', 5)} || ', above zero in ' || {f('delta_positive_pct', 2)} || '% of targets on average', '- Noise ceiling estimable in ' || {f('ceiling_pct', 2)} || '% of targets on average', '- Significant with the larger margin: ' || {f('sig_sensitivity_pct', 2)} || '% of targets on average'))"""


def _ridge() -> str:
    """Closed form of two features, by folds of keys; the penalty of the best mean score, refitted on all."""
    names = ["xx", "xz", "zz", "xy", "zy", "yy"]
    sums = ", ".join(f"sum({n[0]} * {n[1]}) AS {n}" for n in names)
    rest = ", ".join(f"sum({n}) OVER (PARTITION BY target) - {n} AS r_{n}, sum({n}) OVER (PARTITION BY target) AS t_{n}" for n in names)
    det = lambda p: f"(({p}_xx + a) * ({p}_zz + a) - {p}_xz * {p}_xz)"
    on_x = lambda p: f"(({p}_zz + a) * {p}_xy - {p}_xz * {p}_zy) / {det(p)}"
    on_z = lambda p: f"(({p}_xx + a) * {p}_zy - {p}_xz * {p}_xy) / {det(p)}"
    return f"""WITH b AS (SELECT o_orderkey % 3 AS fold, CAST(o_orderkey % 97 - 48 AS DOUBLE) AS x, CAST(o_custkey % 13 - 6 AS DOUBLE) AS z, unnest([o_totalprice / 100000 - 2.5::DOUBLE, o_orderkey % 89 / 10.0::DOUBLE - 4]) AS y, unnest([0, 1]) AS target FROM orders),
    s AS (SELECT target, fold, {sums} FROM b GROUP BY ALL), r AS (SELECT *, {rest} FROM s), f AS (SELECT *, {on_x('r')} AS w, {on_z('r')} AS v, {on_x('t')} AS tw, {on_z('t')} AS tv FROM r, (VALUES (100.0::DOUBLE), (1e5), (1e8)) p(a)),
    c AS (SELECT target, a, avg(1 - (yy - 2 * (w * xy + v * zy) + w * w * xx + 2 * w * v * xz + v * v * zz) / yy) AS score, any_value(tw) AS tw, any_value(tv) AS tv FROM f GROUP BY ALL)
    SELECT target::BIGINT AS target, a AS alpha, round(score, 6) + 0.0 AS score, round(tw, 6) + 0.0 AS w_x, round(tv, 6) + 0.0 AS w_z FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, a) AS i FROM c) WHERE i = 1"""


def _encoder() -> str:
    """Assembly, two ridge fits in closed form, shift null, false-discovery rate and ceiling."""
    scaled = lambda c, over: f"({c} - avg({c}) OVER {over}) / CASE WHEN stddev_pop({c}) OVER {over} = 0 THEN 1 ELSE stddev_pop({c}) OVER {over} END"
    names = ("xx", "xz", "zz", "xy", "zy", "yy")
    alphas = ", ".join(f"({a!r}::DOUBLE)" for a in ALPHAS)
    det = lambda p: f"(({p}_xx + a) * ({p}_zz + a) - {p}_xz * {p}_xz)"
    both = lambda p: (f"(({p}_zz + a) * {p}_xy - {p}_xz * {p}_zy) / {det(p)}", f"(({p}_xx + a) * {p}_zy - {p}_xz * {p}_xy) / {det(p)}")
    one = lambda p: (f"{p}_xy / ({p}_xx + a)", "0::DOUBLE")

    def best(form) -> str:
        (w, v), (tw, tv) = form("r"), form("t")
        return f"""(SELECT t, w, v FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, a) AS i FROM (SELECT t, a, avg(1 - (yy - 2 * (w * xy + v * zy) + w * w * xx + 2 * w * v * xz + v * v * zz) / yy) AS score, any_value(tw) AS w, any_value(tv) AS v
          FROM (SELECT *, {w} AS w, {v} AS v, {tw} AS tw, {tv} AS tv FROM sm, (VALUES {alphas}) al(a)) GROUP BY ALL)) WHERE i = 1)"""

    bh = lambda source, p, name: f"""(SELECT *, CASE WHEN {p} IS NOT NULL THEN least(1.0, min(q_) OVER (ORDER BY {p} DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {name}
      FROM (SELECT *, {p} * count({p}) OVER () / count({p}) OVER (ORDER BY {p} NULLS LAST) AS q_ FROM {source}))"""  # noqa: E731
    columns = "r2_global r2_restricted delta_r2_tense p_value_raw p_value_fdr p_resolution_min r2_noise_ceiling r2_global_normalized r2_restricted_normalized delta_r2_tense_normalized p_value_raw_sensitivity p_value_fdr_sensitivity p_resolution_min_sensitivity"
    return f"""WITH RECURSIVE e AS (SELECT label, vec_id % 2 AS s, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS j, embedding FROM embeddings),
    ser AS (SELECT label, j, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS z FROM e WHERE s = 0),
    bold AS (SELECT s, label, j, unnest(range(0, 8)) AS t, CAST(unnest(embedding[57:64]) AS DOUBLE) AS y FROM e),
    px AS (SELECT s, label, j, x, z FROM e JOIN ser USING (label, j)), py AS (SELECT s, label, j, t, y FROM bold SEMI JOIN ser USING (label, j)),
    zx AS (SELECT s, label, j, {scaled('x', 'w')} AS x, {scaled('z', 'w')} AS z FROM px WINDOW w AS (PARTITION BY s, label)), zy AS (SELECT s, label, j, t, {scaled('y', 'w')} AS y FROM py WINDOW w AS (PARTITION BY s, label, t)),
    sz AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS i FROM zx WHERE label <> 9 GROUP BY label),
    fo AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, -1 AS label, 0 AS fold UNION ALL
      SELECT i, a + CASE WHEN f = 0 THEN n ELSE 0 END, b + CASE WHEN f = 1 THEN n ELSE 0 END, c + CASE WHEN f = 2 THEN n ELSE 0 END, label, f FROM (SELECT sz.i, a, b, c, sz.label, n, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS f FROM fo JOIN sz ON sz.i = fo.i + 1)),
    pr AS (SELECT fold, t, x, z, y FROM zx JOIN zy USING (s, label, j) JOIN fo USING (label)), su AS (SELECT t, fold, {', '.join(f'sum({n[0]} * {n[1]}) AS {n}' for n in names)} FROM pr GROUP BY ALL),
    sm AS (SELECT *, {', '.join(f'sum({n}) OVER (PARTITION BY t) - {n} AS r_{n}, sum({n}) OVER (PARTITION BY t) AS t_{n}' for n in names)} FROM su),
    fu AS {best(both)}, le AS {best(one)}, ln AS (SELECT min(n) AS n FROM (SELECT s, max(j) + 1 AS n FROM zx WHERE label = 9 GROUP BY s)),
    rp AS (SELECT s, j, t, y FROM zy, ln WHERE label = 9 AND j < n), yt AS (SELECT j, t, avg(y) AS y FROM rp GROUP BY ALL),
    te AS (SELECT yt.t, yt.j, yt.y, fu.w * x + fu.v * z AS f, le.w * x AS l FROM yt JOIN zx ON zx.label = 9 AND zx.s = 0 AND zx.j = yt.j JOIN fu ON fu.t = yt.t JOIN le ON le.t = yt.t),
    ob AS (SELECT t, 1 - sum((y - f) ** 2) / (count(*) * var_pop(y)) AS rg, 1 - sum((y - l) ** 2) / (count(*) * var_pop(y)) AS rr FROM te GROUP BY t),
    nu AS (SELECT a.t, s, any_value(n) AS n, (sum((a.y - b.l) ** 2) - sum((a.y - b.f) ** 2)) / (count(*) * var_pop(a.y)) AS d FROM te a, ln, range(5, 200) sh(s), te b WHERE s <= n - 6 AND b.t = a.t AND b.j = (a.j - s + n) % n GROUP BY a.t, s),
    pv AS (SELECT t, any_value(rg) AS r2_global, any_value(rr) AS r2_restricted, any_value(rg - rr) AS delta_r2_tense, count(*) AS n_exhaustive_shifts, count(*) FILTER (s BETWEEN 16 AND n - 16) AS n_exhaustive_shifts_sensitivity, (count(*) FILTER (d >= rg - rr) + 1)::DOUBLE / (count(*) + 1) AS p_value_raw,
      CASE WHEN count(*) FILTER (s BETWEEN 16 AND n - 16) > 0 THEN (count(*) FILTER (d >= rg - rr AND s BETWEEN 16 AND n - 16) + 1)::DOUBLE / (count(*) FILTER (s BETWEEN 16 AND n - 16) + 1) END AS p_value_raw_sensitivity FROM nu JOIN ob USING (t) GROUP BY t),
    ce AS (SELECT t, CASE WHEN max(r) >= 2 AND var_pop(m) > 0 THEN least(1.0, greatest(0.0, var_pop(m) - avg(w) * max(r) / (max(r) - 1) / max(r)) / var_pop(m)) END AS c FROM (SELECT t, j, avg(y) AS m, var_pop(y) AS w, count(*) AS r FROM rp GROUP BY ALL) GROUP BY t),
    f1 AS {bh('pv', 'p_value_raw', 'p_value_fdr')}, f2 AS {bh('(SELECT * EXCLUDE (q_) FROM f1)', 'p_value_raw_sensitivity', 'p_value_fdr_sensitivity')},
    al AS (SELECT *, c AS r2_noise_ceiling, CASE WHEN c > 0.01 THEN r2_global / c END AS r2_global_normalized, CASE WHEN c > 0.01 THEN r2_restricted / c END AS r2_restricted_normalized, CASE WHEN c > 0.01 THEN r2_global / c - r2_restricted / c END AS delta_r2_tense_normalized,
      1.0::DOUBLE / (n_exhaustive_shifts + 1) AS p_resolution_min, CASE WHEN n_exhaustive_shifts_sensitivity > 0 THEN 1.0::DOUBLE / (n_exhaustive_shifts_sensitivity + 1) END AS p_resolution_min_sensitivity FROM f2 JOIN ce USING (t))
    SELECT t::BIGINT AS voxel_idx, {_rounded(columns, 3)}, n_exhaustive_shifts, n_exhaustive_shifts_sensitivity FROM al"""


def _kernel(rate: str) -> str:
    """kr(d, h): the double gamma of 32 s at so many samples a second."""
    return f"""kg AS (SELECT i AS d, i / {rate}::DOUBLE AS t FROM range(0, 32 * {rate}) r(i)), ku AS (SELECT d, t ** 5 * exp(-t) / {math.factorial(5)} - t ** 15 * exp(-t) / {math.factorial(15)} / 6 AS h FROM kg), kr AS (SELECT d, h / sum(h) OVER () AS h FROM ku)"""


def _low_pass(down: int) -> str:
    """lp(m, h): a sinc under a Kaiser window (Bessel's I0 by its series) of 20 * down + 1 taps."""
    half = 10 * down
    return f"""ls AS (SELECT m, (m - {half}) / {down}::DOUBLE AS u, 2.5::DOUBLE * sqrt(greatest(0, 1 - ((m - {half}) / {half}::DOUBLE) ** 2)) AS z FROM range(0, {2 * half + 1}) r(m)),
    lb AS (SELECT m, any_value(u) AS u, sum(CASE WHEN i = 0 THEN 1 ELSE z ** (2 * i) / gamma(i + 1.0) ** 2 END) AS w FROM ls, range(0, 40) s(i) GROUP BY m),
    lw AS (SELECT m, w * CASE WHEN u = 0 THEN 1 ELSE sin(pi() * u) / (pi() * u) END AS h FROM lb), lp AS (SELECT m, h / sum(h) OVER () AS h FROM lw)"""


_GRIDS = _INTERVALS + """, gr AS (SELECT story, round(t0, 4) AS a, round(t1, 4) AS b FROM iv WHERE story % 5 <> 4)"""
_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


ORACLES = {
    "grid_projection": f"WITH {_GRID}, {_OWN.format(where='WHERE e > s')} SELECT smp.story, smp.k, round(COALESCE(value, 0), 6) + 0.0 AS value FROM smp LEFT JOIN own USING (story, k) LEFT JOIN iv ON iv.story = own.story AND iv.ord = own.ord",
    "grid_runs": f"""WITH {_GRID}, {_OWN.format(where='WHERE e > s')}, st AS (SELECT smp.story, smp.k, CAST(COALESCE(event_type = 'purchase', false) AS INT) AS state FROM smp LEFT JOIN own USING (story, k) LEFT JOIN iv ON iv.story = own.story AND iv.ord = own.ord),
      nw AS (SELECT *, k - row_number() OVER (PARTITION BY story, state ORDER BY k) AS g FROM st) SELECT story, state, min(k) AS a, max(k) + 1 AS b FROM nw GROUP BY story, state, g""",
    "grid_onehot_features": f"""WITH {_GRID}, {_OWN.format(where="WHERE e > s AND event_type IN ('click', 'error', 'purchase')")} SELECT smp.story, smp.k, {', '.join(f"CAST(COALESCE(event_type = '{k}', false) AS BIGINT) AS is_{k}" for k in ('click', 'error', 'purchase'))}
      FROM smp LEFT JOIN own USING (story, k) LEFT JOIN iv ON iv.story = own.story AND iv.ord = own.ord""",
    "audit_subject_counts": "SELECT c_custkey, count(o_orderstatus) AS total_sessions, count(DISTINCT o_orderstatus) AS unique_items, round(sum(o_totalprice), 2) AS total_sec, round(sum(o_totalprice) / 60, 4) AS total_min FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "audit_story_counts": "SELECT o_orderpriority, count(o_custkey) AS total_plays, count(DISTINCT o_custkey) AS unique_listeners, max(o_totalprice) AS duration_sec FROM orders GROUP BY o_orderpriority",
    "coverage_left_join": "SELECT c_custkey, COALESCE(n, 0) AS presentations, l AS status_list FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS l FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON c_custkey = o_custkey",
    "pause_statistics": f"""WITH {_INTERVALS}, g AS (SELECT event_type, lead(t0) OVER (PARTITION BY story ORDER BY ord) - t0 AS gap FROM iv)
      SELECT event_type, count(*) AS n, round(avg(gap), 6) AS mean, round(min(gap), 6) AS min, round(quantile_cont(gap, 0.25), 6) AS p25, round(median(gap), 6) AS median, round(quantile_cont(gap, 0.75), 6) AS p75, round(max(gap), 6) AS max FROM g WHERE gap IS NOT NULL GROUP BY event_type""",
    "token_inventory": f"WITH {_DOCS} SELECT lower(token) AS token, count(*) AS n FROM tk GROUP BY 1 ORDER BY n DESC, token LIMIT 50",
    "chunk_describe": f"""WITH {_DOCS}, c AS (SELECT source, doc, COALESCE(sum(CAST(regexp_matches(token, '[.!?]$') AS INT)) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clause FROM tk),
      n AS (SELECT source, doc, clause, count(*) AS words FROM c GROUP BY ALL) SELECT source, count(*) AS n, round(avg(words), 6) AS mean, round(stddev_samp(words), 6) AS std, CAST(min(words) AS DOUBLE) AS min, round(quantile_cont(words, 0.25), 6) AS p25, round(median(words), 6) AS median, round(quantile_cont(words, 0.75), 6) AS p75, CAST(max(words) AS DOUBLE) AS max FROM n GROUP BY source""",
    "noise_and_clean_tokens": f"""WITH {_DOCS}, x AS (SELECT source, {_NOISE.format('token')} AS noise, {_CLEAN.format('token')} AS word FROM tk)
      SELECT source, count(*) AS tokens, count(*) FILTER (noise) AS noise_tokens, count(*) FILTER (NOT noise AND word <> '') AS words, count(*) FILTER (NOT noise AND word = '') AS neither, CAST(sum(length(word)) FILTER (NOT noise) AS BIGINT) AS letters FROM x GROUP BY source""",
    "url_field_extract": r"""SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://([^/:]+)', 1) = '' THEN 'host-unknown' ELSE lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) END AS host,
      CASE WHEN regexp_extract(url, '(\d+)[^\d]*$', 1) = '' THEN 'run-1' ELSE 'run-' || CAST(CAST(regexp_extract(url, '(\d+)[^\d]*$', 1) AS HUGEINT) AS VARCHAR) END AS run, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM pages""",
    "name_contains_join": """WITH n AS (SELECT DISTINCT name FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part UNION ALL SELECT p_type FROM part)), f AS (SELECT p_partkey, concat_ws('/', upper(p_name), p_type, p_brand) AS file FROM part)
      SELECT p_partkey, name FROM (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY length(name) DESC, name) AS i FROM f JOIN n ON contains(lower(file), lower(name))) WHERE i = 1""",
    "source_precedence": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN CAST(n_chars > 200 AS BIGINT) ELSE CAST(l.quality AS BIGINT) END AS quality, CASE WHEN l.doc_id IS NULL THEN 'default' ELSE 'label' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)",
    "clause_segmentation": f"""WITH {_INTERVALS}, o AS (SELECT *, COALESCE(t0 - lag(t0) OVER (PARTITION BY story ORDER BY ord) >= 6, false) AS opens FROM iv), c AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY story ORDER BY ord) AS clause FROM o)
      SELECT story, CAST(clause AS BIGINT) AS clause, round(min(t0), 6) + 0.0 AS t0, round(max(t0), 6) + 0.0 AS t1, count(*) AS words FROM c GROUP BY story, clause""",
    "punctuation_inference": f"WITH {_TRANSCRIPT} SELECT story, ord, word, mark FROM pw",
    "text_rebuild_offsets": f"WITH {_TRANSCRIPT}{_OFFSETS} SELECT story, ord, word, char_start, char_start + length(word) AS char_end FROM ofs",
    "text_rebuild": f"WITH {_TRANSCRIPT} SELECT story, string_agg(word || mark, ' ' ORDER BY ord) AS text FROM pw GROUP BY story",
    "fit_clauses": f"""WITH {_TRANSCRIPT}, i AS (SELECT story, ord, pause, sum(CAST(pause AND d >= 0.65::DOUBLE AS INT)) OVER (PARTITION BY story ORDER BY ord) AS island FROM tr), c AS (SELECT story, dense_rank() OVER (PARTITION BY story ORDER BY island) - 1 AS clause FROM i WHERE NOT pause)
      SELECT story, CAST(clause AS INT) AS clause, count(*) AS words FROM c GROUP BY ALL""",
    "char_token_containment": f"""WITH {_DOCS}, o AS (SELECT doc, pos, token, COALESCE(sum(length(token) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM tk),
      m AS (SELECT *, (a + a + length(token)) // 2 AS mid FROM o) SELECT doc AS story, count(*) AS matched, CAST(sum(pos) AS BIGINT) AS sum_i, CAST(sum(greatest(1, length(token) - 1)) AS BIGINT) AS letters FROM m WHERE mid < a + greatest(1, length(token) - 1) GROUP BY doc""",
    "token_class_priority": f"""WITH {_DOCS}, x AS (SELECT source, lower(token) AS w FROM tk), p AS (SELECT *, CASE WHEN regexp_matches(w, '(ed|ing|en)$') THEN 'VERB' WHEN regexp_matches(w, 'ly$') THEN 'ADV' WHEN w IN ('the', 'a', 'an') THEN 'DET' ELSE 'NOUN' END AS pos,
      CASE WHEN regexp_matches(w, 'ing$') THEN 'VBG' WHEN regexp_matches(w, '[ae]ted$') THEN 'VBN' WHEN regexp_matches(w, '(ed|en)$') THEN 'VBD' ELSE 'NN' END AS tag FROM x)
      SELECT source, count(*) FILTER (pos = 'NOUN') AS noun, count(*) FILTER (pos = 'ADV') AS adverb, count(*) FILTER (pos = 'DET') AS determiner, count(*) FILTER (pos = 'VERB' AND tag IN ('VBG', 'VBN')) AS non_finite_verb, count(*) FILTER (pos = 'VERB' AND tag = 'VBD' AND w LIKE '%ed') AS past_regular,
      count(*) FILTER (pos = 'VERB' AND tag = 'VBD' AND w NOT LIKE '%ed') AS past_irregular, count(*) FILTER (pos = 'VERB' AND tag = 'VBD') AS past_total FROM p GROUP BY source""",
    "phone_features": f"""WITH {_DOCS}, w AS (SELECT source, upper(regexp_replace(token, '[^a-zA-Z]', '', 'g')) AS w, count(*) AS n FROM tk GROUP BY ALL),
      x AS (SELECT source, n, substring(w, i, 2) AS ph FROM (SELECT source, n, w, CAST(unnest(range(1, greatest(2, length(w)))) AS BIGINT) AS i FROM w)) SELECT source, {_PHONES} FROM x GROUP BY source""",
    "lexical_features": f"""WITH {_DOCS}, f AS (SELECT token, log10(count(*)) + 3 AS zipf FROM tk GROUP BY token HAVING log10(count(*)) + 3 >= 4) SELECT source, round(CAST(count(*) AS DOUBLE), 6) AS presence, round(avg(COALESCE(zipf, 0)), 6) AS frequency, round(avg(length(token)), 6) AS chars, round(sum(0.25::DOUBLE), 6) AS seconds
      FROM tk LEFT JOIN f USING (token) GROUP BY source""",
    "parent_depth": """SELECT 'r' || r_regionkey AS i, 'r' || r_regionkey AS head_i, 0::BIGINT AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2 FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 2 FROM supplier""",
    "tfidf_top_terms": f"""WITH {_TERMS}, nd AS (SELECT count(DISTINCT doc) AS n FROM te), v AS (SELECT term, ln((1.0::DOUBLE + n) / (1 + count(DISTINCT doc))) + 1 AS idf FROM te, nd GROUP BY term, n HAVING count(DISTINCT doc) >= 3 AND count(DISTINCT doc) <= 0.85::DOUBLE * n),
      w AS (SELECT doc, term, count(*) * any_value(idf) AS w FROM te JOIN v USING (term) GROUP BY doc, term), z AS (SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 9) AS w FROM w)
      SELECT doc, rank, term, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY w DESC, term) AS rank FROM z) WHERE rank <= 3""",
    "lexical_coverage": f"""WITH {_TERMS}, v AS (SELECT DISTINCT term FROM te WHERE source <> 'src3') SELECT count(*) AS total, count(v.term) AS covered, count(*) - count(v.term) AS unknown, round(count(v.term) * 100.0::DOUBLE / count(*), 2) AS pct FROM (SELECT * FROM te WHERE source = 'src3') t LEFT JOIN v USING (term)""",
    "fir_lag_features": f"WITH {_HOURLY}, l AS (SELECT story, n, {', '.join(f'lag(n, {d}, 0) OVER w AS l{d}' for d in (1, 2, 3, 4))} FROM hr WINDOW w AS (PARTITION BY story ORDER BY k)) SELECT story, {', '.join(f'CAST(sum(n * l{d}) AS BIGINT) AS with_lag{d}' for d in (1, 2, 3, 4))} FROM l GROUP BY story",
    "fir_convolve_decimate": f"WITH {_HOURLY}, y AS (SELECT story, k, 0.5::DOUBLE * n + 0.25::DOUBLE * lag(n, 1, 0) OVER w + 0.125::DOUBLE * lag(n, 2, 0) OVER w + 0.0625::DOUBLE * lag(n, 3, 0) OVER w AS y FROM hr WINDOW w AS (PARTITION BY story ORDER BY k)) SELECT story, k // 6 AS j, round(y, 6) AS y FROM y WHERE k % 6 = 0",
    "session_zscore": """WITH x AS (SELECT l_returnflag, l_suppkey, l_extendedprice AS x, CASE WHEN l_discount > 0.05::DOUBLE THEN l_discount ELSE 0 END AS d FROM lineitem),
      z AS (SELECT l_returnflag, l_suppkey, (x - avg(x) OVER g) / CASE WHEN stddev_pop(x) OVER g = 0 THEN 1 ELSE stddev_pop(x) OVER g END AS x, (d - avg(d) OVER g) / CASE WHEN stddev_pop(d) OVER g = 0 THEN 1 ELSE stddev_pop(d) OVER g END AS d FROM x WINDOW g AS (PARTITION BY l_returnflag, l_suppkey))
      SELECT l_returnflag, l_suppkey, count(*) AS n, round(max(x), 6) + 0.0 AS max_x, round(min(x), 6) + 0.0 AS min_x, round(max(d), 6) + 0.0 AS max_d, round(avg(d * x), 6) + 0.0 AS cov FROM z GROUP BY ALL""",
    "repeat_average": f"WITH {_LONG} SELECT label, t, round(avg(v), 6) + 0.0 AS mean FROM lg GROUP BY ALL",
    "noise_ceiling": f"WITH {_LONG}, {_CEIL} SELECT label, round(ceiling, 6) + 0.0 AS ceiling FROM ce",
    "r2_and_delta": f"WITH {_PRED} SELECT vec_id, round(rg, 6) + 0.0 AS r2_global, round(rr, 6) + 0.0 AS r2_restricted, round(rg - rr, 6) + 0.0 AS delta_r2 FROM r2",
    "circular_shift_null": f"WITH {_NULL} SELECT vec_id, n_shifts, n_shifts_sensitivity, {_rounded('delta p_value p_value_sensitivity')} FROM pv",
    "bh_fdr": f"WITH {_NULL}, f AS {_bh('pv', 'p_value', 'p_fdr')} SELECT vec_id, label, {_rounded('p_value p_fdr')} FROM f",
    "voxel_metrics_report": f"""WITH {_RESULTS} SELECT label, total, {_rounded('r2_global_median r2_global_max r2_global_positive_pct delta_median delta_iqr delta_p5 delta_p95 delta_positive_pct sig_pct ceiling_pct sig_sensitivity_pct')}, sig_count, sig_sensitivity_count, sig_delta_mean, r2_global_normalized_median, delta_normalized_median, delta_normalized_p95, sig_delta_normalized_mean, sensitivity_stability_pct, n_exhaustive_shifts, round(p_resolution_min, 6) AS p_resolution_min FROM mt""",
    "subject_report": f"WITH {_RESULTS} SELECT label, {_said()} AS report FROM mt",
    "report_document": f"WITH {_RESULTS} SELECT {_document()} AS report FROM mt",
    "simulation_summary": f"WITH {_PRED}, f AS (SELECT rg, round(rg - rr, 9) AS d FROM r2) SELECT count(*) AS targets, count(*) FILTER (rg > 0) AS valid, round(avg(rg) FILTER (rg > 0), 6) + 0.0 AS mean_r2_global, round(avg(d) FILTER (rg > 0), 6) + 0.0 AS mean_delta_r2, CASE WHEN count(*) FILTER (rg > 0) > 0 THEN round(max(d), 6) + 0.0 END AS max_delta_r2 FROM f",
    "significance_summary": f"WITH {_NULL}, f AS {_bh('pv', 'p_value', 'p_fdr')} SELECT count(*) AS targets, count(*) FILTER (p_fdr < 0.05) AS significant, round(avg(delta) FILTER (p_fdr < 0.05), 6) + 0.0 AS mean_delta_r2, round(max(delta) FILTER (p_fdr < 0.05), 6) + 0.0 AS max_delta_r2 FROM f",
    "subject_markdown": f"WITH {_RESULTS} SELECT label, '# ' || label || chr(10) || chr(10) || '- total: ' || total || chr(10) || '- sig_count: ' || sig_count || chr(10) || '- sig_delta_mean: ' || sig_delta_mean AS report FROM mt",
    "across_subjects": f"WITH {_RESULTS} SELECT count(*) AS subjects, count(*) FILTER (sig_count > 0) AS subjects_with_effect, round(avg(sig_pct), 6) + 0.0 AS mean_sig_pct, round(avg(delta_median), 6) + 0.0 AS mean_delta_median FROM mt",
    "layer_masks": f"""WITH {_RESULTS}, ly AS (SELECT label, CASE WHEN r2_global > 0.01 THEN r2_global END AS a, CASE WHEN p_value_fdr < 0.05 THEN delta_r2 END AS b, delta_r2 AS c FROM rs)
      SELECT label, count(a) AS n_r2, count(b) AS n_significant, round(greatest(COALESCE(quantile_cont(a, 0.99), 0.05), 0.05), 6) AS limit_r2, round(greatest(COALESCE(quantile_cont(b, 0.99), 0.01), 0.01), 6) AS limit_significant, round(greatest(COALESCE(quantile_cont(abs(c), 0.99), 0.005), 0.005), 6) AS limit_delta FROM ly GROUP BY label""",
    "ridge_chosen": _ridge(),
    "checkpoint_antijoin": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) >= 6)",
    "upsert_latest": """SELECT script_name, subject_id, execution_time_seconds, timestamp FROM (SELECT o_orderpriority AS script_name, CAST(o_custkey AS VARCHAR) AS subject_id, o_totalprice AS execution_time_seconds, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp,
      row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) AS i FROM orders) WHERE i = 1""",
    "kernel_shapes": f"""WITH t AS (SELECT i AS k, i / 10.0::DOUBLE AS t FROM range(0, 320) r(i)), g AS (SELECT k, t ** 5 * exp(-t) / {math.factorial(5)} AS a, t ** 15 * exp(-t) / {math.factorial(15)} AS b FROM t)
      SELECT k, round((a - b / 6) / sum(a - b / 6) OVER (), 9) + 0.0 AS double_gamma, round(a / sum(a) OVER (), 9) + 0.0 AS single_gamma FROM g""",
    "encoder_results": _encoder(),
    "listed_parts": "SELECT DISTINCT c_nationkey::BIGINT AS c_nationkey FROM customer",
    "response_series": f"""WITH {_HOURLY}, {_kernel("1")}, {_low_pass(2)}, ln AS (SELECT story, max(k) + 1 AS len FROM hr GROUP BY story),
      y1 AS (SELECT story, k + d AS k, sum(n * h) AS y FROM hr, kr WHERE n <> 0 GROUP BY ALL), y2 AS (SELECT story, (k + m - 20) // 2 AS j, sum(y * h) AS n FROM y1 JOIN ln USING (story), lp WHERE k < len AND k + m - 20 >= 0 AND (k + m - 20) % 2 = 0 GROUP BY ALL)
      SELECT g.story, g.j, round(COALESCE(n, 0), 6) + 0.0 AS n FROM (SELECT story, unnest(range(0, (len + 1) // 2)) AS j FROM ln) g LEFT JOIN y2 USING (story, j)""",
    "pulse_response": f"""WITH {_kernel("100")}, {_low_pass(200)}, g AS (SELECT r_regionkey::BIGINT AS story, r_regionkey * 150 + 20 AS t, unnest(range(0, 6000)) AS k FROM region), f AS (SELECT story, k, COALESCE(h, 0) AS y FROM g LEFT JOIN kr ON d = k - t),
      c AS (SELECT story, k + m - 2000 AS k, sum(y * h) AS y FROM f, lp WHERE y <> 0 AND (k + m - 2000) % 200 = 0 GROUP BY ALL) SELECT f.story, f.k, round(f.y, 9) + 0.0 AS fine, CASE WHEN f.k % 200 = 0 THEN round(COALESCE(c.y, 0), 9) + 0.0 END AS coarse FROM f LEFT JOIN c USING (story, k)""",
    "balanced_folds": """WITH RECURSIVE s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM documents GROUP BY source),
      r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, NULL::VARCHAR AS source, 0 AS fold UNION ALL
        SELECT i, a + CASE WHEN f = 0 THEN n ELSE 0 END, b + CASE WHEN f = 1 THEN n ELSE 0 END, c + CASE WHEN f = 2 THEN n ELSE 0 END, source, f FROM (SELECT s.i, a, b, c, s.source, n, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS f FROM r JOIN s ON s.i = r.i + 1))
      SELECT source, fold::BIGINT AS fold FROM r WHERE i > 0""",
    "lsa_fit_report": f"""WITH {_TERMS}, tr AS (SELECT doc, term FROM te WHERE source <> 'src3'), nd AS (SELECT count(DISTINCT doc) AS n FROM tr), v AS (SELECT term, ln((1.0::DOUBLE + n) / (1 + count(DISTINCT doc))) + 1 AS idf FROM tr, nd GROUP BY term, n HAVING count(DISTINCT doc) >= 3 AND count(DISTINCT doc) <= 0.85::DOUBLE * n),
      h AS (SELECT count(*) AS t, count(v.term) AS c FROM (SELECT term FROM te WHERE source = 'src3') x LEFT JOIN v USING (term))
      SELECT n AS documents, 10 AS components, 3 AS min_df, 0.85::DOUBLE AS max_df, (SELECT count(*) FROM v) AS vocabulary_size, t AS held_out_tokens, c AS held_out_covered, t - c AS held_out_unknown, round(c * 100.0::DOUBLE / t, 2) AS held_out_coverage_pct, (SELECT count(*) FROM v) AS axis_terms, (SELECT round(sum(idf), 4) FROM v) AS idf_sum FROM nd, h""",
    "silence_relabel": f"WITH {_INTERVALS} SELECT CASE WHEN event_type IN ('click', 'view') THEN '<EMPTY_SILENCE>' ELSE event_type END AS label, count(*) AS n FROM iv GROUP BY ALL",
    "attach_marks": r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '([.,])', ' \1', 'g'), '\s+([.,])', '\1', 'g')) AS letters, length(regexp_replace(text, '\s+([.,])', '\1', 'g')) AS own_letters FROM documents WHERE text IS NOT NULL",
    "active_rows": f"""WITH {_GRID}, {_OWN.format(where="WHERE e > s AND event_type IN ('click', 'error', 'purchase')")} SELECT story, k, {', '.join(f"CAST(event_type = '{k}' AS BIGINT) AS is_{k}" for k in ('click', 'error', 'purchase'))} FROM own JOIN iv USING (story, ord)""",
    "content_lemmas": f"""WITH {_DOCS} SELECT source, count(*) AS n, count(DISTINCT token) AS kinds FROM tk WHERE lower(token) NOT IN ('the', 'of', 'and', 'to', 'in') AND NOT regexp_matches(token, '^[.,;:!?-]+$') AND NOT regexp_matches(token, '^[0-9]+$') AND lower(token) NOT IN ({', '.join(repr(x) for x in STOP_LEMMAS)}) GROUP BY source""",
    "display_distinct": "SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL",
    "extreme_orders": "SELECT * FROM (SELECT o_totalprice, o_orderkey, 'low' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) UNION ALL SELECT * FROM (SELECT o_totalprice, o_orderkey, 'high' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)",
    "bids_fields": """WITH k AS (SELECT c_custkey, c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN lpad((c_custkey % 100)::VARCHAR, 2, '0') END AS s FROM customer) SELECT c_custkey, 'sub-UTS' || s AS subject_id, CASE WHEN k % 3 <> 0 THEN 'ses-' || (k % 20) ELSE 'ses-unknown' END AS session_id, CASE WHEN k % 5 <> 0 THEN 'run-' || (k % 9) ELSE 'run-1' END AS run_id,
      COALESCE(CASE WHEN k % 2 = 0 THEN 'sub-' ELSE '' END || 'uts' || s, 'other') || CASE WHEN k % 3 <> 0 THEN '_ses-' || lpad((k % 20)::VARCHAR, 2, '0') ELSE '' END || CASE WHEN k % 5 <> 0 THEN '_run-' || lpad((k % 9)::VARCHAR, 2, '0') ELSE '' END AS stem FROM k""",
    "repeat_counts": "WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey) SELECT count(*) AS subjects, count(*) FILTER (n = 0) AS without, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multiple FROM c",
    "validity_counts": "WITH n AS (SELECT n_name, n_nationkey IN (SELECT s_nationkey FROM supplier) AS ok FROM nation) SELECT count(*) AS stories, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, COALESCE(string_agg(n_name, ', ' ORDER BY n_name) FILTER (NOT ok), '') AS invalid_list FROM n",
    "missing_features": "SELECT DISTINCT o_orderstatus AS session, o_custkey AS story FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)",
    "subject_fallback": "SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'sub-' || c_custkey WHEN 2 THEN c_custkey::VARCHAR END AS name FROM customer",
    "syntactic_features": f"""WITH {_DOCS}, i AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS i FROM tk), d AS (SELECT doc, i, CASE WHEN i = 0 THEN 0 ELSE length(format('{{:b}}', i)) END AS depth FROM i)
      SELECT doc AS story, sum(i - i // 2)::BIGINT AS distance, sum(depth)::BIGINT AS depth, max(depth)::BIGINT AS deepest, count(*) FILTER (i = 0) AS roots FROM d GROUP BY doc""",
    "scaled_by_training": """WITH m AS (SELECT avg(l_extendedprice) AS mx, stddev_pop(l_extendedprice) AS sx, avg(l_tax) AS mz, stddev_pop(l_tax) AS sz FROM lineitem WHERE l_orderkey % 4 <> 0)
      SELECT CASE WHEN l_orderkey % 4 <> 0 THEN 'train' ELSE 'test' END AS part, l_linenumber, count(*) AS n, round(avg((l_extendedprice - mx) / sx), 6) + 0.0 AS x, round(avg((l_tax - mz) / sz), 6) + 0.0 AS z, round(max((l_extendedprice - mx) / sx), 6) + 0.0 AS max_x FROM lineitem, m GROUP BY ALL""",
    "strict_offsets": f"WITH {_TRANSCRIPT}{_OFFSETS} SELECT story, ord, word, char_start, char_start + length(word) AS char_end FROM ofs",
    "chunks_by_any_pause": f"""WITH {_TRANSCRIPT}, i AS (SELECT story, ord, pause, sum(CAST(pause AND d >= 0 AS INT)) OVER (PARTITION BY story ORDER BY ord) AS island FROM tr), c AS (SELECT story, dense_rank() OVER (PARTITION BY story ORDER BY island) - 1 AS clause FROM i WHERE NOT pause)
      SELECT story, CAST(clause AS INT) AS clause, count(*) AS words FROM c GROUP BY ALL""",
    "csv_round_trip": _CUSTOMERS,
    "json_round_trip": _CUSTOMERS,
    "parts_round_trip": "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 7 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
    "table_round_trip": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer WHERE c_acctbal > 100 GROUP BY c_mktsegment",
    "textgrid_round_trip": f"""WITH {_GRIDS} SELECT story, tier, count(*) AS n, round(sum(a), 4) + 0.0 AS t0, round(sum(b), 4) + 0.0 AS t1, 0::BIGINT AS errors FROM gr, (VALUES ('words'), ('phones')) v(tier) GROUP BY ALL
      UNION ALL SELECT story, NULL, 0, NULL, NULL, 1 FROM (SELECT DISTINCT story FROM iv WHERE story % 5 = 4)""",
    "repair_statuses": """WITH u AS (SELECT DISTINCT user_id AS s FROM events), k AS (SELECT CASE WHEN s % 10 = 1 THEN 'repaired' WHEN s % 5 = 4 THEN 'failed' WHEN s % 2 = 0 THEN 'valid' ELSE 'repaired' END AS k FROM u UNION ALL SELECT 'skipped' FROM u WHERE s + 3 NOT IN (SELECT s FROM u))
      SELECT count(*) FILTER (k = 'valid') AS valid, count(*) FILTER (k = 'repaired') AS repaired, count(*) FILTER (k = 'skipped') AS skipped, count(*) FILTER (k = 'failed') AS failed, count(*) AS total FROM k""",
    "corpus_diagnosis": """SELECT story, CASE WHEN stage IS NULL THEN 'ok' ELSE 'failed' END AS status, stage FROM (SELECT DISTINCT user_id AS story, CASE WHEN user_id % 5 = 4 THEN 'read' WHEN user_id % 3 = 0 THEN 'annotate' END AS stage FROM events)""",
    "raw_text_head": """SELECT line::BIGINT AS line, value FROM (VALUES (1, 'backup'), (2, '"Praat chronological TextGrid text file"'), (3, '0 1'), (4, '2'), (5, '"IntervalTier" "words" 0 1')) v(line, value)""",
}
