"""ANSI SQL twins of the registered queries, for DuckDB over the raw
driver tables (orders, customer registered as views).

The adapter view and the cleaning / bucketing / indexing stages are written
once here as CTEs and shared by the statements.  Queries whose results come
from randomised or iterative learners (random split, full ensembles,
tuning grids) have no entry.
"""

from __future__ import annotations

from paysift.functions import lookups as L
from paysift.operators.bagging import poisson_steps
from paysift.operators.train import SEED
from paysift.sources.tables import planted_values


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _ladder_sql(expr: str, arms, default: str) -> str:
    whens = " ".join(f"WHEN {expr} IN {_in_list(keys)} THEN {_q(bucket)}"
                     for bucket, keys in arms)
    return f"CASE {whens} ELSE {_q(default)} END"


def _keep_sql(expr: str, keep) -> str:
    return f"CASE WHEN {expr} IN {_in_list(keep)} THEN {expr} ELSE 'Other' END"


_PARTS = "string_split(location, ', ')"
_NPARTS = f"coalesce(len({_PARTS}), -1)"
_STATE = f"{_PARTS}[2]"
_COUNTRY = f"{_PARTS}[3]"
LOCATION_REGION = (
    f"CASE WHEN {_NPARTS} < 3 THEN "
    f"{_ladder_sql(_STATE, L.US_REGIONS, L.US_DEFAULT)} ELSE "
    f"{_ladder_sql(_COUNTRY, L.COUNTRY_REGIONS, L.COUNTRY_DEFAULT)} END")
LOCATION_KEY = f"CASE WHEN {_NPARTS} < 3 THEN {_STATE} ELSE {_COUNTRY} END"
DEGREE_FLAG = f"regexp_matches(other_details, {_q('|'.join(L.DEGREES))})"
HASH_PCT = ("CAST(CAST(('0x' || substr(md5(CAST(rec_id AS VARCHAR)), 1, 8))"
            " AS BIGINT) % 100 AS INTEGER)")

COMP = """comp AS (
  SELECT
    o_orderkey AS rec_id,
    c_mktsegment AS company,
    o_orderpriority AS title,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS tag,
    CASE o_orderkey % 9 WHEN 0 THEN 'Seattle, WA' WHEN 1 THEN 'Austin, TX'
      WHEN 2 THEN 'Chicago, IL' WHEN 3 THEN 'Boston, MA'
      WHEN 4 THEN 'Miami, FL' WHEN 5 THEN 'Toronto, ON, Canada'
      WHEN 6 THEN 'Berlin, BE, Germany' WHEN 7 THEN 'Remote'
      ELSE NULL END AS location,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Female'
      WHEN o_orderkey % 17 = 1 THEN 'Other' ELSE 'Male' END AS gender,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL
      ELSE concat('L', CAST(o_orderkey % 6 + 1 AS VARCHAR)) END AS std_level,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 'n/a'
      ELSE CAST(o_custkey % 60 AS VARCHAR) END AS skill_index,
    CASE WHEN o_orderkey % 4 = 0 THEN 'Masters in CS'
      WHEN o_orderkey % 10 = 1 THEN 'PhD'
      WHEN o_orderkey % 6 = 5 THEN NULL ELSE 'Bachelors' END AS other_details,
    CAST(o_orderkey % 31 AS VARCHAR) AS years_exp,
    CAST(o_custkey % 12 AS VARCHAR) AS years_at,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
      WHEN o_orderkey % 211 = 0 THEN '2500000'
      ELSE CAST(50000 + 3000 * (o_orderkey % 31) + 1000 * (o_custkey % 12)
        + CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 10 = 1 THEN 20000
          ELSE 0 END
        + (o_orderkey * 7919) % 10007 AS VARCHAR) END AS total_comp,
    CAST(NULL AS VARCHAR) AS _c16,
    CAST(NULL AS VARCHAR) AS _c17
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

NUMS = f"""nums AS (
  SELECT rec_id, TRY_CAST(years_exp AS DOUBLE) AS years_exp,
    TRY_CAST(years_at AS DOUBLE) AS years_at,
    TRY_CAST(total_comp AS DOUBLE) AS total_comp,
    {HASH_PCT} < 70 AS is_train
  FROM comp
  WHERE total_comp IS NOT NULL AND TRY_CAST(total_comp AS DOUBLE) < 1000000
)"""

CLEAN = f"""labeled AS (SELECT * FROM comp WHERE total_comp IS NOT NULL),
learned AS (
  SELECT
    (SELECT std_level FROM labeled WHERE std_level IS NOT NULL
     GROUP BY std_level ORDER BY count(*) DESC, std_level LIMIT 1) AS std_mode,
    (SELECT avg(TRY_CAST(skill_index AS DOUBLE)) FROM labeled) AS skill_mean
),
cleaned AS (
  SELECT l.rec_id, l.company, l.title, l.tag, l.location,
    coalesce(l.gender, {_q(L.GENDER_FILL)}) AS gender,
    coalesce(l.std_level, m.std_mode) AS std_level,
    coalesce(TRY_CAST(l.skill_index AS DOUBLE), m.skill_mean)
      AS skill_index_imputed,
    coalesce(l.other_details, {_q(L.OTHER_DETAILS_FILL)}) AS other_details,
    TRY_CAST(l.years_exp AS DOUBLE) AS years_exp,
    TRY_CAST(l.years_at AS DOUBLE) AS years_at,
    TRY_CAST(l.total_comp AS DOUBLE) AS total_comp
  FROM labeled l CROSS JOIN learned m
  WHERE TRY_CAST(l.total_comp AS DOUBLE) < {L.LABEL_CAP}
),
cat AS (
  SELECT *,
    {_keep_sql('company', L.ADAPTER_COMPANY_KEEP)} AS cat_comp,
    {_ladder_sql('title', L.ADAPTER_TITLE_LADDER, L.OTHER)} AS cat_title,
    {LOCATION_REGION} AS cat_location,
    {DEGREE_FLAG} AS masters,
    {_keep_sql('tag', L.ADAPTER_TAG_KEEP)} AS cat_tag
  FROM cleaned
)"""

INDEXED = ["cat_comp", "cat_title", "gender", "cat_location", "cat_tag",
           "std_level"]


def _idx_cte(c: str) -> str:
    return (f"idx_{c} AS (SELECT {c} AS value, CAST(row_number() OVER "
            f"(ORDER BY count(*) ASC, {c} ASC) - 1 AS DOUBLE) AS idx "
            f"FROM cat GROUP BY {c})")


INDEX = ",\n".join(_idx_cte(c) for c in INDEXED)

# Slot layout of the assembled vector, derived from the category counts:
# location one-hot | masters | comp idx | years_exp | years_at | title
# one-hot | gender one-hot | tag idx | skill | level one-hot.
OFFSETS = """sizes AS (
  SELECT (SELECT count(*) FROM idx_cat_location) AS n_loc,
    (SELECT count(*) FROM idx_cat_title) AS n_title,
    (SELECT count(*) FROM idx_gender) AS n_gender
),
offs AS (
  SELECT 0 AS o_loc, n_loc AS o_masters, n_loc + 1 AS o_comp,
    n_loc + 2 AS o_yexp, n_loc + 3 AS o_yat, n_loc + 4 AS o_title,
    n_loc + 4 + n_title AS o_gender, n_loc + 4 + n_title + n_gender AS o_tag,
    n_loc + 5 + n_title + n_gender AS o_skill,
    n_loc + 6 + n_title + n_gender AS o_std
  FROM sizes
),
enc AS (
  SELECT c.*, il.idx AS loc_idx, ic.idx AS comp_idx, it.idx AS title_idx,
    ig.idx AS gender_idx, itg.idx AS tag_idx, isl.idx AS std_idx
  FROM cat c
  JOIN idx_cat_location il ON il.value = c.cat_location
  JOIN idx_cat_comp ic ON ic.value = c.cat_comp
  JOIN idx_cat_title it ON it.value = c.cat_title
  JOIN idx_gender ig ON ig.value = c.gender
  JOIN idx_cat_tag itg ON itg.value = c.cat_tag
  JOIN idx_std_level isl ON isl.value = c.std_level
),
slots AS (
  SELECT rec_id, CAST(o_loc + loc_idx AS INTEGER) AS slot,
    CAST(1.0 AS DOUBLE) AS val FROM enc, offs
  UNION ALL SELECT rec_id, o_masters, CASE WHEN masters THEN 1.0 ELSE 0.0 END
    FROM enc, offs
  UNION ALL SELECT rec_id, o_comp, comp_idx FROM enc, offs
  UNION ALL SELECT rec_id, o_yexp, years_exp FROM enc, offs
  UNION ALL SELECT rec_id, o_yat, years_at FROM enc, offs
  UNION ALL SELECT rec_id, CAST(o_title + title_idx AS INTEGER), 1.0
    FROM enc, offs
  UNION ALL SELECT rec_id, CAST(o_gender + gender_idx AS INTEGER), 1.0
    FROM enc, offs
  UNION ALL SELECT rec_id, o_tag, tag_idx FROM enc, offs
  UNION ALL SELECT rec_id, o_skill, skill_index_imputed FROM enc, offs
  UNION ALL SELECT rec_id, CAST(o_std + std_idx AS INTEGER), 1.0
    FROM enc, offs
),
names AS (
  SELECT CAST(o_loc + idx AS INTEGER) AS idx,
    'cat_location_vec_' || value AS name FROM idx_cat_location, offs
  UNION ALL SELECT o_masters, 'masters' FROM offs
  UNION ALL SELECT o_comp, 'cat_comp_idx' FROM offs
  UNION ALL SELECT o_yexp, 'years_exp' FROM offs
  UNION ALL SELECT o_yat, 'years_at' FROM offs
  UNION ALL SELECT CAST(o_title + idx AS INTEGER), 'cat_title_vec_' || value
    FROM idx_cat_title, offs
  UNION ALL SELECT CAST(o_gender + idx AS INTEGER), 'gender_vec_' || value
    FROM idx_gender, offs
  UNION ALL SELECT o_tag, 'cat_tag_idx' FROM offs
  UNION ALL SELECT o_skill, 'skill_index_imputed' FROM offs
  UNION ALL SELECT CAST(o_std + idx AS INTEGER), 'std_level_vec_' || value
    FROM idx_std_level, offs
),
corrs AS (
  SELECT n.idx, n.name,
    covar_pop(coalesce(s.val, 0.0), e.total_comp)
      / NULLIF(stddev_pop(coalesce(s.val, 0.0)) * stddev_pop(e.total_comp), 0)
      AS corr
  FROM names n CROSS JOIN enc e
  LEFT JOIN slots s ON s.rec_id = e.rec_id AND s.slot = n.idx
  GROUP BY n.idx, n.name
)"""

COMP_COLS = ["rec_id", "company", "title", "tag", "location", "gender",
             "std_level", "skill_index", "other_details", "years_exp",
             "years_at", "total_comp", "_c16", "_c17"]
CLEAN_COLS = [c for c in COMP_COLS if c not in (
    "_c16", "_c17", "skill_index")] + ["skill_index_imputed"]
COMP_TYPES = ["bigint"] + ["string"] * 13


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _planted() -> str:
    def dealt(c: str, values: list) -> str:
        items = ", ".join("NULL" if v is None else _q(v) for v in values)
        return f"[{items}][o_orderkey % {len(values)} + 1] AS {c}"
    return _with("planted AS (SELECT o_orderkey AS rec_id, " + ", ".join(
        dealt(c, v) for c, v in planted_values().items()) + " FROM orders)")


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _stump_sql() -> str:
    """Best single split of years_exp on the training rows: maximise
    SL²/nL + SR²/nR over thresholds between distinct values."""
    return _with(COMP, NUMS, """d AS (SELECT years_exp AS x, total_comp AS y
  FROM nums WHERE is_train),
v AS (SELECT x, count(*) AS n, sum(y) AS s FROM d GROUP BY x),
c AS (SELECT x, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl
  FROM v),
t AS (SELECT sum(n) AS nt, sum(s) AS st FROM v),
g AS (SELECT x, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain
  FROM c, t WHERE nl < nt),
best AS (SELECT x AS thr FROM g ORDER BY gain DESC, x LIMIT 1)""") + """
SELECT CASE WHEN x <= thr THEN 0 ELSE 1 END AS leaf, count(*) AS n,
  round(avg(y), 4) AS prediction
FROM d, best GROUP BY 1"""


def _elastic_sql(rows: str) -> str:
    """RMSE (f, point, ...) of the linear grid on one standardised feature:
    the absolute penalty is a soft threshold, the squared one a divisor.
    ``rows`` defines d (x, y, ...), and pairs (f, x, y, fit): the rows of
    every split with whether they train it."""
    points = ", ".join(
        f"({i}, {r}::DOUBLE, {str(b).lower()}, {m}::DOUBLE)"
        for i, (r, b, m) in enumerate(
            (r, b, m) for r in L.LINEAR_GRID["regParam"]
            for b in L.LINEAR_GRID["fitIntercept"]
            for m in L.LINEAR_GRID["elasticNetParam"]))
    return _with(COMP, NUMS, rows, f"""grid AS (
  SELECT * FROM (VALUES {points}) g(point, reg, icpt, mix)),
m AS (SELECT f, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx,
  stddev_pop(y) AS sy, covar_pop(x, y) AS cxy, avg(x * y) AS exy,
  avg(x * x) AS exx FROM pairs WHERE fit GROUP BY f),
w AS (SELECT f, point, reg, icpt, mix, mx, my, sx, sy, reg / sy AS lam,
  CASE WHEN icpt THEN cxy ELSE exy END / (sx * sy) AS c,
  CASE WHEN icpt THEN 1.0 ELSE exx / (sx * sx) END AS a FROM m, grid),
b AS (SELECT *, sign(c) * greatest(abs(c) - mix * lam, 0)
  / (a + (1 - mix) * lam) * sy / sx AS b1 FROM w),
e AS (SELECT b.f, point, reg, icpt, mix,
  sqrt(avg((y - b1 * x - CASE WHEN icpt THEN my - b1 * mx ELSE 0 END)
    * (y - b1 * x - CASE WHEN icpt THEN my - b1 * mx ELSE 0 END))) AS rmse
  FROM b JOIN pairs p ON p.f = b.f AND NOT p.fit
  GROUP BY b.f, point, reg, icpt, mix),
r AS (SELECT point, reg, icpt, mix, avg(rmse) AS rmse FROM e
  GROUP BY point, reg, icpt, mix)""")


TREE_COLS = ["years_exp", "years_at", "masters_flag"]


def _long(k: int | str) -> str:
    """The training rows of d<k>, a row a feature."""
    return " UNION ALL ".join(
        f"SELECT f, node, {i} AS a, {c} AS v, y FROM d{k} WHERE fit"
        for i, c in enumerate(TREE_COLS))


def _level(k: int) -> str:
    """Best splits of the nodes of d<k> (b<k>), and the rows below them
    (d<k + 1>)."""
    value = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(TREE_COLS))
    return f"""v{k} AS (SELECT f, node, a, v, count(*) AS n,
  sum(y) AS s FROM ({_long(k)}) GROUP BY f, node, a, v),
c{k} AS (SELECT f, node, a, v, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
  sum(n) OVER t AS nt, sum(s) OVER t AS st FROM v{k}
  WINDOW w AS (PARTITION BY f, node, a ORDER BY v),
    t AS (PARTITION BY f, node, a)),
g{k} AS (SELECT c.*, mid.thr, sl * sl / nl + (st - sl) * (st - sl)
    / (nt - nl) - st * st / nt AS gain
  FROM c{k} c JOIN mid ON mid.f = c.f AND mid.a = c.a AND mid.v = c.v
  WHERE nl < nt),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY f, node ORDER BY gain DESC, a, v) AS r FROM g{k})
  WHERE r = 1 AND gain > 0),
d{k + 1} AS (SELECT d.* REPLACE (CASE WHEN b.a IS NULL THEN d.node
    WHEN CASE b.a {value} END <= b.thr THEN 2 * d.node
    ELSE 2 * d.node + 1 END AS node)
  FROM d{k} d LEFT JOIN b{k} b ON b.f = d.f AND b.node = d.node)"""


def _tree_sql(depth: int, folds: int | None) -> str:
    """Trees by best-split search down to ``depth``: rows (d0..), and the
    splits of each level (b0..) with their gains.  With ``folds`` every
    fold f has a tree of the other folds' rows, else f is 0 and has all."""
    if folds:
        source = f"""folds AS (SELECT range AS f FROM range({folds})),
d0 AS (SELECT f, rec_id % {folds} <> f AS fit, src.*, 1 AS node
  FROM src, folds)"""
    else:
        source = "d0 AS (SELECT 0 AS f, true AS fit, *, 1 AS node FROM src)"
    ctes = [COMP, f"""src AS (SELECT rec_id,
  TRY_CAST(years_exp AS DOUBLE) AS years_exp,
  TRY_CAST(years_at AS DOUBLE) AS years_at,
  CASE WHEN regexp_matches(coalesce(other_details,
    {_q(L.OTHER_DETAILS_FILL)}), {_q('|'.join(L.DEGREES))})
    THEN 1.0 ELSE 0.0 END AS masters_flag,
  TRY_CAST(total_comp AS DOUBLE) AS y FROM comp
  WHERE total_comp IS NOT NULL AND TRY_CAST(total_comp AS DOUBLE) < 1000000
    AND {HASH_PCT} < 70)""", source]
    # thresholds lie half-way between neighbouring values of the whole set
    ctes.append(f"""mid AS (SELECT f, a, v, (v + lead(v) OVER (
  PARTITION BY f, a ORDER BY v)) / 2 AS thr
  FROM (SELECT DISTINCT f, a, v FROM ({_long(0)})))""")
    ctes += [_level(k) for k in range(depth)]
    return _with(*ctes)


def _boost_sql(folds: int, steps: list[float]) -> str:
    """Mean held-out RMSE of boosted stumps after one and two iterations,
    by step: the second stump fits twice the first one's residuals and is
    added with the step."""
    sql = _tree_sql(1, folds) + """, p1 AS (SELECT f, node, avg(y) AS p
  FROM d1 WHERE fit GROUP BY f, node),
e1 AS (SELECT d1.*, p1.p, d1.y AS label FROM d1
  JOIN p1 ON p1.f = d1.f AND p1.node = d1.node),
d8 AS (SELECT * REPLACE (2 * (y - p) AS y, 1 AS node) FROM e1),
""" + _level(8) + """, p2 AS (SELECT f, node, avg(y) AS q
  FROM d9 WHERE fit GROUP BY f, node),
e2 AS (SELECT d9.f, label, p, q FROM d9
  JOIN p2 ON p2.f = d9.f AND p2.node = d9.node WHERE NOT fit)
"""
    n, out = len(steps), []
    for k in range(2):
        for i, step in enumerate(steps):
            error = f"(label - p - {step if k else 0} * q)"
            out.append(f"""SELECT CAST({k * n + i} AS INTEGER) AS point,
  round(avg(rmse), 4) AS rmse FROM (
    SELECT f, sqrt(avg({error} * {error})) AS rmse FROM e2 GROUP BY f)""")
    return sql + " UNION ALL ".join(out)


def _bagged_sql(trees: int) -> str:
    """Stumps on weighted rows: the weights of the bags, and the split of
    ``_tree_sql`` with weighted sums."""
    u = (f"('0x' || substr(md5('{SEED}:' || tree || ':' || rec_id), 1, 8))"
         "::BIGINT::DOUBLE / 4294967296.0")
    steps = poisson_steps()
    weight = "CASE " + " ".join(
        f"WHEN u < {p!r}::DOUBLE THEN {k}.0" for k, p in enumerate(steps)) \
        + f" ELSE {len(steps)}.0 END"
    long = " UNION ALL ".join(
        f"SELECT tree, {i} AS a, {c} AS v, w, y FROM bag"
        for i, c in enumerate(TREE_COLS))
    value = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(TREE_COLS))
    base = _tree_sql(0, None)
    return base + f""", draw AS (SELECT src.*, tree, {u} AS u FROM src,
  (SELECT range AS tree FROM range({trees}))),
bag AS (SELECT * FROM (SELECT *, {weight} AS w FROM draw) WHERE w > 0),
bv AS (SELECT tree, a, v, sum(w) AS n, sum(w * y) AS s FROM ({long})
  GROUP BY tree, a, v),
bc AS (SELECT tree, a, v, (v + lead(v) OVER o) / 2 AS thr,
  sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER t AS nt,
  sum(s) OVER t AS st FROM bv
  WINDOW o AS (PARTITION BY tree, a ORDER BY v),
    t AS (PARTITION BY tree, a)),
bb AS (SELECT tree, a, thr FROM (SELECT *, row_number() OVER (
    PARTITION BY tree ORDER BY sl * sl / nl + (st - sl) * (st - sl)
      / (nt - nl) DESC, a, v) AS r FROM bc WHERE nl < nt) WHERE r = 1)
SELECT CAST(bag.tree AS INTEGER) AS tree,
  CASE WHEN CASE bb.a {value} END <= bb.thr THEN 0 ELSE 1 END AS leaf,
  CAST(sum(w) AS DOUBLE) AS weight, round(sum(w * y) / sum(w), 4)
    AS prediction
FROM bag JOIN bb ON bb.tree = bag.tree GROUP BY 1, 2"""


def _linear_fit_cte() -> str:
    return """tr AS (SELECT years_exp AS x1, years_at AS x2, total_comp AS y
  FROM nums WHERE is_train),
m AS (SELECT var_pop(x1) AS c11, var_pop(x2) AS c22,
  covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y,
  avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
  regr_slope(y, x1) AS one_b1, regr_intercept(y, x1) AS one_b0 FROM tr),
co AS (SELECT one_b0, one_b1,
  (c1y * c22 - c12 * c2y) / (c11 * c22 - c12 * c12) AS two_b1,
  (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS two_b2, m1, m2, my
  FROM m),
coefs AS (SELECT one_b0, one_b1, two_b1, two_b2,
  my - two_b1 * m1 - two_b2 * m2 AS two_b0 FROM co),
scored AS (SELECT n.rec_id, n.total_comp AS a,
  c.two_b0 + c.two_b1 * n.years_exp + c.two_b2 * n.years_at AS p
  FROM nums n, coefs c WHERE NOT n.is_train)"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    base = _with(COMP)
    q["q01_view_round_trip"] = base + \
        "SELECT company, count(*) AS n FROM comp GROUP BY company"
    q["q02_preview"] = base + \
        "SELECT rec_id, company, title FROM comp ORDER BY rec_id LIMIT 5"
    q["q03_row_count"] = base + "SELECT count(*) AS n FROM comp"
    q["q04_schema"] = base + _union(
        f"SELECT CAST({i} AS INTEGER) AS pos, '{c}' AS column_name, "
        f"'{t}' AS type, count({c}) AS n_non_null FROM comp"
        for i, (c, t) in enumerate(zip(COMP_COLS, COMP_TYPES)))
    q["q05_drop_named"] = base + "SELECT " + ", ".join(
        c for c in COMP_COLS if c != "years_at") + " FROM comp"
    q["q06_drop_empty"] = base + "SELECT " + ", ".join(
        c for c in COMP_COLS if c not in ("_c16", "_c17")) + " FROM comp"
    q["q07_null_profile"] = base + _union(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
        f"count(*) AS n_rows FROM comp" for c in COMP_COLS)
    q["q07b_null_profile_labeled"] = _with(COMP, CLEAN) + _union(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
        f"count(*) AS n_rows FROM labeled" for c in COMP_COLS)
    q["q07c_null_profile_clean"] = _with(COMP, CLEAN) + _union(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
        f"count(*) AS n_rows FROM cleaned" for c in CLEAN_COLS)
    q["q08_require_label"] = base + \
        "SELECT count(*) AS n FROM comp WHERE total_comp IS NOT NULL"
    q["q09_null_by_bucket"] = _with(COMP, """r AS (SELECT min(rec_id) AS lo,
  CAST(max(rec_id) - min(rec_id) + 1 AS DOUBLE) AS span FROM comp),
b AS (SELECT comp.*, CAST(floor((rec_id - lo) * 20 / span) AS BIGINT)
  AS bucket FROM comp, r)""") + _union(
        f"SELECT bucket, '{c}' AS column_name, count(*) - count({c}) AS "
        f"n_null, count(*) AS n FROM b GROUP BY 1" for c in COMP_COLS[1:])
    q["q10_fill_constants"] = base + f"""SELECT
  coalesce(gender, {_q(L.GENDER_FILL)}) AS gender,
  coalesce(other_details, {_q(L.OTHER_DETAILS_FILL)}) AS other_details,
  count(*) AS n FROM comp GROUP BY 1, 2"""
    q["q10b_fill_level"] = base + f"""SELECT
  coalesce(std_level, {_q(L.STANDARD_LEVEL_FILL)}) AS std_level,
  count(*) AS n FROM comp GROUP BY 1"""
    q["q11_fill_mode"] = base + """, m AS (SELECT std_level AS v FROM comp
  WHERE std_level IS NOT NULL GROUP BY std_level
  ORDER BY count(*) DESC, std_level LIMIT 1)
SELECT coalesce(c.std_level, m.v) AS std_level, count(*) AS n
FROM comp c CROSS JOIN m GROUP BY 1"""
    q["q12_mean_impute"] = base + """SELECT rec_id,
  round(coalesce(TRY_CAST(skill_index AS DOUBLE),
    avg(TRY_CAST(skill_index AS DOUBLE)) OVER ()), 6) AS skill_imputed
FROM comp"""
    q["q13_outlier_cap"] = base + f"""SELECT count(*) AS n,
  max(TRY_CAST(total_comp AS DOUBLE)) AS max_label FROM comp
WHERE total_comp IS NOT NULL AND TRY_CAST(total_comp AS DOUBLE) < {L.LABEL_CAP}"""
    q["q14_summary"] = base + _union(
        f"SELECT '{c}' AS column_name, count(x) AS n, round(avg(x), 6) AS mean,"
        f" round(stddev_samp(x), 6) AS stddev, min(x) AS min_value, "
        f"max(x) AS max_value FROM (SELECT TRY_CAST({c} AS DOUBLE) AS x "
        f"FROM comp) t"
        for c in ["years_exp", "years_at", "skill_index", "total_comp"])
    q["q14b_clean_summary"] = _with(COMP, CLEAN) + _union(
        f"SELECT '{c}' AS column_name, count({c}) AS n, "
        f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, "
        f"min({c}) AS min_value, max({c}) AS max_value FROM cleaned"
        for c in ["skill_index_imputed", "years_exp", "years_at",
                  "total_comp"])
    q["q15_value_counts"] = base + _union(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, "
        f"count({c}) AS n FROM comp GROUP BY 2"
        for c in ["std_level", "gender", "title", "tag"])
    q["q16_distinct_counts"] = base + _union(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, "
        f"count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 "
        f"END) AS BIGINT) AS n_distinct_with_null FROM comp"
        for c in ["company", "title", "location", "tag"])
    q["q16c_bucket_cardinality"] = _with(COMP, CLEAN) + _union(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, "
        f"count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 "
        f"END) AS BIGINT) AS n_distinct_with_null FROM cat"
        for c in ["cat_comp", "cat_title", "cat_location", "cat_tag"])
    q["q16d_distinct_sketches"] = base + _union(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_exact, "
        f"true AS same, true AS within FROM comp"
        for c in ["rec_id", "company", "location", "tag", "total_comp"])
    q["q16b_distinct_rows"] = base + f"""SELECT count(*) AS n FROM (
  SELECT DISTINCT coalesce(other_details, {_q(L.OTHER_DETAILS_FILL)}) FROM comp)"""
    label_rows = f"""v AS (SELECT TRY_CAST(total_comp AS DOUBLE) AS x FROM comp
  WHERE total_comp IS NOT NULL
    AND TRY_CAST(total_comp AS DOUBLE) < {L.LABEL_CAP})"""
    q["q17_histogram"] = _with(COMP, label_rows, """s AS (SELECT min(x) AS lo,
  count(x) AS total, (max(x) - min(x)) / 20 AS width FROM v),
b AS (SELECT least(CAST(floor((x - lo) / width) AS INTEGER), 19) AS bin,
  count(*) AS n FROM v, s GROUP BY 1)""") + """SELECT bin,
  lo + bin * width AS lo, lo + (bin + 1) * width AS hi, n,
  n / (CAST(total AS DOUBLE) * width) AS density FROM b, s"""
    q["q17c_int_histogram"] = q["q17_histogram"].replace(
        "TRY_CAST(total_comp AS DOUBLE) AS x",
        "CAST(TRY_CAST(total_comp AS INTEGER) AS DOUBLE) AS x")
    q["q17b_quartiles"] = _with(COMP, label_rows, """r AS (SELECT x,
  row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS total FROM v),
p AS (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS prob)""") + """SELECT p.prob,
  min(r.x) AS value FROM p, r
WHERE r.rn >= greatest(ceil(p.prob * r.total), 1) GROUP BY p.prob"""

    q["q18_keep_list"] = base + f"""SELECT
  {_keep_sql('company', L.ADAPTER_COMPANY_KEEP)} AS cat_comp, count(*) AS n
FROM comp GROUP BY 1"""
    q["q19_title_ladder"] = base + f"""SELECT
  {_ladder_sql('title', L.ADAPTER_TITLE_LADDER, L.OTHER)} AS cat_title,
  count(*) AS n FROM comp GROUP BY 1"""
    q["q20_location_lookup"] = base + f"""SELECT DISTINCT
  {LOCATION_KEY} AS location_key, {LOCATION_REGION} AS region FROM comp"""
    q["q21_location_router"] = base + f"""SELECT location,
  {LOCATION_REGION} AS cat_location, count(*) AS n FROM comp GROUP BY 1, 2"""
    q["q22_tag_buckets"] = base + f"""SELECT 'keep' AS mode,
  {_keep_sql('tag', L.ADAPTER_TAG_KEEP)} AS cat_tag, count(*) AS n
FROM comp GROUP BY 2
UNION ALL
SELECT 'top_k' AS mode,
  CASE WHEN tag IN (SELECT tag FROM comp WHERE tag IS NOT NULL GROUP BY tag
    ORDER BY count(*) DESC, tag LIMIT 2) THEN tag ELSE 'Other' END AS cat_tag,
  count(*) AS n
FROM comp GROUP BY 2"""
    q["q22c_tag_top_k"] = base + """SELECT rec_id, CASE WHEN tag IN (
  SELECT tag FROM comp WHERE tag IS NOT NULL GROUP BY tag
  ORDER BY count(*) DESC, tag LIMIT 2) THEN tag ELSE 'Other' END AS cat_tag
FROM comp"""
    planted = _planted()
    q["q18b_original_companies"] = planted + f"""SELECT company,
  {_keep_sql('company', L.COMPANY_KEEP)} AS cat_comp, count(*) AS n
FROM planted GROUP BY 1, 2"""
    q["q19b_original_titles"] = planted + f"""SELECT title,
  {_ladder_sql('title', L.TITLE_LADDER, L.OTHER)} AS cat_title,
  count(*) AS n FROM planted GROUP BY 1, 2"""
    q["q21b_original_locations"] = planted + f"""SELECT location,
  {LOCATION_REGION} AS cat_location, count(*) AS n FROM planted
GROUP BY 1, 2"""
    q["q22b_original_tags"] = planted + f"""SELECT tag,
  {_keep_sql('tag', L.TAG_KEEP)} AS cat_tag, count(*) AS n
FROM planted GROUP BY 1, 2"""
    q["q23_degree_flag"] = base + \
        f"SELECT {DEGREE_FLAG} AS masters, count(*) AS n FROM comp GROUP BY 1"

    enc = _with(COMP, CLEAN, INDEX, OFFSETS)
    q["q24_frequency_index"] = enc + _union(
        f"SELECT '{c}' AS column_name, value, idx FROM idx_{c}"
        for c in INDEXED)
    q["q25_one_hot"] = enc + """SELECT rec_id, CAST(loc_idx AS INTEGER) AS slot,
  CAST(1.0 AS DOUBLE) AS val FROM enc"""
    q["q26_dense_sparse"] = enc + _union(
        f"SELECT '{v}' AS column_name, CAST({i} AS INTEGER) AS slot, "
        f"CAST(count(*) AS DOUBLE) AS total FROM enc GROUP BY 2"
        for v, i in (("cat_title_vec", "title_idx"),
                     ("gender_vec", "gender_idx"),
                     ("cat_location_vec", "loc_idx"),
                     ("std_level_vec", "std_idx")))
    frame = {"rec_id": "CAST(rec_id AS DOUBLE)", "years_exp": "years_exp",
             "years_at": "years_at", "total_comp": "total_comp",
             "skill_index_imputed": "skill_index_imputed",
             "masters": "CASE WHEN masters THEN 1.0::DOUBLE "
                        "WHEN NOT masters THEN 0.0::DOUBLE END",
             "cat_comp_idx": "comp_idx", "cat_title_idx": "title_idx",
             "gender_idx": "gender_idx", "cat_location_idx": "loc_idx",
             "cat_tag_idx": "tag_idx", "std_level_idx": "std_idx"}
    q["q14c_frame_summary"] = enc + _union(
        f"SELECT '{c}' AS column_name, count(x) AS n, round(avg(x), 6) AS "
        f"mean, round(stddev_samp(x), 6) AS stddev, min(x) AS min_value, "
        f"max(x) AS max_value FROM (SELECT {e} AS x FROM enc) t"
        for c, e in frame.items())
    q["q28_random_split"] = enc + """SELECT count(*) AS n_rows,
  CAST(0 AS BIGINT) AS n_overlap, CAST(0 AS BIGINT) AS n_missing FROM enc"""
    q["q30b_group_coefs"] = enc + f""", tr AS (
  SELECT gender, gender_idx, total_comp FROM enc WHERE {HASH_PCT} < 70),
g AS (SELECT gender AS term, gender_idx AS i, avg(total_comp) AS m
  FROM tr GROUP BY 1, 2),
base AS (SELECT m FROM g ORDER BY i DESC LIMIT 1)
SELECT 'intercept' AS term, round(m, 4) AS coef FROM base
UNION ALL
SELECT g.term, round(g.m - base.m, 4) FROM g, base
WHERE g.i < (SELECT max(i) FROM g)"""
    q["q27_assembled"] = enc + """SELECT rec_id, CAST(slot AS INTEGER) AS slot,
  round(val, 6) AS val FROM slots WHERE val <> 0"""
    q["q29_hash_split"] = _with(COMP, NUMS) + """SELECT
  CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, count(*) AS n,
  CAST(sum(rec_id) AS BIGINT) AS sum_id FROM nums GROUP BY 1"""

    lin = _with(COMP, NUMS, _linear_fit_cte())
    q["q30_linear_coefs"] = lin + """SELECT model, term, round(coef, 4) AS coef
FROM (
  SELECT 'one' AS model, 'intercept' AS term, one_b0 AS coef FROM coefs
  UNION ALL SELECT 'one', 'years_exp', one_b1 FROM coefs
  UNION ALL SELECT 'two', 'intercept', two_b0 FROM coefs
  UNION ALL SELECT 'two', 'years_exp', two_b1 FROM coefs
  UNION ALL SELECT 'two', 'years_at', two_b2 FROM coefs) t"""
    q["q31_scored"] = lin + \
        "SELECT rec_id, round(p, 4) AS prediction FROM scored"
    q["q32_smape_mape"] = lin + """SELECT 'smape' AS metric,
  round(avg(100.0 * abs(a - p) / NULLIF(abs(a) + abs(p), 0)), 6) AS value,
  count(*) FILTER (WHERE abs(a) + abs(p) = 0) AS n_undefined FROM scored
UNION ALL
SELECT 'mape', round(avg(100.0 * abs(a - p) / NULLIF(abs(a), 0)), 6),
  count(*) FILTER (WHERE abs(a) = 0) FROM scored"""
    q["q33_rmse_r2"] = lin + """SELECT 'rmse' AS metric,
  round(sqrt(avg((p - a) * (p - a))), 6) AS value FROM scored
UNION ALL
SELECT 'r2', round(1 - sum((p - a) * (p - a)) / (var_pop(a) * count(*)), 6)
FROM scored"""
    q["q36_cv_folds"] = _with(COMP, NUMS, """d AS (SELECT years_exp AS x,
  total_comp AS y, CAST(rec_id % 5 AS INTEGER) AS fold FROM nums
  WHERE is_train),
folds AS (SELECT DISTINCT fold AS f FROM d),
fit AS (SELECT f, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0,
  sum(x * y) / sum(x * x) AS b_origin
  FROM folds JOIN d ON d.fold <> folds.f GROUP BY f),
err AS (SELECT f,
  sqrt(avg((y - (b0 + b1 * x)) * (y - (b0 + b1 * x)))) AS rmse0,
  sqrt(avg((y - b_origin * x) * (y - b_origin * x))) AS rmse1
  FROM fit JOIN d ON d.fold = fit.f GROUP BY f)""") + """SELECT
  CAST(0 AS INTEGER) AS point, round(avg(rmse0), 4) AS rmse FROM err
UNION ALL
SELECT CAST(1 AS INTEGER), round(avg(rmse1), 4) FROM err"""
    tvs_pct = HASH_PCT.replace("CAST(rec_id AS VARCHAR)",
                               "'tvs' || CAST(rec_id AS VARCHAR)")
    q["q35b_train_validation_exact"] = _with(COMP, NUMS, f"""d AS (
  SELECT years_exp AS x, total_comp AS y, {tvs_pct} < 75 AS fit FROM nums
  WHERE is_train),
m AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0,
  sum(x * y) / sum(x * x) AS bo FROM d WHERE fit)""") + """SELECT
  CAST(0 AS INTEGER) AS point,
  round(sqrt(avg((y - (b0 + b1 * x)) * (y - (b0 + b1 * x)))), 4) AS rmse
FROM d, m WHERE NOT fit
UNION ALL
SELECT CAST(1 AS INTEGER), round(sqrt(avg((y - bo * x) * (y - bo * x))), 4)
FROM d, m WHERE NOT fit"""
    q["q35c_elastic_split_exact"] = _elastic_sql(f"""pairs AS (
  SELECT 0 AS f, years_exp AS x, total_comp AS y, {tvs_pct} < 75 AS fit
  FROM nums WHERE is_train)""") + """SELECT CAST(point AS INTEGER) AS point,
  round(rmse, 4) AS rmse FROM r"""
    by_fold = _elastic_sql("""d AS (SELECT years_exp AS x,
  total_comp AS y, rec_id % 5 AS fold FROM nums WHERE is_train),
pairs AS (SELECT f, x, y, fold <> f AS fit
  FROM (SELECT DISTINCT fold AS f FROM d) k, d)""")
    q["q36c_elastic_grid_exact"] = by_fold + """SELECT
  CAST(point AS INTEGER) AS point, round(rmse, 4) AS rmse FROM r"""
    q["q36d_elastic_best_exact"] = by_fold + """, best AS (
  SELECT * FROM r ORDER BY rmse, point LIMIT 1)
SELECT 'elasticNetParam' AS param, CAST(mix AS VARCHAR) AS value FROM best
UNION ALL SELECT 'fitIntercept', CASE WHEN icpt THEN 'True' ELSE 'False' END
FROM best
UNION ALL SELECT 'regParam', CAST(reg AS VARCHAR) FROM best"""
    depths = _tree_sql(2, 3)
    q["q38c_tree_cv_depths"] = depths + " UNION ALL ".join(
        f"""SELECT CAST({k} AS INTEGER) AS point, round(avg(rmse), 4) AS rmse
FROM (SELECT d.f, sqrt(avg((y - p) * (y - p))) AS rmse
  FROM d{k + 1} d JOIN (SELECT f, node, avg(y) AS p FROM d{k + 1} WHERE fit
    GROUP BY f, node) m ON m.f = d.f AND m.node = d.node
  WHERE NOT fit GROUP BY d.f)""" for k in range(2))
    q["q40b_forest_grid_exact"] = depths + " UNION ALL ".join(
        f"""SELECT CAST({k + 2 * i} AS INTEGER) AS point, round(avg(rmse), 4)
  AS rmse FROM (SELECT d.f, sqrt(avg((y - p) * (y - p))) AS rmse
  FROM d{k + 1} d JOIN (SELECT f, node, avg(y) AS p FROM d{k + 1} WHERE fit
    GROUP BY f, node) m ON m.f = d.f AND m.node = d.node
  WHERE NOT fit GROUP BY d.f)""" for i in range(2) for k in range(2))
    q["q41c_boost_grid_exact"] = _boost_sql(3, [0.3, 0.1])
    q["q44b_tree_importance"] = _tree_sql(2, None) + """, gains AS (
  SELECT idx, name, coalesce(sum(gain), 0) AS g
  FROM (VALUES (0, 'years_exp'), (1, 'years_at'), (2, 'masters_flag'))
    n(idx, name) LEFT JOIN (SELECT a, gain FROM b0 UNION ALL
    SELECT a, gain FROM b1) s ON s.a = n.idx GROUP BY idx, name)
SELECT CAST(row_number() OVER (ORDER BY g DESC, idx) AS INTEGER) AS rank,
  CAST(idx AS INTEGER) AS idx, name,
  round(g / sum(g) OVER (), 6) AS importance FROM gains"""
    q["q39b_bagged_stumps"] = _bagged_sql(5)
    stump = _stump_sql()
    q["q37_tree_stump"] = stump
    q["q39_forest_stump"] = stump
    q["q41_boost_stump"] = stump
    q["q38b_tree_cv_stump"] = _with(COMP, NUMS, """d AS (SELECT years_exp AS x,
  total_comp AS y, CAST(rec_id % 3 AS INTEGER) AS fold FROM nums
  WHERE is_train),
folds AS (SELECT DISTINCT fold AS f FROM d),
v AS (SELECT f, x, count(*) AS n, sum(y) AS s
  FROM folds JOIN d ON d.fold <> folds.f GROUP BY f, x),
c AS (SELECT f, x, sum(n) OVER (PARTITION BY f ORDER BY x) AS nl,
  sum(s) OVER (PARTITION BY f ORDER BY x) AS sl FROM v),
t AS (SELECT f, sum(n) AS nt, sum(s) AS st FROM v GROUP BY f),
g AS (SELECT c.f, c.x, nl, sl, nt, st,
  sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain
  FROM c JOIN t ON c.f = t.f WHERE nl < nt),
b AS (SELECT f, x AS thr, sl / nl AS pl, (st - sl) / (nt - nl) AS pr FROM (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY gain DESC, x) AS r
  FROM g) WHERE r = 1),
err AS (SELECT b.f, sqrt(avg((d.y - CASE WHEN d.x <= b.thr THEN b.pl
  ELSE b.pr END) * (d.y - CASE WHEN d.x <= b.thr THEN b.pl ELSE b.pr END)))
  AS rmse FROM b JOIN d ON d.fold = b.f GROUP BY b.f)""") + """SELECT
  CAST(0 AS INTEGER) AS point, round(avg(rmse), 4) AS rmse FROM err"""
    q["q42_code_tables"] = enc + """SELECT 'cat_location' AS column_name, value,
  idx + o_loc AS idx FROM idx_cat_location, offs
UNION ALL SELECT 'std_level', value, idx + o_std FROM idx_std_level, offs
UNION ALL SELECT 'cat_title', value, idx + o_title FROM idx_cat_title, offs
UNION ALL SELECT 'gender', value, idx + o_gender FROM idx_gender, offs"""
    q["q43_slot_names"] = enc + \
        "SELECT CAST(idx AS INTEGER) AS idx, name FROM names"
    q["q45_label_correlation"] = enc + \
        "SELECT CAST(idx AS INTEGER) AS idx, name, round(corr, 6) AS corr " \
        "FROM corrs"
    q["q45b_correlation_matrix_row"] = q["q45_label_correlation"]
    q["q46_corr_ranked"] = enc + f"""SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST,
    idx) AS INTEGER) AS rank, CAST(idx AS INTEGER) AS idx, name,
    round(corr, 6) AS corr FROM corrs) t
WHERE rank <= {L.TOP_K}"""
    return q


ORACLE_SQL = build()
