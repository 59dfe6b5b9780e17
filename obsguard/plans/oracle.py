"""DuckDB twins of the registered queries (the driver pre-registers the parquet tables as views).

Fixture views are written once as CTE text and prefixed to each statement.
"""

from __future__ import annotations

OBS_CTE = """
obs AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ado_id,
         epoch_ms(l_shipdate) AS "timestamp",
         concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS obs_key,
         l_quantity AS li_ua_quantity_value,
         CAST(CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 64 WHEN 5 THEN 66
                   WHEN 6 THEN 128 ELSE 3 END AS INTEGER) AS li_ua_quantity_status,
         l_extendedprice AS li_ua_price_value,
         CAST(CASE WHEN l_extendedprice > 60000 THEN 2 ELSE 0 END AS INTEGER) AS li_ua_price_status,
         nullif(l_discount, 0.0) AS li_ua_discount_value,
         l_tax AS li_ua_tax_value,
         CAST(l_linenumber AS INTEGER) AS li_ua_linenumber_value,
         l_returnflag AS li_ua_flag_value,
         1.0::DOUBLE AS li_ua_unit_value
  FROM lineitem
)"""

MARKET_CTE = """
market AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ado_id,
         epoch_ms(l_shipdate) AS "timestamp",
         concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS obs_key,
         l_extendedprice * (1 + l_tax) AS re_ua_high_value,
         l_extendedprice * (1 - l_discount) AS re_ua_low_value,
         l_extendedprice AS re_ua_open_value,
         l_extendedprice * (1 + l_tax - l_discount) AS re_ua_close2_value,
         nullif(l_extendedprice * (1 + l_tax / 2), l_extendedprice) AS re_ua_ask_value,
         l_extendedprice * (1 - l_tax / 2) AS re_ua_bid_value,
         l_extendedprice AS re_ua_mid_value,
         0 AS re_ua_high_status, 0 AS re_ua_low_status, 0 AS re_ua_open_status, 0 AS re_ua_close2_status,
         0 AS re_ua_ask_status, 0 AS re_ua_bid_status, 0 AS re_ua_mid_status
  FROM lineitem
)"""

PRED_CTE = """
pbase AS (
  SELECT CASE WHEN li_ua_price_status = 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS label,
         li_ua_quantity_value AS q, li_ua_price_value AS y, 1500.0 * li_ua_quantity_value AS y_hat
  FROM obs
),
pred AS (
  SELECT 'rule_a' AS model, label, CASE WHEN q > 35 THEN 0.0 ELSE 1.0 END::DOUBLE AS prediction, y, y_hat
  FROM pbase
  UNION ALL
  SELECT 'rule_b' AS model, label, 1.0::DOUBLE AS prediction, y, y_hat FROM pbase
)"""


def binarize_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN ({v} >= 2 AND {v} < 3) OR ({v} >= 66 AND {v} < 67) "
            f"OR ({v} >= 128 AND NOT isnan({v})) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END")


def scaled_sql(x: str, mn: str, mx: str) -> str:
    return f"CASE WHEN {mx} = {mn} THEN 0.5::DOUBLE ELSE ({x} - {mn}) / ({mx} - {mn}) END"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


EVENTS_CTE = """
evobs AS (
  SELECT CAST(user_id AS VARCHAR) AS ado_id,
         epoch_us(ts) // 1000 AS "timestamp",
         CAST(event_id AS VARCHAR) AS obs_key,
         value AS ev_ua_value_value,
         CAST(CASE WHEN value < 0 THEN 2 ELSE 0 END AS INTEGER) AS ev_ua_value_status,
         event_type AS ev_ua_type_value
  FROM events
)"""

# Fixed parameters (equal to catalog.py)
AS_OF_MS = 946598400000
SPLIT_MS = 915148800000
SEED = 42
R = 6

OBS_COLS = ["ado_id", "timestamp", "obs_key", "li_ua_quantity_value", "li_ua_quantity_status", "li_ua_price_value",
            "li_ua_price_status", "li_ua_discount_value", "li_ua_tax_value", "li_ua_linenumber_value",
            "li_ua_flag_value", "li_ua_unit_value"]
OBS_TYPES = {"ado_id": "s", "timestamp": "l", "obs_key": "s", "li_ua_quantity_value": "d",
             "li_ua_quantity_status": "i", "li_ua_price_value": "d", "li_ua_price_status": "i",
             "li_ua_discount_value": "d", "li_ua_tax_value": "d", "li_ua_linenumber_value": "i",
             "li_ua_flag_value": "s", "li_ua_unit_value": "d"}
MARKET_ATTRS = ["re_ua_high", "re_ua_low", "re_ua_open", "re_ua_close2", "re_ua_ask", "re_ua_bid", "re_ua_mid"]
MARKET_COLS = (["ado_id", "timestamp", "obs_key"] + [a + "_value" for a in MARKET_ATTRS]
               + [a + "_status" for a in MARKET_ATTRS])
MARKET_TYPES = {c: ("s" if c in ("ado_id", "obs_key") else "l" if c == "timestamp" else
                    "d" if c.endswith("_value") else "i") for c in MARKET_COLS}


def q(name: str) -> str:
    return f'"{name}"' if name == "timestamp" else name


def rounded(cols, types, digits=R, alias=True) -> str:
    out = []
    for c in cols:
        e = f"round({q(c)}, {digits})" if types.get(c) == "d" else q(c)
        out.append(f"{e} AS {q(c)}" if alias and e != q(c) else e)
    return ", ".join(out)


def draw(key: str, seed: int, mode: str, slot: int) -> str:
    part = f"coalesce(length({key})::VARCHAR || ':' || {key}, '~')"
    return (f"(('0x' || substr(md5(concat_ws('|', {part}, '{seed}', '{mode}')), {1 + 8 * slot}, 8))::BIGINT "
            f"/ 4294967296.0)")


# --- labelled points -------------------------------------------------------------------------

def labeled_ctes(src_cte: str, src: str, where: str, label: str, num_feats: list, str_feats: list,
                 time_feature: bool = False, scale: bool = True) -> tuple[list, list]:
    """CTEs ending in `sc(ado_id, timestamp, label, x0..xn)`; returns (ctes, feature names)."""
    ctes = [src_cte.strip(), f"f AS (SELECT * FROM {src} WHERE {where})"]
    names = ["timestamp"] if time_feature else list(num_feats) + list(str_feats)
    sel = []
    if time_feature:
        sel.append('CAST(f."timestamp" AS DOUBLE) AS x0')
    else:
        for i, c in enumerate(num_feats):
            sel.append(f"TRY_CAST(f.{c} AS DOUBLE) AS x{i}")
    joins = []
    for j, c in enumerate(str_feats):
        ctes.append(f"idx{j} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 "
                    f"AS DOUBLE) AS i FROM f WHERE {c} IS NOT NULL GROUP BY {c})")
        sel.append(f"idx{j}.i AS x{len(num_feats) + j}")
        joins.append(f"JOIN idx{j} ON f.{c} = idx{j}.v")
    ctes.append(f"g AS (SELECT f.ado_id, CAST(f.\"timestamp\" AS DOUBLE) AS \"timestamp\", "
                f"TRY_CAST(f.{label} AS DOUBLE) AS lab, {', '.join(sel)} FROM f {' '.join(joins)})")
    lab = binarize_sql("g.lab") if label.endswith("_status") else "g.lab"
    xs = [f"x{i}" for i in range(len(names))]
    if scale:
        stats = ", ".join(f"min({x}) AS mn_{x}, max({x}) AS mx_{x}" for x in xs)
        ctes.append(f"s AS (SELECT ado_id AS sk, {stats} FROM g GROUP BY ado_id)")
        scaled = ", ".join(f"{scaled_sql('g.' + x, 's.mn_' + x, 's.mx_' + x)} AS {x}" for x in xs)
        ctes.append(f"sc AS (SELECT g.ado_id, g.\"timestamp\", {lab} AS label, {scaled} "
                    f"FROM g JOIN s ON g.ado_id IS NOT DISTINCT FROM s.sk)")
    else:
        ctes.append(f"sc AS (SELECT g.ado_id, g.\"timestamp\", {lab} AS label, {', '.join('g.' + x for x in xs)} "
                    f"FROM g)")
    return ctes, names


def labeled_select(names: list) -> str:
    fs = ", ".join(f"round(x{i}, {R}) AS f_{n}" for i, n in enumerate(names))
    return f'SELECT ado_id, "timestamp", label, {fs} FROM sc'


FLAG_NUMS = ["li_ua_quantity_value", "li_ua_price_value", "li_ua_tax_value", "li_ua_linenumber_value"]


def flagship_sql() -> str:
    ctes, names = labeled_ctes(OBS_CTE, "obs", f'"timestamp" <= {AS_OF_MS}', "li_ua_quantity_status",
                               FLAG_NUMS, ["li_ua_flag_value"])
    means = ", ".join(f"round(avg(x{i}), {R}) AS mean_{n}" for i, n in enumerate(names))
    return with_ctes(*ctes) + f"SELECT ado_id, label, count(*) AS n, {means} FROM sc GROUP BY ado_id, label"


def labeled_points_all_sql() -> str:
    ctes, names = labeled_ctes(OBS_CTE, "obs", f'"timestamp" <= {AS_OF_MS}', "li_ua_quantity_status",
                               FLAG_NUMS, ["li_ua_flag_value"])
    return with_ctes(*ctes) + labeled_select(names)


def labeled_points_time_sql() -> str:
    ctes, names = labeled_ctes(OBS_CTE, "obs", "TRUE", "li_ua_price_value", [], [], time_feature=True)
    return with_ctes(*ctes) + labeled_select(names)


def labeled_points_regression_sql() -> str:
    where = f'"timestamp" <= {AS_OF_MS} AND li_ua_discount_value IS NOT NULL'
    ctes, names = labeled_ctes(OBS_CTE, "obs", where, "li_ua_price_value",
                               ["li_ua_quantity_value", "li_ua_discount_value", "li_ua_tax_value",
                                "li_ua_linenumber_value"], ["li_ua_flag_value"])
    return with_ctes(*ctes) + labeled_select(names)


def load_and_transform_single_sql() -> str:
    ctes, names = labeled_ctes(OBS_CTE, "obs", "TRUE", "li_ua_quantity_value", [], [], time_feature=True)
    return with_ctes(*ctes) + labeled_select(names)


def labeled_points_classification_loader_sql() -> str:
    # features: every _value column but the dropped ones (discount: nulls, unit: constant), flag indexed last
    ctes, names = labeled_ctes(OBS_CTE, "obs", f'"timestamp" <= {AS_OF_MS}', "li_ua_price_status",
                               FLAG_NUMS, ["li_ua_flag_value"])
    return with_ctes(*ctes) + labeled_select(names)


def labeled_points_events_sql() -> str:
    ctes, names = labeled_ctes(EVENTS_CTE, "evobs", "TRUE", "ev_ua_value_status", ["ev_ua_value_value"],
                               ["ev_ua_type_value"])
    return with_ctes(*ctes) + labeled_select(names)


# --- profile / clean -------------------------------------------------------------------------

def _zero_sql(c: str, t: str) -> str:
    x = f"TRY_CAST({q(c)} AS DOUBLE)" if t == "s" else f"CAST({q(c)} AS DOUBLE)"
    return (f"(count({x}) >= 2 AND min({x}) = max({x}) "
            f"AND count(CASE WHEN NOT isfinite({x}) THEN 1 END) = 0)")


def profile_sql(threshold: float, cols=None, types=None, cte: str = OBS_CTE, src: str = "obs") -> str:
    cols = cols or OBS_COLS
    types = types or OBS_TYPES
    parts = []
    for c in cols:
        t = types[c]
        zero = _zero_sql(c, t) if c.endswith("_value") else "FALSE"
        ratio = f"(count(*) - count({q(c)}))::DOUBLE / count(*)"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({q(c)}) AS null_count, "
            f"round({ratio}, {R}) AS null_ratio, CAST({zero} AS INTEGER) AS zero_deviation, "
            f"CAST((({zero}) OR {ratio} > {threshold}) AND count(*) > 0 AS INTEGER) AS dropped FROM {src}")
    return with_ctes(cte) + "\nUNION ALL\n".join(parts)


def describe_sql() -> str:
    parts = []
    for c in OBS_COLS:
        text = OBS_TYPES[c] == "s"
        x = f"TRY_CAST({q(c)} AS DOUBLE)"
        ends = (f"NULL::DOUBLE AS min, NULL::DOUBLE AS max, min({q(c)}) AS min_text, max({q(c)}) AS max_text" if text else
                f"round(min({x}), 2) AS min, round(max({x}), 2) AS max, NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text")
        parts.append(f"SELECT '{c}' AS column_name, count({q(c)}) AS count, round(avg({x}), 2) AS mean, "
                     f"round(stddev_samp({x}), 2) AS stddev, {ends} FROM obs")
    return with_ctes(OBS_CTE) + "\nUNION ALL\n".join(parts)


def profile_from_slices_sql() -> str:
    numbers = [f"SELECT '{c}' AS c, round(avg(x), 2) AS mean, round(stddev_samp(x), 2) AS stddev FROM "
               f"(SELECT TRY_CAST({q(c)} AS DOUBLE) AS x FROM obs)" for c in OBS_COLS]
    whole = profile_sql(0.05)
    head, body = with_ctes(OBS_CTE), whole[len(with_ctes(OBS_CTE)):]
    return (head + f"SELECT p.*, d.mean, d.stddev FROM ({body}) p LEFT JOIN (" + "\nUNION ALL\n".join(numbers) + ") d ON d.c = p.column_name")


SIDES_CTE = """
sides AS (
  SELECT li_ua_price_value / 10000 AS y, (li_ua_quantity_value > 25)::DOUBLE AS high,
         (li_ua_quantity_value > 10 AND li_ua_quantity_value <= 40)::DOUBLE AS middle, (li_ua_linenumber_value > 3)::DOUBLE AS last
  FROM obs
)"""
SIDES = ("high", "middle", "last")


def forest_trees_sql() -> str:
    parts = [f"SELECT '{f}' AS feature, {f} AS side, count(*) AS n_rows, round(avg(y), 5) AS least, round(avg(y), 5) AS most, "
             f"0::BIGINT AS differing FROM sides GROUP BY {f}" for f in SIDES]
    return with_ctes(OBS_CTE, SIDES_CTE) + "\nUNION ALL\n".join(parts)


def boosted_chain_sql() -> str:
    """Three rounds over the cells of the sides: the feature whose split explains most of what is left, its group means,
    the first taken whole, the later ones on twice the residual at step 0.5."""
    ctes = [OBS_CTE, SIDES_CTE, "f0 AS (SELECT high, middle, last, count(*) AS n, avg(y) AS y, 0.0::DOUBLE AS p FROM sides GROUP BY ALL)"]
    for i in range(1, 4):
        rest, step = ("y", "1.0") if i == 1 else ("2 * (y - p)", "0.5")
        groups = "\nUNION ALL\n".join(
            f"SELECT '{f}' AS feature, {f} AS side, sum(n) AS n, sum(n * {rest}) / sum(n) AS m FROM f{i - 1} GROUP BY {f}" for f in SIDES)
        side = "CASE g.feature " + " ".join(f"WHEN '{f}' THEN c.{f}" for f in SIDES) + " END"
        ctes.append(f"g{i} AS ({groups})")
        ctes.append(f"b{i} AS (SELECT feature FROM g{i} GROUP BY feature ORDER BY sum(n * m * m) DESC LIMIT 1)")
        ctes.append(f"f{i} AS (SELECT c.high, c.middle, c.last, c.n, c.y, c.p + {step} * g.m AS p FROM f{i - 1} c, b{i} b JOIN g{i} g "
                    f"ON g.feature = b.feature WHERE g.side = {side})")
    return with_ctes(*ctes) + (
        "SELECT a.high, a.middle, a.last, a.n AS n_rows, round(a.p, 5) AS after_1, round(b.p, 5) AS after_2, round(c.p, 5) AS after_3, "
        "0::BIGINT AS differing FROM f1 a JOIN f2 b USING (high, middle, last) JOIN f3 c USING (high, middle, last)")


def select_obs(cols, where="TRUE") -> str:
    return with_ctes(OBS_CTE) + f"SELECT {', '.join(q(c) for c in cols)} FROM obs WHERE {where}"


# --- injection -------------------------------------------------------------------------------

def _inject_sql(src_cte, src, cols, types, attrs, mode, value_rule, ratio=0.25, extra_ctes=(), from_clause=None,
                guard="TRUE", status_guard="TRUE", seed=SEED, digits=R):
    n = len(attrs)
    d = {k: draw("obs_key", seed, mode, k) for k in range(4)}
    base = (f"b AS (SELECT *, {d[0]} < {ratio} AS _hit, CAST(least(floor({d[1]} * {n}), {n - 1}) AS INTEGER) AS _ai, "
            f"{d[2]} AS _u, {d[3]} < 0.5 AS _low FROM {from_clause or src})")
    out = []
    for c in cols:
        t = types[c]
        e = q(c)
        for j, a in enumerate(attrs):
            sel = f"_hit AND _ai = {j} AND ({guard})"
            if c == a + "_status":
                e = f"CASE WHEN {sel} AND {q(c)} IS NOT NULL AND ({status_guard}) THEN CAST(2 AS INTEGER) ELSE {q(c)} END"
            elif c == a + "_value":
                new = value_rule(c, t)
                if new is not None:
                    e = f"CASE WHEN {sel} AND {q(c)} IS NOT NULL THEN {new} ELSE {q(c)} END"
        if t == "d":
            e = f"round({e}, {digits})"
        out.append(f"{e} AS {q(c)}")
    return with_ctes(src_cte, *extra_ctes, base) + f"SELECT {', '.join(out)} FROM b"


STD_ATTRS = ["li_ua_quantity", "li_ua_price", "li_ua_linenumber"]
ZERO_ATTRS = ["li_ua_quantity", "li_ua_linenumber", "li_ua_flag"]


def _trunc_int(x: str) -> str:
    return f"CAST(trunc(least(greatest({x}, -2147483648.0), 2147483647.0)) AS INTEGER)"


def inject_stddev_sql() -> str:
    sds = ", ".join(f"stddev_samp(CAST({a}_value AS DOUBLE)) AS sd_{a}_value" for a in STD_ATTRS)
    nn = " AND ".join(f"sd_{a}_value IS NOT NULL" for a in STD_ATTRS)
    st = f"st AS (SELECT ado_id AS sk, {sds} FROM obs GROUP BY ado_id HAVING {nn})"
    j = "j AS (SELECT obs.*, st.* FROM obs LEFT JOIN st ON obs.ado_id IS NOT DISTINCT FROM st.sk)"

    def rule(c, t):
        dev = f"((1.0 + _u) * sd_{c} * CASE WHEN _low THEN 2.0 ELSE -2.0 END)"
        if t == "i":
            return _trunc_int(f"CAST({c} AS DOUBLE) + {dev}")
        if t == "d":
            return f"{c} + {dev}"
        return None

    return _inject_sql(OBS_CTE, "obs", OBS_COLS, OBS_TYPES, STD_ATTRS, "stddev", rule, extra_ctes=(st, j),
                       from_clause="j", guard="sk IS NOT NULL")


def inject_zero_sql() -> str:
    def rule(c, t):
        return "CAST(0 AS INTEGER)" if t == "i" else "0.0::DOUBLE" if t == "d" else None

    return _inject_sql(OBS_CTE, "obs", OBS_COLS, OBS_TYPES, ZERO_ATTRS, "zeroes", rule)


def inject_negate_sql() -> str:
    def rule(c, t):
        if t == "i":
            return f"CASE WHEN {c} = -2147483648 THEN {c} ELSE -{c} END"
        return f"-{c}" if t == "d" else None

    return _inject_sql(OBS_CTE, "obs", OBS_COLS, OBS_TYPES, ZERO_ATTRS, "negatives", rule)


def _lo_hi(attrs):
    vals = ", ".join(f"{a}_value" for a in attrs)
    return f"least({vals})", f"greatest({vals})"


def inject_hilo_sql() -> str:
    lo, hi = _lo_hi(MARKET_ATTRS)
    pre = f"m2 AS (SELECT *, {lo} AS _lo, {hi} AS _hi, {hi} - {lo} AS _d FROM market)"

    def rule(c, t):
        if t != "d":
            return None
        if c == "re_ua_high_value":
            return "(_lo - _d) + _d * _u * 0.9 * 2.0 * 2.0"
        if c == "re_ua_low_value":
            return "(_lo + _d) + _d * _u * 0.9 * 2.0 * 2.0"
        return "CASE WHEN _low THEN _lo - _d * (0.1 + _u * 0.9 * 2.0) ELSE _hi + _d * (0.1 + _u * 0.9 * 2.0) END"

    return _inject_sql(MARKET_CTE, "market", MARKET_COLS, MARKET_TYPES, MARKET_ATTRS, "hilo", rule,
                       extra_ctes=(pre,), from_clause="m2", guard="_lo IS NOT NULL")


def inject_spread_sql() -> str:
    attrs = ["re_ua_ask", "re_ua_bid", "re_ua_mid"]
    lo, hi = _lo_hi(attrs)
    pre = f"m2 AS (SELECT *, {lo} AS _lo, {hi} AS _hi FROM market)"

    def rule(c, t):
        if t != "d":
            return None
        return f"{c} + (0.1 + _u * 0.9) * (_hi - _lo) * CASE WHEN _low THEN -2.0 ELSE 2.0 END"

    return _inject_sql(MARKET_CTE, "market", MARKET_COLS, MARKET_TYPES, attrs, "askbidmid", rule,
                       extra_ctes=(pre,), from_clause="m2", guard="_lo IS NOT NULL", status_guard="_hi <> _lo")


EVENT_COLS = ["ado_id", "timestamp", "obs_key", "ev_ua_value_value", "ev_ua_value_status", "ev_ua_type_value"]
EVENT_TYPES = {"ado_id": "s", "timestamp": "l", "obs_key": "s", "ev_ua_value_value": "d", "ev_ua_value_status": "i",
               "ev_ua_type_value": "s"}


def inject_negate_events_sql() -> str:
    def rule(c, t):
        return f"-{c}" if t == "d" else None

    return _inject_sql(EVENTS_CTE, "evobs", EVENT_COLS, EVENT_TYPES, ["ev_ua_value", "ev_ua_type"], "negatives",
                       rule)


def inject_stack_sql() -> str:
    cols = ["obs_key", "ado_id", "timestamp", "li_ua_quantity_value", "li_ua_quantity_status"]
    types = {c: OBS_TYPES[c] for c in cols}
    z = _inject_sql(OBS_CTE, "obs", cols, types, ["li_ua_quantity"], "zeroes",
                    lambda c, t: "0.0::DOUBLE" if t == "d" else None, ratio=0.1, digits=15)
    n = _inject_sql(OBS_CTE, "obs", cols, types, ["li_ua_quantity"], "negatives",
                    lambda c, t: f"-{c}" if t == "d" else None, ratio=0.1, digits=15)
    return (f"SELECT *, 'zero' AS variant FROM ({z})\nUNION ALL\n"
            f"SELECT *, 'negative' AS variant FROM ({n})")


# --- metrics ---------------------------------------------------------------------------------

def classification_report_sql(legacy: bool = False) -> str:
    y, p = ("prediction", "label") if legacy else ("label", "prediction")
    agg = (f"a AS (SELECT model, count(*) AS n, count(CASE WHEN {y} = {p} THEN 1 END) AS correct, "
           f"count(CASE WHEN {y} = 0.0 AND {p} = 0.0 THEN 1 END) AS tp, "
           f"count(CASE WHEN {y} <> 0.0 AND {p} = 0.0 THEN 1 END) AS fp, "
           f"count(CASE WHEN {y} = 0.0 AND {p} <> 0.0 THEN 1 END) AS fn, "
           f"count(CASE WHEN {y} <> 0.0 AND {p} <> 0.0 THEN 1 END) AS tn, "
           f"count(CASE WHEN {y} = 1.0 AND {p} = 1.0 THEN 1 END) AS atp, "
           f"count(CASE WHEN {y} <> 1.0 AND {p} = 1.0 THEN 1 END) AS afp, "
           f"count(CASE WHEN {y} = 1.0 THEN 1 END) AS ap FROM pred GROUP BY model)")
    b = ("b AS (SELECT *, CASE WHEN tp + fn > 0 THEN coalesce(CASE WHEN tp + fp <> 0 THEN tp::DOUBLE / (tp + fp) END, 0.0) END AS prec, "
         "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS tpr, "
         "CASE WHEN tp + fn > 0 THEN CASE WHEN fp + tn <> 0 THEN fp::DOUBLE / (fp + tn) END END AS fpr, "
         "CASE WHEN ap <> 0 THEN atp::DOUBLE / ap END AS a_tpr, "
         "CASE WHEN n - ap <> 0 THEN afp::DOUBLE / (n - ap) END AS a_fpr, "
         "coalesce(CASE WHEN atp + afp <> 0 THEN atp::DOUBLE / (atp + afp) END, CASE WHEN n <> 0 THEN ap::DOUBLE / n END) AS a_prec, "
         "CASE WHEN n <> 0 THEN ap::DOUBLE / n END AS base_rate FROM a)")
    sel = (f"SELECT model, round(CASE WHEN n <> 0 THEN correct::DOUBLE / n END, {R}) AS accuracy, "
           f"round(prec, {R}) AS precision, round(tpr, {R}) AS true_positive_rate, "
           f"round(fpr, {R}) AS false_positive_rate, round(1.0 - fpr, {R}) AS true_negative_rate, "
           f"round(1.0 - tpr, {R}) AS false_negative_rate, "
           f"round(CASE WHEN tp + fn > 0 THEN CASE WHEN prec + tpr = 0 THEN 0.0 ELSE 2.0 * prec * tpr / (prec + tpr) END END, {R}) AS f1, "
           f"round(CASE WHEN ap = 0 THEN 0.0 WHEN n - ap = 0 THEN 1.0 ELSE (1.0 + a_tpr - a_fpr) / 2.0 END, {R}) AS area_under_roc, "
           f"round(CASE WHEN ap = 0 THEN 0.0 WHEN n - ap = 0 THEN 1.0 ELSE a_tpr * a_prec + (1.0 - a_tpr) * (a_prec + base_rate) / 2.0 END, {R}) AS area_under_pr "
           f"FROM b")
    return with_ctes(OBS_CTE, PRED_CTE, agg, b) + sel


def regression_report_sql() -> str:
    return with_ctes(OBS_CTE, PRED_CTE) + (
        "SELECT model, round(avg((y_hat - y) * (y_hat - y)), 4) AS mse, "
        "round(sqrt(avg((y_hat - y) * (y_hat - y))), 4) AS rmse, "
        "round(1.0 - avg((y_hat - y) * (y_hat - y)) / var_pop(y), 4) AS r2, "
        "round(avg(abs(y_hat - y)), 4) AS mae FROM pred GROUP BY model")


# --- registry --------------------------------------------------------------------------------

def _scale_sql(global_: bool) -> str:
    xs = FLAG_NUMS
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in xs)
    g = f"g AS (SELECT obs_key, ado_id, {cast} FROM obs)"
    stats = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in xs)
    if global_:
        s = f"s AS (SELECT {stats} FROM g)"
        on = "TRUE"
    else:
        s = f"s AS (SELECT ado_id AS sk, {stats} FROM g GROUP BY ado_id)"
        on = "g.ado_id IS NOT DISTINCT FROM s.sk"
    sc = ", ".join(f"round({scaled_sql('g.' + c, 's.mn_' + c, 's.mx_' + c)}, {R}) AS {c}" for c in xs)
    return with_ctes(OBS_CTE, g, s) + f"SELECT g.obs_key, g.ado_id, {sc} FROM g JOIN s ON {on}"


CATEGORICAL_FEATURES = ["li_ua_linenumber_value", "li_ua_tax_value", "li_ua_quantity_value", "li_ua_price_value"]


def categorical_map_sql(max_categories: int = 32) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS feature_index, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM obs"
        for i, c in enumerate(CATEGORICAL_FEATURES))
    return with_ctes(OBS_CTE, f"v AS ({parts})", "d AS (SELECT DISTINCT feature_index, feature, value FROM v)",
                     f"k AS (SELECT feature_index FROM d GROUP BY feature_index HAVING count(*) <= {max_categories})") + (
        "SELECT feature_index, feature, value, CAST(row_number() OVER (PARTITION BY feature_index "
        "ORDER BY value <> 0.0, value) - 1 AS INTEGER) AS category FROM d "
        "WHERE feature_index IN (SELECT feature_index FROM k)")


LEARNABLE_CTE = """
lb AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ado_id, epoch_ms(l_shipdate) AS "timestamp",
         concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS obs_key,
         CASE WHEN l_linenumber > 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS b, l_quantity AS quantity
  FROM lineitem
)"""

CLASSIFIERS = ["decision_tree", "random_forest", "gbt", "mlp", "logistic", "naive_bayes"]
REGRESSORS = ["linear", "glm", "decision_tree", "random_forest", "gbt", "isotonic"]


NOISY_CTE = LEARNABLE_CTE.strip() + """,
nz AS (
  SELECT lb.*, CASE WHEN (b = 1) <> (quantity % 5 = 0) THEN 0.0 ELSE 1.0 END::DOUBLE AS label, 1 - b AS best,
         10 * b + 5 + quantity % 5 - 2 AS y FROM lb)"""


def train_sql(task: str, family: str) -> str:
    """A noisy label is predicted by its majority, or its mean, on either side of b."""
    if (task, family) == ("regression", "random_forest"):
        return with_ctes(LEARNABLE_CTE) + ("SELECT (10.0 * b + 5.0)::DOUBLE AS label, (10.0 * b + 5.0)::DOUBLE AS prediction, count(*) AS n "
                                           "FROM lb GROUP BY b")
    if task == "classification":
        return with_ctes(NOISY_CTE, "m AS (SELECT b, (avg(label) > 0.5)::INT::DOUBLE AS prediction FROM nz GROUP BY b)") + (
            "SELECT label, prediction, count(*) AS n FROM nz JOIN m USING (b) GROUP BY ALL")
    return with_ctes(NOISY_CTE, "m AS (SELECT b, round(avg(y), 3) AS prediction FROM nz GROUP BY b)") + (
        "SELECT y AS label, prediction, count(*) AS n FROM nz JOIN m USING (b) GROUP BY ALL")


def naive_bayes_sql() -> str:
    lab = binarize_sql("CAST(li_ua_price_status AS DOUBLE)")
    base = (f"p AS (SELECT {lab} AS label, count(*) AS n, sum(li_ua_quantity_value) AS f0, "
            f"sum(li_ua_linenumber_value)::DOUBLE AS f1 FROM obs GROUP BY 1)")
    parts = []
    for s in (0.0, 1.0, 2.0):
        for j, name in enumerate(("li_ua_quantity_value", "li_ua_linenumber_value")):
            parts.append(f"SELECT {s}::DOUBLE AS smoothing, label, '{name}' AS feature, "
                         f"round(ln(n + {s}) - ln((SELECT sum(n) FROM p) + 2 * {s}), {R}) AS pi, "
                         f"round(ln(f{j} + {s}) - ln(f0 + f1 + 2 * {s}), {R}) AS theta FROM p")
    return with_ctes(OBS_CTE, base) + " UNION ALL ".join(parts)


def line_sql() -> str:
    return with_ctes(OBS_CTE) + (
        "SELECT round(regr_slope(li_ua_price_value, li_ua_quantity_value), 4) AS slope, "
        "round(regr_intercept(li_ua_price_value, li_ua_quantity_value), 2) AS intercept FROM obs")


HIGH_CTE = """
h AS (SELECT CASE WHEN li_ua_quantity_value > 35 THEN 1.0 ELSE 0.0 END::DOUBLE AS high, li_ua_price_value AS price,
             CASE WHEN li_ua_price_status = 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM obs)"""


def log_odds_sql() -> str:
    lo = "ln(sum(label) FILTER (high = {v}) / sum(1 - label) FILTER (high = {v}))"
    a, b = lo.format(v=0), lo.format(v=1)
    return with_ctes(OBS_CTE, HIGH_CTE) + f"SELECT round({a}, 3) AS intercept, round({b} - {a}, 3) AS coefficient FROM h"


def tree_leaves_sql() -> str:
    return with_ctes(OBS_CTE, HIGH_CTE) + (
        "SELECT high, round(avg(price), 2) AS leaf, count(*) AS n, 'regression' AS task FROM h GROUP BY high UNION ALL "
        "SELECT high, CASE WHEN sum(label) > count(*) / 2.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS leaf, count(*) AS n, "
        "'classification' AS task FROM h GROUP BY high")


def evaluate_classification_sql() -> str:
    """All families predict the training majority of each side of b; the metrics follow from the counts of the other rows."""
    models = ", ".join(f"('{m}')" for m in CLASSIFIERS)
    held = f"NOT ({draw('obs_key', SEED, 'split', 0)} < 0.8)"
    return with_ctes(NOISY_CTE, f"x AS (SELECT *, {held} AS held FROM nz)",
                     "m AS (SELECT b, (avg(label) > 0.5)::INT::DOUBLE AS p FROM x WHERE NOT held GROUP BY b)",
                     "t AS (SELECT label AS y, p FROM x JOIN m USING (b) WHERE held)",
                     "k AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y = p) AS ok, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tp, "
                     "count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fn, "
                     "count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tn FROM t)",
                     "r AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, tn / (tn + fn) AS apr, "
                     "(fp + tn) / n AS base FROM k)") + (
        f"SELECT model, round(ok / n, 3) AS accuracy, round(pr, 3) AS precision, round(tpr, 3) AS true_positive_rate, "
        "round(1 - fpr, 3) AS true_negative_rate, round(2 * pr * tpr / (pr + tpr), 3) AS f1, round((1 + (1 - fpr) - (1 - tpr)) / 2, 3) AS area_under_roc, "
        "round((1 - fpr) * apr + fpr * (apr + base) / 2, 3) AS area_under_pr, round(fpr, 3) AS false_positive_rate, "
        "round(1 - tpr, 3) AS false_negative_rate, n::BIGINT AS n_rows, NULL::VARCHAR AS error, 0::BIGINT AS dropped_labels "
        f"FROM r, (VALUES {models}) v(model)")


def _late_rows() -> str:
    return with_ctes(LEARNABLE_CTE, f't AS (SELECT * FROM lb WHERE "timestamp" > {SPLIT_MS})')


def evaluate_regression_sql() -> str:
    """All families predict the mean of early rows on each side of b."""
    models = ", ".join(f"('{m}')" for m in REGRESSORS)
    digits = "CASE model WHEN 'random_forest' THEN 1 ELSE 3 END"
    return with_ctes(NOISY_CTE, f'm AS (SELECT b, avg(y) AS p FROM nz WHERE "timestamp" <= {SPLIT_MS} GROUP BY b)',
                     f'k AS (SELECT count(*) AS n_rows, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v '
                     f'FROM nz JOIN m USING (b) WHERE "timestamp" > {SPLIT_MS})') + (
        f"SELECT model, round(mse, {digits}) AS mse, round(sqrt(mse), {digits}) AS rmse, round(1 - mse / v, {digits}) AS r2, "
        f"round(mae, {digits}) AS mae, n_rows, NULL::VARCHAR AS error, 0::BIGINT AS dropped_labels FROM k, (VALUES {models}) v(model)")


def evaluate_time_series_sql() -> str:
    models = ", ".join(f"('{m}')" for m in REGRESSORS)
    return _late_rows() + ("SELECT model, (SELECT count(*) FROM t) AS n_rows, 0::BIGINT AS dropped_labels, "
                           f"NULL::VARCHAR AS error, true AS scored FROM (VALUES {models}) v(model)")


HELD = f"NOT ({draw('obs_key', SEED, 'split', 0)} < 0.8)"


def tree_grid_sql() -> str:
    """One split on a 0/1 feature: its gain by either impurity decides which cells split; leaves say their majority."""
    def impurity(kind, n, ones):
        p, r = f"({ones})::DOUBLE / ({n})", f"(1 - ({ones})::DOUBLE / ({n}))"
        if kind == "gini":
            return f"(1 - {p} * {p} - {r} * {r})"
        return f"(- CASE WHEN {p} > 0 THEN {p} * log2({p}) ELSE 0 END - CASE WHEN {r} > 0 THEN {r} * log2({r}) ELSE 0 END)"

    gains = ", ".join(f"{impurity(k, 'n0 + n1', 's0 + s1')} - n0::DOUBLE / (n0 + n1) * {impurity(k, 'n0', 's0')} "
                      f"- n1::DOUBLE / (n0 + n1) * {impurity(k, 'n1', 's1')} AS {k}" for k in ("gini", "entropy"))
    high = HIGH_CTE.strip().replace("SELECT CASE", f"SELECT {HELD} AS held, CASE", 1)
    return with_ctes(OBS_CTE, high,
                     "t AS (SELECT count(*) FILTER (high = 0) AS n0, count(*) FILTER (high = 1) AS n1, sum(label) FILTER (high = 0) AS s0, "
                     "sum(label) FILTER (high = 1) AS s1 FROM h WHERE NOT held)",
                     f"g AS (SELECT *, {gains}, (2 * s0 > n0)::INT AS l0, (2 * s1 > n1)::INT AS l1, (2 * (s0 + s1) > n0 + n1)::INT AS l FROM t)",
                     "v AS (SELECT avg((label = CASE WHEN high = 1 THEN l1 ELSE l0 END)::INT) AS split, avg((label = l)::INT) AS root FROM h, g WHERE held)",
                     "c AS (SELECT CAST(((a.i * 2 + b.i) * 4 + d.i) AS INTEGER) AS cell, a.v AS min_info_gain, b.v AS impurity, d.v AS max_depth "
                     "FROM (VALUES (0, 1.0::DOUBLE), (1, 0.5::DOUBLE), (2, 0.1::DOUBLE), (3, 0.0::DOUBLE)) a(i, v), (VALUES (0, 'gini'), (1, 'entropy')) b(i, v), "
                     "(VALUES (0, 3), (1, 5), (2, 7), (3, 9)) d(i, v))",
                     "m AS (SELECT cell, min_info_gain, impurity, CAST(max_depth AS INTEGER) AS max_depth, "
                     "CASE WHEN CASE impurity WHEN 'gini' THEN gini ELSE entropy END >= min_info_gain THEN split ELSE root END AS metric FROM c, g, v)") + (
        f"SELECT cell, min_info_gain, impurity, max_depth, 'accuracy' AS metric_name, round(metric, {R}) AS metric, "
        "cell = (SELECT min(cell) FROM m WHERE metric = (SELECT max(metric) FROM m)) AS chosen FROM m")


def linear_grid_sql() -> str:
    """Elastic net on one feature in closed form, from the moments of the training rows; error from those of the others."""
    return with_ctes(OBS_CTE,
                     f"d AS (SELECT {HELD} AS held, li_ua_quantity_value AS x, li_ua_price_value / 10000 AS y FROM obs)",
                     "t AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, covar_pop(x, y) AS cxy, avg(x * x) AS rxx, "
                     "avg(x * y) AS rxy FROM d WHERE NOT held)",
                     "c AS (SELECT CAST(((i.i * 6 + e.i) * 4 + r.i) * 2 + f.i AS INTEGER) AS cell, r.v AS reg_param, e.v AS elastic_net, f.v AS fit_intercept "
                     "FROM range(4) i(i), (VALUES (0, 0.0::DOUBLE), (1, 0.2::DOUBLE), (2, 0.4::DOUBLE), (3, 0.6::DOUBLE), (4, 0.8::DOUBLE), (5, 1.0::DOUBLE)) e(i, v), "
                     "(VALUES (0, 0.0::DOUBLE), (1, 0.1::DOUBLE), (2, 0.01::DOUBLE), (3, 0.001::DOUBLE)) r(i, v), (VALUES (0, true), (1, false)) f(i, v))",
                     "s AS (SELECT c.*, t.*, CASE WHEN fit_intercept THEN 1.0 ELSE rxx / (sx * sx) END AS a, "
                     "CASE WHEN fit_intercept THEN cxy ELSE rxy END / (sx * sy) AS b, reg_param / sy * elastic_net AS l1, reg_param / sy * (1 - elastic_net) AS l2 FROM c, t)",
                     "w AS (SELECT *, sign(b) * greatest(abs(b) - l1, 0) / (a + l2) * sy / sx AS slope FROM s)",
                     "z AS (SELECT *, CASE WHEN fit_intercept THEN my - slope * mx ELSE 0.0 END AS icept FROM w)",
                     "held AS (SELECT x, y FROM d WHERE held)") + (
        f"SELECT cell, reg_param, elastic_net, fit_intercept, round(sqrt(avg((y - slope * x - icept) * (y - slope * x - icept))), {R}) AS rmse "
        "FROM z, held GROUP BY ALL")


def _slices_ctes() -> tuple:
    return (OBS_CTE.strip(), f"""early AS (SELECT * FROM obs WHERE "timestamp" <= {SPLIT_MS} AND CAST(ado_id AS INTEGER) % 5 <> 0 AND li_ua_flag_value <> 'R')""",
            f'late AS (SELECT * FROM obs WHERE "timestamp" > {SPLIT_MS})')


def serve_features_sql() -> str:
    feats = ["li_ua_quantity_value", "li_ua_price_value", "li_ua_tax_value", "li_ua_linenumber_value", "flag"]
    both = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(feats))
    out = ", ".join(
        f"round(CASE WHEN {h} = {lo} THEN 0.5 ELSE (l.{c} - {lo}) / ({h} - {lo}) END, {R}) AS \"f_{'li_ua_flag_value' if c == 'flag' else c}\""
        for c, lo, h in ((c, f"(CASE WHEN r.ado_id IS NULL THEN a.lo{i} ELSE r.lo{i} END)", f"(CASE WHEN r.ado_id IS NULL THEN a.hi{i} ELSE r.hi{i} END)")
                         for i, c in enumerate(feats)))
    return with_ctes(*_slices_ctes(),
                     "idx AS (SELECT li_ua_flag_value AS v, (row_number() OVER (ORDER BY count(*) DESC, li_ua_flag_value) - 1)::DOUBLE AS flag FROM early GROUP BY 1)",
                     "known AS (SELECT e.*, flag FROM early e JOIN idx ON v = li_ua_flag_value)",
                     f"rng AS (SELECT ado_id, {both} FROM known GROUP BY ado_id)", f"whole AS (SELECT {both} FROM known)",
                     "new AS (SELECT late.*, coalesce(flag, (SELECT count(*) FROM idx))::DOUBLE AS flag FROM late LEFT JOIN idx ON v = li_ua_flag_value)") + (
        f'SELECT l.ado_id, "timestamp"::DOUBLE AS "timestamp", obs_key, {binarize_sql("CAST(li_ua_quantity_status AS DOUBLE)")} AS label, {out} '
        "FROM new l LEFT JOIN rng r ON l.ado_id = r.ado_id, whole a")


def serve_sql() -> str:
    scaled = 'CASE WHEN r.hi = r.lo THEN 0.5 ELSE ("timestamp" - r.lo)::DOUBLE / (r.hi - r.lo) END'
    new = 'CASE WHEN coalesce(r.hi, w.hi) = coalesce(r.lo, w.lo) THEN 0.5 ELSE ("timestamp" - coalesce(r.lo, w.lo))::DOUBLE / (coalesce(r.hi, w.hi) - coalesce(r.lo, w.lo)) END'
    return with_ctes(*_slices_ctes(),
                     'r AS (SELECT ado_id, min("timestamp") AS lo, max("timestamp") AS hi FROM early GROUP BY ado_id)',
                     "w AS (SELECT min(lo) AS lo, max(hi) AS hi FROM r)",
                     f"m AS (SELECT regr_slope(li_ua_price_value, {scaled}) AS slope, regr_intercept(li_ua_price_value, {scaled}) AS icept "
                     "FROM early JOIN r USING (ado_id))") + (
        f"SELECT l.ado_id, 'linear' AS model, count(*) AS n, round(avg(slope * ({new}) + icept), 1) AS mean_prediction, 0::BIGINT AS fitted_again "
        "FROM late l LEFT JOIN r ON l.ado_id = r.ado_id, w, m GROUP BY l.ado_id")


def isotonic_steps_sql() -> str:
    """The fit at a value is the greatest over starts, of the least over ends, of the mean from start to end."""
    return with_ctes(OBS_CTE,
                     'p AS (SELECT "timestamp" AS x, count(*) AS n, sum(li_ua_price_value) AS s FROM obs GROUP BY 1)',
                     "c AS (SELECT x, n, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(s) OVER (ORDER BY x) AS cs FROM p)",
                     "z AS (SELECT 1 AS a, 0::HUGEINT AS cn, 0::DOUBLE AS cs UNION ALL SELECT i + 1, cn, cs FROM c)",
                     "m AS (SELECT a, i, (c.cs - z.cs) / (c.cn - z.cn) AS mean FROM z JOIN c ON c.i >= z.a)",
                     "f AS (SELECT a, i, min(mean) OVER (PARTITION BY a ORDER BY i DESC) AS lo, max(mean) OVER (PARTITION BY a ORDER BY i DESC) AS hi FROM m)",
                     "g AS (SELECT i, max(lo) AS up, min(hi) AS down FROM f GROUP BY i)") + (
        'SELECT true AS rising, x AS "timestamp", n, round(up, 4) AS value FROM c JOIN g USING (i) UNION ALL '
        'SELECT false, x, n, round(down, 4) FROM c JOIN g USING (i)')


def three_strings_sql() -> str:
    cte = OBS_CTE.strip() + ",\n" + """
obs3 AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ado_id, epoch_ms(l_shipdate) AS "timestamp", l_quantity AS li_ua_quantity_value,
         CAST(CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 64 WHEN 5 THEN 66
                   WHEN 6 THEN 128 ELSE 3 END AS INTEGER) AS li_ua_quantity_status,
         l_extendedprice AS li_ua_price_value, nullif(l_discount, 0.0) AS li_ua_discount_value, l_tax AS li_ua_tax_value,
         CAST(l_linenumber AS INTEGER) AS li_ua_linenumber_value, l_returnflag AS li_ua_flag_value,
         l_linestatus AS li_ua_state_value, concat_ws('-', l_returnflag, l_linenumber) AS li_ua_mark_value
  FROM lineitem
)"""
    ctes, names = labeled_ctes(cte, "obs3", "li_ua_discount_value IS NOT NULL", "li_ua_quantity_status",
                               ["li_ua_quantity_value", "li_ua_price_value", "li_ua_discount_value", "li_ua_tax_value",
                                "li_ua_linenumber_value"],
                               ["li_ua_flag_value", "li_ua_state_value", "li_ua_mark_value"])
    return with_ctes(*ctes) + labeled_select(names)


def null_hot_sql() -> str:
    xs = FLAG_NUMS
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in xs)
    g = f"g AS (SELECT obs_key, CASE WHEN li_ua_linenumber_value > 2 THEN ado_id END AS ado_id, {cast} FROM obs)"
    s = ("s AS (SELECT ado_id AS sk, " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in xs)
         + " FROM g GROUP BY ado_id)")
    sc = ", ".join(f"round({scaled_sql('g.' + c, 's.mn_' + c, 's.mx_' + c)}, {R}) AS {c}" for c in xs)
    return with_ctes(OBS_CTE, g, s) + f"SELECT g.obs_key, g.ado_id, {sc} FROM g JOIN s ON g.ado_id IS NOT DISTINCT FROM s.sk"


def keeps_columns_sql() -> str:
    """The negation injector beside columns named like helpers."""
    d = {k: draw("obs_key", SEED, "negatives", k) for k in range(2)}
    return with_ctes(OBS_CTE) + (
        f'SELECT obs_key, ado_id, "timestamp", CASE WHEN {d[0]} < 0.25 AND li_ua_quantity_value IS NOT NULL '
        f"THEN -li_ua_quantity_value ELSE li_ua_quantity_value END AS li_ua_quantity_value, "
        f"CASE WHEN {d[0]} < 0.25 AND li_ua_quantity_status IS NOT NULL THEN CAST(2 AS INTEGER) ELSE li_ua_quantity_status END "
        f'AS li_ua_quantity_status, li_ua_tax_value AS "__batch", li_ua_flag_value AS "_hit", li_ua_linenumber_value AS "_u" '
        f"FROM obs")


def registered() -> dict:
    value_cols = [c for c in OBS_COLS]
    to_double = ", ".join(q(c) if c in ("ado_id", "obs_key") else f"TRY_CAST({q(c)} AS DOUBLE) AS {q(c)}"
                          for c in OBS_COLS)
    split_d = draw("obs_key", SEED, "split", 0)
    return {
        "flagship_entity_label_means": flagship_sql(),
        "scan_all": "SELECT * FROM lineitem",
        "scan_attribute": select_obs(["ado_id", "timestamp", "li_ua_price_value"]),
        "profile_columns": profile_sql(0.0),
        "profile_columns_t05": profile_sql(0.05),
        "describe_columns": describe_sql(),
        "profile_from_slices": profile_from_slices_sql(),
        "drop_incomplete_columns": select_obs([c for c in OBS_COLS
                                               if c not in ("li_ua_discount_value", "li_ua_unit_value")]),
        "drop_incomplete_columns_t05": select_obs([c for c in OBS_COLS if c != "li_ua_unit_value"]),
        "complete_rows": select_obs(OBS_COLS, " AND ".join(f"{q(c)} IS NOT NULL" for c in OBS_COLS)),
        "complete_rows_subset": with_ctes(MARKET_CTE) + (
            "SELECT * FROM market WHERE re_ua_ask_value IS NOT NULL AND re_ua_bid_value IS NOT NULL"),
        "as_of": select_obs(OBS_COLS, f'"timestamp" <= {AS_OF_MS}'),
        "split_by_date": with_ctes(OBS_CTE) + (
            f'SELECT obs_key, ado_id, "timestamp", CASE WHEN "timestamp" <= {SPLIT_MS} THEN 0 ELSE 1 END AS part '
            f'FROM obs WHERE "timestamp" IS NOT NULL'),
        "hash_split": with_ctes(OBS_CTE) + (
            f'SELECT obs_key, ado_id, "timestamp", CASE WHEN {split_d} < 0.8 THEN 0 ELSE 1 END AS part FROM obs'),
        "select_by_type_strict": select_obs(["li_ua_quantity_value", "li_ua_price_value", "li_ua_discount_value",
                                             "li_ua_tax_value", "li_ua_unit_value"]),
        "select_by_type": select_obs(["li_ua_quantity_value", "li_ua_price_value", "li_ua_discount_value",
                                      "li_ua_tax_value", "li_ua_unit_value", "li_ua_quantity_status",
                                      "li_ua_price_status"]),
        "select_drop_columns": select_obs(["obs_key", "ado_id", "li_ua_tax_value"]),
        "to_double": with_ctes(OBS_CTE) + f"SELECT {to_double} FROM obs",
        "binarize_status": with_ctes(OBS_CTE) + (
            f"SELECT obs_key, li_ua_quantity_status, li_ua_price_status, "
            f"{binarize_sql('CAST(li_ua_quantity_status AS DOUBLE)')} AS label_quantity, "
            f"{binarize_sql('CAST(li_ua_price_status AS DOUBLE)')} AS label_price FROM obs"),
        "index_strings": with_ctes(OBS_CTE) + (
            "SELECT obs_key, li_ua_tax_value, CAST(i AS DOUBLE) AS li_ua_flag_value FROM obs JOIN "
            "(SELECT li_ua_flag_value AS v, row_number() OVER (ORDER BY count(*) DESC, li_ua_flag_value) - 1 AS i "
            "FROM obs WHERE li_ua_flag_value IS NOT NULL GROUP BY li_ua_flag_value) x ON obs.li_ua_flag_value = x.v"),
        "index_strings_shuffled": with_ctes(OBS_CTE) + (
            "SELECT obs_key, li_ua_tax_value, CAST(i AS DOUBLE) AS li_ua_flag_value FROM obs JOIN "
            "(SELECT li_ua_flag_value AS v, row_number() OVER (ORDER BY count(*) DESC, li_ua_flag_value) - 1 AS i "
            "FROM obs WHERE li_ua_flag_value IS NOT NULL GROUP BY li_ua_flag_value) x ON obs.li_ua_flag_value = x.v"),
        "index_strings_events": with_ctes(EVENTS_CTE) + (
            "SELECT obs_key, CAST(i AS DOUBLE) AS ev_ua_type_value FROM evobs JOIN "
            "(SELECT ev_ua_type_value AS v, row_number() OVER (ORDER BY count(*) DESC, ev_ua_type_value) - 1 AS i "
            "FROM evobs WHERE ev_ua_type_value IS NOT NULL GROUP BY ev_ua_type_value) x ON evobs.ev_ua_type_value = x.v"),
        "minmax_by_entity": _scale_sql(False),
        "minmax_by_entity_shuffled": _scale_sql(False),
        "minmax_global": _scale_sql(True),
        "labeled_points_all": labeled_points_all_sql(),
        "labeled_points_time": labeled_points_time_sql(),
        "labeled_points_regression": labeled_points_regression_sql(),
        "labeled_points_events": labeled_points_events_sql(),
        "sort_by_time": with_ctes(OBS_CTE) + (
            'SELECT obs_key, ado_id, "timestamp", row_number() OVER (ORDER BY "timestamp", ado_id, obs_key) - 1 AS position '
            'FROM obs'),
        "as_of_timestamp": with_ctes(OBS_CTE) + (
            f"SELECT {', '.join(q(c) if c != 'timestamp' else 'make_timestamp(' + q(c) + ' * 1000) AS ' + q(c) for c in OBS_COLS)} "
            f'FROM obs WHERE "timestamp" <= {AS_OF_MS}'),
        "split_by_date_timestamp": with_ctes(OBS_CTE) + (
            f'SELECT obs_key, ado_id, CASE WHEN "timestamp" <= {SPLIT_MS} THEN 0 ELSE 1 END AS part FROM obs '
            f'WHERE "timestamp" IS NOT NULL'),
        "labeled_points_timestamp": labeled_points_all_sql(),
        "labeled_points_three_strings": three_strings_sql(),
        "inject_keeps_columns": keeps_columns_sql(),
        "minmax_by_entity_null_hot": null_hot_sql(),
        "naive_bayes_parameters": naive_bayes_sql(),
        "glm_fit_coefficients": line_sql(),
        "logistic_log_odds": log_odds_sql(),
        "tree_leaves": tree_leaves_sql(),
        "isotonic_invariants": with_ctes(OBS_CTE) + (
            "SELECT count(*) AS n_rows, count(DISTINCT li_ua_quantity_value) AS n_values, 0::BIGINT AS n_falls, "
            "round(sum(li_ua_price_value), 0) AS sum_prediction FROM obs"),
        "validation_cells": with_ctes(LEARNABLE_CTE) + (
            "SELECT CAST(c AS INTEGER) AS cell, 'accuracy' AS metric_name, 1.0::DOUBLE AS metric, c = 0 AS chosen, "
            "(SELECT count(*) FROM lb) AS n_rows FROM range(8) r(c)"),
        **{f"train_classification_{f}": train_sql("classification", f) for f in CLASSIFIERS},
        **{f"train_regression_{f}": train_sql("regression", f) for f in REGRESSORS},
        "isotonic_steps": isotonic_steps_sql(),
        "tree_grid_cells": tree_grid_sql(),
        "forest_trees_as_table": forest_trees_sql(),
        "boosted_chain_as_table": boosted_chain_sql(),
        "linear_grid_one_pass": linear_grid_sql(),
        "serve_features_on_new_rows": serve_features_sql(),
        "serve_on_new_rows": serve_sql(),
        "registry_roundtrip": with_ctes(OBS_CTE) + (
            f"SELECT {binarize_sql('CAST(li_ua_price_status AS DOUBLE)')} AS label, count(*) AS n, 0::BIGINT AS differing "
            "FROM obs GROUP BY 1"),
        "registry_listing": (
            "SELECT 'regression' AS task, attribute, 'linear' AS family, version::BIGINT AS version, "
            "(SELECT count(*) FROM lineitem) AS trained_rows, 'li_ua_quantity_value' AS features "
            "FROM (VALUES ('li_ua_price', 2), ('li_ua_tax', 1)) v(attribute, version)"),
        "evaluate_classification": evaluate_classification_sql(),
        "evaluate_regression": evaluate_regression_sql(),
        "evaluate_time_series": evaluate_time_series_sql(),
        "entity_counts": with_ctes(OBS_CTE) + "SELECT ado_id, count(*) AS n_rows FROM obs GROUP BY ado_id",
        "entity_summary": with_ctes(OBS_CTE) + (
            "SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_entities, CAST(count(*) > 1 AS INTEGER) "
            "AS multiple_entities, max(c) AS max_rows_per_entity FROM (SELECT ado_id, count(*) AS c FROM obs "
            "GROUP BY ado_id)"),
        "distinct_entities": with_ctes(OBS_CTE) + "SELECT DISTINCT ado_id FROM obs",
        "entity_stddev": with_ctes(OBS_CTE) + (
            f"SELECT ado_id, round(stddev_samp(li_ua_quantity_value), {R}) AS sd_li_ua_quantity_value, "
            f"round(stddev_samp(li_ua_price_value), {R}) AS sd_li_ua_price_value FROM obs GROUP BY ado_id "
            f"HAVING stddev_samp(li_ua_quantity_value) IS NOT NULL AND stddev_samp(li_ua_price_value) IS NOT NULL"),
        "join_entity_stats": with_ctes(OBS_CTE) + (
            f"SELECT o.obs_key, o.ado_id, round(o.li_ua_quantity_value, {R}) AS li_ua_quantity_value, "
            f"round(s.sd, {R}) AS sd_li_ua_quantity_value FROM obs o LEFT JOIN (SELECT ado_id, "
            f"stddev_samp(li_ua_quantity_value) AS sd FROM obs GROUP BY ado_id HAVING sd IS NOT NULL) s "
            f"ON o.ado_id IS NOT DISTINCT FROM s.ado_id"),
        "join_entity_stats_shuffled": with_ctes(OBS_CTE) + (
            f"SELECT o.obs_key, o.ado_id, round(o.li_ua_quantity_value, {R}) AS li_ua_quantity_value, "
            f"round(s.sd, {R}) AS sd_li_ua_quantity_value FROM obs o LEFT JOIN (SELECT ado_id, "
            f"stddev_samp(li_ua_quantity_value) AS sd FROM obs GROUP BY ado_id HAVING sd IS NOT NULL) s "
            f"ON o.ado_id IS NOT DISTINCT FROM s.ado_id"),
        "inject_stddev": inject_stddev_sql(),
        "inject_zero": inject_zero_sql(),
        "inject_negate": inject_negate_sql(),
        "inject_hilo": inject_hilo_sql(),
        "inject_spread": inject_spread_sql(),
        "inject_stack": inject_stack_sql(),
        "inject_negate_events": inject_negate_events_sql(),
        "profile_columns_events": profile_sql(0.0, EVENT_COLS, EVENT_TYPES, EVENTS_CTE, "evobs"),
        "confusion_matrix": with_ctes(OBS_CTE, PRED_CTE) + (
            "SELECT model, label, prediction, count(*) AS n FROM pred GROUP BY model, label, prediction"),
        "classification_report": classification_report_sql(False),
        "classification_report_legacy": classification_report_sql(True),
        "regression_report": regression_report_sql(),
        "entity_feature_ranges": with_ctes(OBS_CTE) + (
            f"SELECT ado_id, count(*) AS n_rows, round(min(li_ua_quantity_value), {R}) AS min_li_ua_quantity_value, "
            f"round(max(li_ua_quantity_value), {R}) AS max_li_ua_quantity_value, "
            f"round(min(li_ua_tax_value), {R}) AS min_li_ua_tax_value, "
            f"round(max(li_ua_tax_value), {R}) AS max_li_ua_tax_value FROM obs GROUP BY ado_id"),
        "load_and_transform_single": load_and_transform_single_sql(),
        "labeled_points_classification_loader": labeled_points_classification_loader_sql(),
        "linear_fit_coefficients": line_sql(),
        "categorical_map": categorical_map_sql(),
    }
