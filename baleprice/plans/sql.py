"""DuckDB SQL builders for the oracle side of every registered query.

The oracle recomputes everything from the parquet views with plain SQL (CASE expressions for the fixed
tables), independently of the Spark code. Numeric literals are written with ``E0`` so both engines
treat them as DOUBLE; rounding is ``round_even(x * 10^d, 0) / 10^d`` (numpy/Python rule) or
``floor(x * 10^d + 0.5) / 10^d`` (JavaScript rule).
"""

from __future__ import annotations

from baleprice.functions import dims as D


def num(v) -> str:
    return f"{float(v)!r}E0" if "e" not in repr(float(v)) else repr(float(v))


def lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    return num(v)


def case_map(col: str, mapping: dict, default=None) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    other = "NULL" if default is None else lit(default)
    return f"(CASE {col} {whens} ELSE {other} END)"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def r_even(x: str, d: int) -> str:
    s = num(10 ** d)
    return f"(round_even(({x}) * {s}, 0) / {s})"


def r_py(x: str, d: int) -> str:
    """Python ``round(x, d)`` (same arithmetic as ``numeric.round_py``)."""
    from baleprice.functions.numeric import _SPLIT
    s = num(float(10 ** d))
    p = f"(({x}) * {s})"
    cx = f"(({x}) * {num(_SPLIT)})"
    xh = f"({cx} - ({cx} - ({x})))"
    err = f"(({xh} * {s} - {p}) + (({x}) - {xh}) * {s})"
    nudge = f"(CASE WHEN {p} - floor({p}) = 0.5E0 THEN sign({err}) * 0.25E0 ELSE 0.0E0 END)"
    return f"(round_even({p} + {nudge}, 0) / {s})"


def r_js(x: str, d: int) -> str:
    s = num(10 ** d)
    return f"(floor(({x}) * {s} + 0.5E0) / {s})"


def clip(x: str, lo, hi) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest({x}, {num(lo)}), {num(hi)}) END)"


def steps(x: str, table, otherwise) -> str:
    whens = " ".join(f"WHEN {x} <= {num(b)} THEN {num(v)}" for b, v in table)
    return f"(CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {num(otherwise)} END)"


def tier_label(score: str) -> str:
    hi, lo = D.TIER_THRESHOLDS
    return (f"(['informal', 'semi_formal', 'formal'][1 + CAST({score} >= {num(lo)} AS INTEGER) "
            f"+ CAST({score} >= {num(hi)} AS INTEGER)])")


KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
COND_SCORE = {"clean": 1.0, "mixed": 0.5, "contaminated": 0.0}


def _subtypes_values() -> str:
    rows = []
    for wt, pos, st in D.subtypes_in_training_order():
        mean, std = next((m, s) for w, t, m, s in D.BASE_RATES if w == wt and t == st)
        rows.append(f"({lit(wt)}, {pos}, {lit(st)}, {num(mean)}, {num(std)})")
    return "VALUES " + ", ".join(rows)


def base_ctes() -> str:
    """CTEs ``raw_listings`` (uncleaned requests) and ``training`` (the labelled v2 training table)."""
    waste = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(
        ["plastic", "metal", "paper", "e_waste", "organic", "glass", "textile", "rubber"]))
    county = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(
        ["Nairobi", "Mombasa", "Kisumu", "Nakuru", "Eldoret", "Kiambu", "Machakos", "Kajiado", "Turkana"]))
    disc = case_map("waste_type", D.INFORMAL_DISCOUNTS, D.INFORMAL_DISCOUNT_DEFAULT)
    cf = case_map("condition", D.COND_FACTORS)
    score = f"least(greatest(({cf} - 0.78E0) / 0.22E0, 0.0E0), 1.0E0)"
    cond = "lower(coalesce(condition, 'clean'))"
    cp = "lower(coalesce(collection_point, 'commercial'))"
    cty = "coalesce(county, 'Nairobi')"
    e7 = (f"s.base_mean * {case_map('t.condition', D.COND_FACTORS)}"
          f" * {steps('t.distance_km', D.DISTANCE_STEPS, D.DISTANCE_STEP_ELSE)}"
          f" * {steps('t.weight_kg', D.VOLUME_STEPS, D.VOLUME_STEP_ELSE)}"
          f" * {case_map('t.county', D.TRAIN_COUNTY_MULT)}"
          f" * {case_map('t.collection_point', D.TRAIN_COLLECTION_POINT_MULT)}"
          f" * {case_map('t.month', D.TRAIN_SEASONAL)}"
          f" * t.tier_multiplier")
    return f"""
subtypes(waste_type, sub_pos, sub_type, base_mean, base_std) AS ({_subtypes_values()}),
subtype_n AS (SELECT waste_type, count(*) AS n_subtypes FROM subtypes GROUP BY waste_type),
raw_base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    CASE p_partkey % 8 {waste} END AS waste_type,
    CAST(floor(p_partkey / 8) AS BIGINT) AS sub_seq,
    l_quantity * (1 + p_size % 25) AS weight_kg,
    ((l_suppkey * 37 + l_partkey) % 2500) / 10.0E0 AS distance_km,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND l_tax = 0 THEN 'Unsorted'
      WHEN l_returnflag = 'N' THEN 'clean' WHEN l_returnflag = 'A' THEN 'mixed' ELSE 'contaminated' END AS condition,
    CASE c_nationkey % 9 {county} END AS county,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'household' WHEN 'BUILDING' THEN 'commercial'
      WHEN 'MACHINERY' THEN 'industrial' WHEN 'AUTOMOBILE' THEN 'dump_site' END AS collection_point,
    CAST(month(l_shipdate) AS INT) AS month,
    CAST(isodow(l_shipdate) - 1 AS INT) AS day_of_week,
    {r_even('1.0E0 - l_discount * 8.0E0', 2)} AS consistency_score,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax * 12.5E0 END AS market_demand_index,
    0.7E0 + 0.6E0 * ((CAST(floor(l_extendedprice) AS BIGINT) % 1000) / 1000.0E0) AS noise,
    o_orderdate AS listed_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
),
raw_listings AS (
  SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_suppkey, b.l_extendedprice, b.waste_type,
    s.sub_type, b.weight_kg, b.distance_km, b.condition, b.county, b.collection_point, b.month, b.day_of_week,
    b.consistency_score, b.market_demand_index, b.noise, b.listed_at
  FROM raw_base b LEFT JOIN subtype_n n ON n.waste_type = b.waste_type
  LEFT JOIN subtypes s ON s.waste_type = b.waste_type AND s.sub_pos = CAST(b.sub_seq % n.n_subtypes AS INT)
),
train_clean AS (
  SELECT {KEY}, waste_type, sub_type,
    {clip('weight_kg', *D.WEIGHT_BOUNDS)} AS weight_kg,
    {clip('coalesce(distance_km, 5.0E0)', *D.DISTANCE_BOUNDS)} AS distance_km,
    CASE WHEN {cond} IN {in_list(D.VALID_CONDITIONS)} THEN {cond} ELSE 'mixed' END AS condition,
    month, day_of_week,
    CASE WHEN {cty} IN {in_list(D.COUNTY_MULT)} THEN {cty} ELSE 'Nairobi' END AS county,
    CASE WHEN {cp} IN {in_list(D.TRAIN_COLLECTION_POINT_MULT)} THEN {cp} ELSE 'commercial' END AS collection_point,
    noise
  FROM raw_listings
),
train_tier AS (
  SELECT *, {r_py(f'{disc} + score * (1.0E0 - {disc})', 4)} AS tier_multiplier,
    {r_py('score', 4)} AS tier_score
  FROM (SELECT *, {score} AS score FROM train_clean)
),
training AS (
  SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.l_extendedprice, t.waste_type, t.sub_type,
    t.weight_kg, t.distance_km, t.condition, t.month, t.day_of_week, t.county, t.collection_point,
    {tier_label('t.tier_score')} AS market_tier, t.tier_score, t.tier_multiplier,
    {r_py(f'greatest(0.5E0, ({e7}) * t.noise)', 2)} AS price_per_kg
  FROM train_tier t LEFT JOIN subtypes s ON s.waste_type = t.waste_type AND s.sub_type = t.sub_type
)"""


def with_base(body: str, extra_ctes: str = "") -> str:
    """Full oracle statement: shared CTEs + optional extra CTEs + the final SELECT."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {base_ctes()}{extra}\n{body}"


# ---------------------------------------------------------------------------------------------------
# Shared fragments for cleaning, tiers, rule predictions and post-processing
# ---------------------------------------------------------------------------------------------------
def clean_select(generation: str, src: str = "raw_listings") -> str:
    cond = "lower(coalesce(condition, 'clean'))"
    cp = "lower(coalesce(collection_point, 'commercial'))"
    cty = "coalesce(county, 'Nairobi')"
    if generation == "v2old":
        county_sql, cp_sql = cty, "coalesce(collection_point, 'commercial')"
    else:
        allowed = D.TRAIN_COLLECTION_POINT_MULT if generation == "train" else D.V2_COLLECTION_POINT_MULT
        county_sql = f"CASE WHEN {cty} IN {in_list(D.COUNTY_MULT)} THEN {cty} ELSE 'Nairobi' END"
        cp_sql = f"CASE WHEN {cp} IN {in_list(allowed)} THEN {cp} ELSE 'commercial' END"
    return f"""SELECT {KEY}, waste_type, sub_type,
    {clip('weight_kg', *D.WEIGHT_BOUNDS)} AS weight_kg,
    {clip('coalesce(distance_km, 5.0E0)', *D.DISTANCE_BOUNDS)} AS distance_km,
    CASE WHEN {cond} IN {in_list(D.VALID_CONDITIONS)} THEN {cond} ELSE 'mixed' END AS condition,
    {county_sql} AS county, {cp_sql} AS collection_point,
    month, day_of_week, consistency_score, market_demand_index, listed_at
  FROM {src}"""


def informal(wt: str = "waste_type") -> str:
    return case_map(wt, D.INFORMAL_DISCOUNTS, D.INFORMAL_DISCOUNT_DEFAULT)


def tier_select(kind: str, src: str) -> str:
    """E1 (live), E2 (old) or E3 (train) tier columns appended to ``src``."""
    cs = case_map("condition", COND_SCORE, 0.5)
    if kind == "live":
        ws = clip("1.0E0 - weight_kg / 200.0E0", 0.0, 1.0)
        score = clip(f"0.5E0 * {ws} + 0.5E0 * (((0.78E0 + {cs} * 0.22E0) - 0.78E0) / 0.22E0)", 0.0, 1.0)
        label_on = "_s"
    elif kind == "old":
        ws = clip("(weight_kg - 5.0E0) / 95.0E0", 0.0, 1.0)
        score = f"(0.55E0 * {ws} + 0.45E0 * {cs})"
        label_on = "_s"
    else:
        score = clip(f"({case_map('condition', D.COND_FACTORS)} - 0.78E0) / 0.22E0", 0.0, 1.0)
        label_on = r_py("_s", 4)
    d = informal()
    return f"""SELECT * EXCLUDE (_s), {r_py(f'{d} + _s * (1.0E0 - {d})', 4)} AS tier_multiplier,
    {r_py('_s', 4)} AS tier_score, {tier_label(label_on)} AS market_tier
  FROM (SELECT *, {score} AS _s FROM {src})"""


def e3_multiplier() -> str:
    score = clip(f"({case_map('condition', D.COND_FACTORS)} - 0.78E0) / 0.22E0", 0.0, 1.0)
    d = informal()
    return r_py(f"{d} + {score} * (1.0E0 - {d})", 4)


def e7_raw(alias: str = "x", tier: str | None = None) -> str:
    a = alias
    tm = tier or e3_multiplier().replace("condition", f"{a}.condition").replace("waste_type", f"{a}.waste_type")
    return (f"(_br.base_mean * {case_map(f'{a}.condition', D.COND_FACTORS)}"
            f" * {steps(f'{a}.distance_km', D.DISTANCE_STEPS, D.DISTANCE_STEP_ELSE)}"
            f" * {steps(f'{a}.weight_kg', D.VOLUME_STEPS, D.VOLUME_STEP_ELSE)}"
            f" * {case_map(f'{a}.county', D.TRAIN_COUNTY_MULT)}"
            f" * {case_map(f'{a}.collection_point', D.TRAIN_COLLECTION_POINT_MULT)}"
            f" * {case_map(f'{a}.month', D.TRAIN_SEASONAL)}"
            f" * {tm})")


def rule_pred_select(src: str) -> str:
    """pred_lower / pred_mid / pred_upper = (0.70, 1.0, 1.35) x noise-free E7 of the row."""
    p = e7_raw("x")
    return f"""SELECT x.*, {p} * 0.7E0 AS pred_lower, {p} * 1.0E0 AS pred_mid, {p} * 1.35E0 AS pred_upper
  FROM {src} x LEFT JOIN subtypes _br ON _br.waste_type = x.waste_type AND _br.sub_type = x.sub_type"""


def digest(seed: int, alias: str = "") -> str:
    """Hex md5 of the row key and a seed, as ``numeric.row_digest``."""
    a = f"{alias}." if alias else ""
    parts = ", ".join(f"coalesce(CAST({a}{k.strip()} AS VARCHAR), '')" for k in KEY.split(","))
    return f"md5(concat_ws('|', {parts}, '{seed}'))"


def is_test(alias: str = "", pct: int = 15, seed: int = 42) -> str:
    return f"(CAST('0x' || substr({digest(seed, alias)}, 1, 8) AS BIGINT) % 100 < {pct})"


def fmt0(x: str) -> str:
    return f"printf('%.0f', {x})"


def postprocess_select(generation: str, src: str, weight: str = "weight_kg") -> str:
    floor = lambda c: f"(CASE WHEN {c} IS NULL THEN NULL ELSE greatest({num(D.PRICE_FLOOR_MODEL)}, {c}) END)"
    if generation == "v2":
        cpm = case_map("collection_point", D.V2_COLLECTION_POINT_MULT, 1.0)
        cm = case_map("county", D.COUNTY_MULT, 1.0)
        inner = f"""SELECT *, {cpm} AS collection_point_multiplier, {cm} AS county_multiplier,
      {floor('pred_lower')} * {cpm} * {cm} AS _lo1, {floor('pred_mid')} * {cpm} * {cm} AS _mid,
      {floor('pred_upper')} * {cpm} * {cm} AS _hi1 FROM {src}"""
        mid_sel = f"SELECT * EXCLUDE (_lo1, _hi1), least(_lo1, _mid) AS _lo, greatest(_hi1, _mid) AS _hi FROM ({inner})"
        tier_adv = case_map("market_tier", D.TIER_ADVICE, "")
        cp_adv = case_map("collection_point", D.COLLECTION_POINT_ADVICE, "")
        advice = (f"'Negotiate between KES ' || {fmt0('_lo')} || '–' || {fmt0('_hi')} || '/kg. Fair market rate is KES '"
                  f" || {fmt0('_mid')} || '/kg. ' || trim({tier_adv} || ' ' || {cp_adv})")
    else:
        mid_sel = f"SELECT *, {floor('pred_lower')} AS _lo, {floor('pred_mid')} AS _mid, {floor('pred_upper')} AS _hi FROM {src}"
        if generation == "v2old":
            advice = (f"'Negotiate between KES ' || {fmt0('_lo')} || '–' || {fmt0('_hi')} || '/kg. Fair market rate is KES '"
                      f" || {fmt0('_mid')} || '/kg. ' || {case_map('market_tier', D.TIER_ADVICE, '')}")
        else:
            advice = (f"'Negotiate between KES ' || {fmt0('_lo')} || '–' || {fmt0('_hi')} || '/kg. Fair rate is KES '"
                      f" || {fmt0('_mid')} || '/kg.'")
    a, b = D.SIGNAL_THRESHOLDS
    signal = (f"(CASE WHEN (_hi - _lo) / _mid IS NULL THEN NULL WHEN (_hi - _lo) / _mid < {num(a)} THEN 'stable' "
              f"WHEN (_hi - _lo) / _mid < {num(b)} THEN 'moderate' ELSE 'volatile' END)")
    return f"""SELECT * EXCLUDE (_lo, _mid, _hi), (_hi - _lo) / _mid AS volatility,
    {r_py('_lo', 2)} AS lower_bound, {r_py('_mid', 2)} AS recommended, {r_py('_hi', 2)} AS upper_bound,
    {r_py(f'_lo * {weight}', 2)} AS payout_lower, {r_py(f'_mid * {weight}', 2)} AS payout_recommended,
    {r_py(f'_hi * {weight}', 2)} AS payout_upper, {r_py('_hi - _lo', 2)} AS range_width,
    {signal} AS market_signal, {lit(D.COVERAGE_LABEL[generation])} AS coverage, {advice} AS advice
  FROM ({mid_sel})"""
