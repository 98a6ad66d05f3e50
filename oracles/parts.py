"""Building blocks of the reference SQL: hash draws, views, tail integrals."""

from __future__ import annotations

STREAMS = {"arm": 1, "lift": 2, "drop": 3, "whale": 4, "base": 5, "sample": 6, "boot": 7, "slice": 8,
           "label": 9, "order": 10, "split": 11}


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0e0)"


def md5_bucket(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


# --- XXH64 of longs and ints, seed 42 (fixed values), on unsigned 128-bit arithmetic ---
W = "18446744073709551615::UHUGEINT"
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _mul(x: str, c: int) -> str:
    return f"(({x} * {c}::UHUGEINT) & {W})"


def _rot(x: str, n: int) -> str:
    return f"((({x} << {n}) & {W}) | ({x} >> {64 - n}))"


def _fold(x: str, n: int) -> str:
    return f"xor({x}, {x} >> {n})"


def _hash_long(source: str, value: str, name: str) -> str:
    """Rows of ``source`` with the hash of an unsigned 64-bit column, step by step."""
    steps = (f"xor({42 + P5 + 8}::UHUGEINT, {_mul(_rot(_mul(value, P2), 31), P1)})",
             f"(({_mul(_rot('x0', 27), P1)} + {P4}::UHUGEINT) & {W})", _mul(_fold("x1", 33), P2), _mul(_fold("x2", 29), P3), _fold("x3", 32))
    for i, step in enumerate(steps):
        out = name if i == len(steps) - 1 else f"x{i}"
        drop = f" EXCLUDE (x{i - 1})" if i else ""
        source = f"(SELECT *{drop}, {step} AS {out} FROM {source})"
    return source


def coded(source: str, key: str) -> str:
    """Rows of ``source`` with ``hs``, the state that draws of a unit start from."""
    code = _hash_long(f"(SELECT *, ({key})::UHUGEINT AS raw FROM {source})", "raw", "code")
    return f"(SELECT * EXCLUDE (raw, code) FROM {_hash_long(code, 'code', 'hs')})"


def salt(stream: str, replay: str = "0") -> str:
    """Key part of a draw; compute it once per replay."""
    return _mul(f"({replay} + {STREAMS[stream] * 100000007})::UHUGEINT", P1)


def _hash_int(k: str, hs: str) -> str:
    h = f"(({_mul(_rot(f'xor(({hs} + {P5 + 4}::UHUGEINT) & {W}, {k})', 23), P2)} + {P3}::UHUGEINT) & {W})"
    return _mul(_fold(_mul(_fold(h, 33), P2), 29), P3)


def draw(k: str, hs: str = "hs") -> str:
    """The upper half of the hash; its last fold leaves that unchanged."""
    return f"(({_hash_int(k, hs)} >> 32)::UBIGINT)"


def word(k: str, hs: str = "hs") -> str:
    """All 64 bits of the hash."""
    return f"({_fold(_hash_int(k, hs), 32)}::UBIGINT)"


def split_rows(units: str, n: int) -> str:
    """Units x replays 1..n; the arm is a bit of a 64-bit word, 64 replays a word."""
    words = f"(SELECT b, {salt('split', 'b')} AS k FROM range(0, {-(-n // 64)}) t(b))"
    return f"""(SELECT u.* EXCLUDE (w, b) REPLACE (CASE WHEN ((w >> ((g - 1) % 64)::UBIGINT) & 1::UBIGINT) = 1 THEN 'treatment' ELSE 'control' END AS arm), g::BIGINT AS replay
      FROM (SELECT *, {word('k')} AS w FROM (SELECT c.* EXCLUDE (arm), 'control' AS arm, v.* FROM {units} c, {words} v)) u
      JOIN range(1, {n + 1}) t(g) ON (g - 1) // 64 = u.b)"""


def u(k: str, hs: str = "hs") -> str:
    return f"({draw(k, hs)} / 4294967296e0)"


# --- tails by numeric integration ---------------------------------------------
def p_norm(z: str) -> str:
    """Two-sided normal p value: Simpson's rule on [0, |z|]."""
    return (f"(CASE WHEN abs({z}) > 8 THEN 0e0 ELSE greatest(0e0, 1 - 2 * abs({z}) / 1200.0 * list_sum(list_transform("
            f"range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
            f" * exp(-0.5 * pow(abs({z}) * i / 400.0, 2)))) / sqrt(2 * pi())) END)")


def p_t(t: str, df: str) -> str:
    """Two-sided Student p value: Simpson's rule in the angle atan(t / sqrt(df))."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    return (f"greatest(0e0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {theta} / 3000.0"
            f" * list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1"
            f" WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({theta} * i / 1000.0), {df} - 1))))")


Z975 = "1.959963984540054"

# --- views ----------------------------------------------------------------------
def orders(share: int = 5000, salt_text: str = "fx1:") -> str:
    return f"""(SELECT o_orderkey AS unit_id, o_custkey AS cluster_id,
      CASE WHEN {md5_bucket(f"'{salt_text}' || o_orderkey")} % 10000 < {share} THEN 'treatment' ELSE 'control' END AS arm,
      (datediff('day', DATE '1995-01-01', o_orderdate::DATE) % 14)::INT AS day,
      (datediff('day', DATE '1995-01-01', o_orderdate::DATE) % 56)::INT AS slot,
      o_totalprice AS amount,
      CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS converted,
      CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN o_totalprice ELSE 0e0 END AS revenue,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS engaged,
      CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS visit,
      o_orderpriority AS priority, o_orderstatus AS order_status,
      c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS pre_x,
      0.5e0 * o_totalprice + 10 * c_acctbal AS x_strong
    FROM orders JOIN customer ON c_custkey = o_custkey)"""


CUSTOMERS = f"""(SELECT o_custkey AS unit_id,
      CASE WHEN {md5_bucket("'fx2:' || o_custkey")} % 10000 < 5000 THEN 'treatment' ELSE 'control' END AS arm,
      count(*) AS sessions, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS clicks
    FROM orders GROUP BY 1, 2)"""

EVENTS = f"""(SELECT user_id AS unit_id,
      CASE WHEN {md5_bucket("'fx3:' || user_id")} % 10000 < 5000 THEN 'treatment' ELSE 'control' END AS arm,
      datediff('day', DATE '2024-01-01', ts::DATE)::INT AS day,
      CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS converted, value FROM events)"""

EVENT_USERS = f"(SELECT unit_id, arm, count(*) AS sessions, sum(converted)::BIGINT AS clicks FROM {EVENTS} GROUP BY 1, 2)"

LINES = f"""(SELECT l_orderkey AS cluster_id,
      CASE WHEN {md5_bucket("'fx7:' || l_orderkey")} % 10000 < 5000 THEN 'treatment' ELSE 'control' END AS arm,
      CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS converted,
      l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem)"""

THREE = f"""(SELECT *, CASE {md5_bucket("'fx4:' || unit_id")} % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'variant_a'
      ELSE 'variant_b' END AS label FROM {orders()})"""


def arm_counts(source: str, by: str = "", metric: str = "converted") -> str:
    """Arm totals; ``by`` is a comma separated list of grouping columns."""
    head = f"{by}, " if by else ""
    return f"""(SELECT {head}sum({metric}) FILTER (arm = 'control')::DOUBLE AS xc, count({metric}) FILTER (arm = 'control')::DOUBLE AS nc,
      sum({metric}) FILTER (arm = 'treatment')::DOUBLE AS xt, count({metric}) FILTER (arm = 'treatment')::DOUBLE AS nt
      FROM {source} {'GROUP BY ' + by if by else ''})"""


def z_expr(floor: bool = False, xc="xc", nc="nc", xt="xt", nt="nt") -> str:
    pool = f"(({xc} + {xt}) / ({nc} + {nt}))"
    var = f"({pool} * (1 - {pool}) * (1 / nullif({nc}, 0) + 1 / nullif({nt}, 0)))"
    diff = f"({xt} / nullif({nt}, 0) - {xc} / nullif({nc}, 0))"
    if floor:
        return f"({diff} / sqrt(CASE WHEN {nc} > 0 AND {nt} > 0 THEN greatest({var}, 1e-12) END))"
    return f"(CASE WHEN {var} <= 0 THEN 0e0 ELSE {diff} / nullif(sqrt(greatest({var}, 0)), 0) END)"


def prop_cols(source: str) -> str:
    """Two-proportion inference columns on arm counts."""
    return f"""(SELECT *, xt / nullif(nt, 0) - xc / nullif(nc, 0) AS effect,
      sqrt(xc / nullif(nc, 0) * (1 - xc / nullif(nc, 0)) / nullif(nc, 0) + xt / nullif(nt, 0) * (1 - xt / nullif(nt, 0)) / nullif(nt, 0)) AS se,
      xc / nullif(nc, 0) AS base, {z_expr()} AS z FROM {source})"""


RESULT = f"""{r('effect')} AS effect, {r('se')} AS se, {r(p_norm('z'))} AS p_value,
      {r(f'effect - {Z975} * se')} AS ci_low, {r(f'effect + {Z975} * se')} AS ci_high,
      {r('effect / nullif(base, 0)')} AS rel_lift, {p_norm('z')} < 0.05 AS significant"""


def welch_cols(source: str, mc="mc", vc="vc", nc="nc", mt="mt", vt="vt", nt="nt", pre: str = "") -> str:
    """Effect, error, t and degrees of freedom from arm moments."""
    a, b = f"({vc} / {nc})", f"({vt} / {nt})"
    return f"""(SELECT *, {pre}effect / nullif({pre}se, 0) AS {pre}t FROM (SELECT *, {mt} - {mc} AS {pre}effect, sqrt({a} + {b}) AS {pre}se,
      pow({a} + {b}, 2) / nullif({a} * {a} / ({nc} - 1) + {b} * {b} / ({nt} - 1), 0) AS {pre}dof FROM {source}))"""


def moments(y: str) -> str:
    return ", ".join(f"count({y}) FILTER (arm = '{n}')::DOUBLE AS n{s}, avg({y}) FILTER (arm = '{n}') AS m{s}, "
                     f"var_samp({y}) FILTER (arm = '{n}') AS v{s}" for s, n in (("c", "control"), ("t", "treatment")))


def replays(n: int, first: int = 1, streams=("arm",), name: str = "replay") -> str:
    ks = ", ".join(f"{salt(s, 'g')} AS k_{s}" for s in streams)
    return f"(SELECT g::BIGINT AS {name}, {ks} FROM range({first}, {first + n}) t(g))"


def with_t_quantile(source: str, df: str = "dof") -> str:
    """Add ``tq``, the 97.5% t quantile: Newton steps from the normal quantile,
    with the integral above as distribution function."""
    dens = f"(exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * pow(1 + tq * tq / {df}, -({df} + 1) / 2))"
    out = f"(SELECT *, {Z975}::DOUBLE AS tq FROM {source})"
    for _ in range(3):
        out = f"(SELECT * REPLACE (tq + ({p_t('tq', df)} - 0.05) / (2 * {dens}) AS tq) FROM {out})"
    return out


def injected(units: str, reps: str, effects: set[str], scenarios: str = "(SELECT 0e0 AS lift)",
             share: str = "0.5e0", where: str = "true") -> str:
    """Units x scenarios x replays with effects built in; ``units`` has hs."""
    streams = {"lift": "k_lift", "drop": "k_drop", "whale": "k_whale", "base": "k_base"}
    if "ramp" in effects:
        share = f"(CASE WHEN day < ramp_days THEN ramp_treat_share ELSE {share} END)"
    sql = f"""(SELECT * REPLACE (CASE WHEN {u('k_arm')} < {share} THEN 'treatment' ELSE 'control' END AS arm)
      FROM (SELECT u.* EXCLUDE (arm), 'control' AS arm, b.*, s.*, g.* FROM {units} u,
        (SELECT avg(converted) AS base_rate, avg(1 - engaged) AS low_share, count(*) AS all_units FROM {units}) b,
        {scenarios} s, {reps} g) WHERE {where})"""
    if "drop" in effects:
        sql = f"""(SELECT * FROM {sql} WHERE NOT (arm = 'treatment' AND engaged = 0
          AND {u(streams['drop'])} * low_share < srm_drop_rate))"""
    if "base" in effects:
        sql = f"""(SELECT * REPLACE (CASE WHEN daily_base[day + 1] >= base_rate
            THEN (CASE WHEN converted = 1 OR {u('k_base')} * (1 - base_rate) < daily_base[day + 1] - base_rate THEN 1 ELSE 0 END)
            ELSE (CASE WHEN converted = 1 AND {u('k_base')} * base_rate < daily_base[day + 1] THEN 1 ELSE 0 END) END AS converted,
            daily_base[day + 1] AS base_rate) FROM {sql})"""
    if "lift" in effects or "novelty" in effects:
        lift = "(lift + novelty_boost * pow(0.5e0, day / novelty_halflife))" if "novelty" in effects else "lift"
        sql = f"""(SELECT * REPLACE (CASE WHEN arm = 'control' THEN converted
            WHEN converted = 0 AND ul * (1 - base_rate) < {lift} * base_rate THEN 1
            WHEN converted = 1 AND ul < -{lift} THEN 0 ELSE converted END AS converted)
          FROM (SELECT *, {u('k_lift')} AS ul FROM {sql}))"""
    value = "amount"
    if "whale" in effects:
        value = f"(CASE WHEN {u('k_whale')} < whale_rate THEN amount * whale_multiplier ELSE amount END)"
    return f"(SELECT * REPLACE (CASE WHEN converted = 1 THEN {value} ELSE 0e0 END AS revenue) FROM {sql})"
