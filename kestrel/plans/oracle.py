"""The same queries for DuckDB, written apart from the Spark code."""

from __future__ import annotations

import math

EVENTS = """ev AS (
  SELECT event_id, ts, epoch_us(ts) / 1e6 AS t, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events
)"""

OBS = EVENTS + """, obs AS (
  SELECT user_id AS id, event_id, t, 2e1 * k AS x, 4e0 * value AS y, 1.2e0 * k AS alt FROM ev WHERE event_type NOT IN ('signup', 'purchase')
)"""

SEGMENTS = OBS + """, following AS (
  SELECT id, t AS t0, x AS x0, y AS y0, alt AS alt0, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(alt) OVER w AS alt1
  FROM obs WINDOW w AS (PARTITION BY id ORDER BY t, event_id)
), pairs AS (
  SELECT *, 1 AS paired FROM following WHERE t1 - t0 > 0 AND t1 - t0 <= 7200
), segs AS (
  SELECT * FROM pairs UNION ALL SELECT id, t, x, y, alt, t, x, y, alt, 0 FROM obs
)"""

POINTS = """pts AS (
  SELECT event_id AS drone_id, CASE WHEN event_id % 26 = 0 THEN 'sparse' WHEN event_id % 26 <= 5 THEN 'medium' ELSE 'dense' END AS density,
    step, t + 6e1 * step AS t, 2e1 * k + (5e0 + 1e-1 * k) * step * sin(radians(3.6e0 * k)) AS x,
    4e0 * value + (5e0 + 1e-1 * k) * step * cos(radians(3.6e0 * k)) AS y, 1e1 + 1.1e0 * k AS alt, 3.6e0 * k AS heading
  FROM ev, (SELECT CAST(range AS INTEGER) AS step FROM range(30)) WHERE event_type = 'purchase'
)"""

FOUND = SEGMENTS + ", " + POINTS + """, sb AS (
  SELECT *, unnest(generate_series(CAST(floor(t0 / 60) AS BIGINT), CAST(floor(t1 / 60) AS BIGINT))) AS bucket FROM segs
), met AS (
  SELECT p.*, s.* EXCLUDE (bucket), greatest(0e0, least(1e0, (t - t0) / CASE WHEN t1 = t0 THEN 1e0 ELSE t1 - t0 END)) AS share
  FROM (SELECT *, CAST(floor(t / 60) AS BIGINT) AS bucket FROM pts) p JOIN sb s ON p.bucket = s.bucket
), offs AS (
  SELECT *, x0 + (x1 - x0) * share - x AS dx, y0 + (y1 - y0) * share - y AS dy, abs(alt - (alt0 + (alt1 - alt0) * share)) AS vertical FROM met
), found AS (
  SELECT * FROM (SELECT *, sqrt(dx * dx + dy * dy) AS horizontal FROM offs) WHERE horizontal <= 330
)"""

SHAPED = FOUND + """, inside AS (
  SELECT drone_id, step, horizontal <= 200 AND vertical <= 50 AS cylinder,
    horizontal * horizontal + vertical * vertical <= pow(144.2249570307408e0, 2) AS sphere,
    pow((dx * sin(radians(heading)) + dy * cos(radians(heading))) / 299.9999999999999e0, 2)
      + pow((dx * cos(radians(heading)) - dy * sin(radians(heading))) / 99.99999999999997e0, 2) + pow(vertical / 99.99999999999997e0, 2) <= 1 AS ellipsoid,
    horizontal, vertical FROM found
), flags AS (
  SELECT drone_id, step, bool_or(cylinder) AS cylinder, bool_or(sphere) AS sphere, bool_or(ellipsoid) AS ellipsoid, count(*) AS n FROM inside GROUP BY ALL
), evaluated AS (
  SELECT p.drone_id, p.step, density, coalesce(cylinder, false) AS danger, coalesce(cylinder, false) AS cylinder, coalesce(sphere, false) AS sphere,
    coalesce(ellipsoid, false) AS ellipsoid, coalesce(n, 0) AS n FROM pts p LEFT JOIN flags f ON p.drone_id = f.drone_id AND p.step = f.step
), long AS (
  SELECT drone_id, step, density, danger, 'cylinder' AS shape, cylinder AS alert FROM evaluated
  UNION ALL SELECT drone_id, step, density, danger, 'sphere', sphere FROM evaluated
  UNION ALL SELECT drone_id, step, density, danger, 'ellipsoid', ellipsoid FROM evaluated
)"""

CENTI = "CAST(round_even({} * 100, 0) AS BIGINT)"

COUNTS = """count(*) FILTER (alert AND danger) AS "TP", count(*) FILTER (alert AND NOT danger) AS "FP",
  count(*) FILTER (NOT alert AND NOT danger) AS "TN", count(*) FILTER (NOT alert AND danger) AS "FN" """

RATES = """round("TP" / nullif("TP" + "FN", 0), 9) AS "TPR", round("FP" / nullif("FP" + "TN", 0), 9) AS "FPR",
  round(sqrt(pow(1 - "TP" / nullif("TP" + "FN", 0), 2) + pow("FP" / nullif("FP" + "TN", 0), 2)), 9) AS dist_to_corner"""

SEGMENT_COLUMNS = "id, round(t0, 6) AS t0, round(t1, 6) AS t1, " + ", ".join(f"round({c}{i}, 6) AS {c}{i}" for i in (0, 1) for c in ("x", "y", "alt")) + ", paired"

NEAREST = """arg_min(id, (horizontal, paired, id, t0)) AS nearest, arg_min(horizontal, (horizontal, paired, id, t0)) AS nearest_h,
  arg_min(vertical, (horizontal, paired, id, t0)) AS nearest_v"""

DAYS = EVENTS + ", days AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_type, value FROM ev)"

REPORTS = """reports AS (
  SELECT event_id, event_type = 'signup' AS on_ground, round(CASE WHEN k % 4 <> 0 THEN value END, 6) AS geo_altitude,
    round(CASE WHEN k % 5 <> 0 THEN k * 0.1e0 END, 6) AS latitude, round(CASE WHEN k % 7 <> 0 THEN k * 0.2e0 END, 6) AS longitude FROM ev
)"""

#: 32 bits of a text's md5, and a scrambling of 32-bit numbers.
WORD = "concat('0x', substr(md5({}), 1, 8))::BIGINT"
_HALF = "((xor(({0}) >> 16, {0}) * 73244475) & 4294967295)"


def mixed(x: str) -> str:
    twice = _HALF.format(_HALF.format(x))
    return f"xor({twice} >> 16, {twice})"


MIXED = mixed("{0}")

PLACES = """places AS (
  SELECT s_suppkey, 6e0 + (s_suppkey % 100) * 0.06e0 AS lon, 45e0 + (s_suppkey % 37) * 0.25e0 AS lat FROM supplier
)"""


#: The ellipsoid's rectifying radius and first eccentricity, and the projection's published
#: series coefficients for it (WGS84), to double precision.
RECTIFYING, ECCENTRICITY = "6367449.145823415e0", "0.0818191908426215e0"

KRUGER = ("8.377318206244698e-4", "7.608527773572307e-7", "1.197645503329453e-9", "2.4291706072013587e-12", "5.711757677865804e-15", "1.4911177312583895e-17")


def utm_sql() -> str:
    """The projection's series, spelt out with numbers of the ellipsoid."""
    east = " + ".join(f"{a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(KRUGER, 1))
    north = " + ".join(f"{a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(KRUGER, 1))
    return f"""WITH {PLACES}, a AS (
  SELECT s_suppkey, radians(lon - 9) AS l, sinh(atanh(sin(radians(lat))) - {ECCENTRICITY} * atanh({ECCENTRICITY} * sin(radians(lat)))) AS t FROM places
), b AS (SELECT s_suppkey, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM a)
SELECT s_suppkey, round(500000 + 0.9996e0 * {RECTIFYING} * (eta + {east}), 3) AS x, round(0.9996e0 * {RECTIFYING} * (xi + {north}), 3) AS y FROM b"""


def direct_sql(source: str, keep: str, lon: str, lat: str, azimuth: str, metres: str) -> str:
    """CTEs that end in ``ended``: the end of the geodesic on the ellipsoid, in three fixed steps."""
    step = "sigma_0 + b2 * sin({s}) * (cos(2 * s1 + {s}) + b2 / 4 * (cos({s}) * (2 * pow(cos(2 * s1 + {s}), 2) - 1) - b2 / 6 * cos(2 * s1 + {s}) * (4 * pow(sin({s}), 2) - 3) * (4 * pow(cos(2 * s1 + {s}), 2) - 3)))"
    f, minor = "(1e0 / 298.257223563e0)", "6356752.314245179e0"
    return f"""g0 AS (SELECT {keep}, {lon} AS lon_1, radians({azimuth}) AS az, atan((1 - {f}) * tan(radians({lat}))) AS u1, {metres} AS way FROM {source}),
g1 AS (SELECT *, atan2(tan(u1), cos(az)) AS s1, cos(u1) * sin(az) AS sa FROM g0),
g2 AS (SELECT *, 1 - sa * sa AS c2, (1 - sa * sa) * (pow(6378137e0, 2) - pow({minor}, 2)) / pow({minor}, 2) AS k FROM g1),
g3 AS (SELECT *, way / ({minor} * (1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768)))) AS sigma_0, k / 1024 * (256 + k * (k * (74 - 47 * k) - 128)) AS b2 FROM g2),
g4 AS (SELECT *, {step.format(s="sigma_0")} AS sigma_1 FROM g3), g5 AS (SELECT *, {step.format(s="sigma_1")} AS sigma_2 FROM g4), g6 AS (SELECT *, {step.format(s="sigma_2")} AS sg FROM g5),
g7 AS (SELECT *, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS cc, cos(2 * s1 + sg) AS cm, atan2(sin(sg) * sin(az), cos(u1) * cos(sg) - sin(u1) * sin(sg) * cos(az)) AS lam FROM g6),
ended AS (SELECT {keep}, degrees(atan2(sin(u1) * cos(sg) + cos(u1) * sin(sg) * cos(az), (1 - {f}) * sqrt(sa * sa + pow(sin(u1) * sin(sg) - cos(u1) * cos(sg) * cos(az), 2)))) AS lat2,
  lon_1 + degrees(lam - (1 - cc) * {f} * sa * (sg + cc * sin(sg) * (cm + cc * cos(sg) * (2 * cm * cm - 1)))) AS lon2 FROM g7)"""


def sql() -> dict[str, str]:
    shaped = "WITH " + SHAPED
    out = {
        "segments_gap_cut": f"WITH {SEGMENTS} SELECT {SEGMENT_COLUMNS} FROM pairs",
        "segments_union": f"WITH {SEGMENTS} SELECT {SEGMENT_COLUMNS} FROM segs",
        "bucket_candidates": f"""WITH {FOUND} SELECT drone_id, step, density, id, round(dx, 6) + 0 AS dx, round(dy, 6) + 0 AS dy,
            round(horizontal, 6) AS horizontal, round(vertical, 6) AS vertical, paired FROM found""",
        "nearest_by_key": f"WITH {FOUND} SELECT drone_id, step, nearest, round(nearest_h, 6) AS nearest_h, round(nearest_v, 6) AS nearest_v FROM (SELECT drone_id, step, {NEAREST} FROM found GROUP BY ALL)",
        "labels": f"""WITH {FOUND}, best AS (SELECT drone_id, step, {NEAREST}, count(*) AS n, bool_or(horizontal <= 200 AND vertical <= 50) AS danger FROM found GROUP BY ALL),
            l AS (SELECT p.drone_id, p.step, p.density, p.alt, coalesce(danger, false) AS danger, coalesce(n, 0) AS n, nearest, nearest_h, nearest_v
              FROM pts p LEFT JOIN best b ON p.drone_id = b.drone_id AND p.step = b.step)
            SELECT drone_id, density, count(*) AS n_steps, count(*) FILTER (danger) AS dangers, CAST(sum(n) AS BIGINT) AS candidates, string_agg(step || ':' || danger::INTEGER || ':' || n || ':' || coalesce(nearest::VARCHAR, '') || ':'
              || coalesce({CENTI.format("nearest_h")}::VARCHAR, '') || ':' || coalesce({CENTI.format("nearest_v")}::VARCHAR, '') || ':' || {CENTI.format("alt")}, ';' ORDER BY step) AS trace FROM l GROUP BY ALL""",
        "group_size": f"WITH {FOUND} SELECT drone_id, step, count(*) AS n, bool_or(horizontal <= 200 AND vertical <= 50) AS danger, count(DISTINCT id) AS objects FROM found GROUP BY ALL",
        "fanout_danger": f"""WITH {FOUND}, best AS (SELECT drone_id, step, {NEAREST}, bool_or(horizontal <= 200 AND vertical <= 50) AS danger FROM found GROUP BY ALL)
            SELECT b.drone_id, b.step, nearest, round(nearest_h, 4) AS nearest_h, round(nearest_v, 4) AS nearest_v, round(dx, 4) + 0 AS dx, round(dy, 4) + 0 AS dy
            FROM best b LEFT JOIN found f ON b.drone_id = f.drone_id AND b.step = f.step AND b.nearest = f.id WHERE danger""",
        "confusion": f"{shaped} SELECT density, shape, {COUNTS} FROM long GROUP BY ALL",
        "roc_table": f"{shaped}, c AS (SELECT density, shape, {COUNTS} FROM long GROUP BY ALL) SELECT *, {RATES} FROM c",
        "plot_rows": f"""{shaped}, c AS (SELECT density, shape, {COUNTS} FROM long GROUP BY ALL)
            SELECT density, shape, round("TP" / nullif("TP" + "FN", 0), 6) AS "TPR", round("FP" / nullif("FP" + "TN", 0) * 1e6, 6) AS fp_per_million,
              max("TP" + "FN") OVER (PARTITION BY density) AS n_danger, max("TP" + "FN") OVER (PARTITION BY density) = 0 AS empty_panel FROM c""",
        "mcnemar": f"""{shaped}, ord(shape, o) AS (VALUES ('cylinder', 0), ('sphere', 1), ('ellipsoid', 2)), r AS (SELECT *, alert = danger AS good FROM long JOIN ord USING (shape)),
            c AS (SELECT a.density, a.shape AS shape_a, b.shape AS shape_b, count(*) FILTER (a.good AND b.good) AS both_correct, count(*) FILTER (NOT a.good AND NOT b.good) AS both_wrong,
                count(*) FILTER (NOT a.good AND b.good) AS a_only_wrong, count(*) FILTER (a.good AND NOT b.good) AS b_only_wrong
              FROM r a JOIN r b ON a.drone_id = b.drone_id AND a.step = b.step AND a.o < b.o GROUP BY ALL),
            k AS (SELECT *, least(a_only_wrong, b_only_wrong) AS few, a_only_wrong + b_only_wrong AS n FROM c)
            SELECT k.* EXCLUDE (few, n), CAST(few AS DOUBLE) AS statistic,
              round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2e0))) FROM range(few + 1) x(i))), 9) AS pvalue FROM k""",
        "per_cluster": f"{shaped} SELECT density, shape, drone_id, {COUNTS} FROM long GROUP BY ALL",
        "bootstrap_ci": f"""{shaped}, c AS (SELECT density, shape, drone_id, {COUNTS} FROM long GROUP BY ALL),
            u AS (SELECT *, {WORD.format("'42|' || density || '|' || drone_id")} AS base FROM (SELECT DISTINCT density, drone_id FROM c)),
            units AS (SELECT *, row_number() OVER (PARTITION BY density ORDER BY base, drone_id) - 1 AS i FROM u),
            sizes AS (SELECT density, count(*) AS n, greatest(0, 1 - 6 / sqrt(count(*))) AS lam, {WORD.format("'42|' || density || '|rest'")} AS own FROM units GROUP BY density),
            steps AS (SELECT *, {", ".join(f"CAST(ceil(4294967296e0 * (exp(-lam) * ({' + '.join(f'pow(lam, {j}) / {math.factorial(j)}e0' for j in range(k + 1))}))) AS BIGINT) AS t{k}" for k in range(15))} FROM sizes),
            d AS (SELECT units.density, drone_id, rep, {MIXED.format("(base + rep * 2654435761) & 4294967295")} AS u, steps.* EXCLUDE (density) FROM units JOIN steps USING (density), range(1000) r(rep)),
            w AS (SELECT density, drone_id, rep, n, own, {" + ".join(f"(u >= t{k})::INTEGER" for k in range(15))} AS times FROM d),
            lacking AS (SELECT density, rep, any_value(n) AS n, any_value(own) AS own, any_value(n) - sum(times) AS k FROM w GROUP BY density, rep),
            extra AS (SELECT density, rep, n, {MIXED.format("(own + rep * 2654435761) & 4294967295")} AS h, unnest(range(1, CAST(k AS BIGINT) + 1)) AS j FROM lacking),
            picked AS (SELECT e.density, e.rep, drone_id FROM (SELECT density, rep, {MIXED.format("(h + j * 2654435761) & 4294967295")} % n AS i FROM extra) e JOIN units USING (density, i)),
            drawn AS (SELECT density, rep, drone_id, times FROM w WHERE times > 0 UNION ALL SELECT density, rep, drone_id, 1 FROM picked),
            s AS (SELECT density, shape, rep, sum("TP" * times) AS "TP", sum("FP" * times) AS "FP", sum("TN" * times) AS "TN", sum("FN" * times) AS "FN", sum(times) AS draws
              FROM drawn JOIN c USING (density, drone_id) GROUP BY ALL),
            r AS (SELECT density, shape, draws, "TP" / nullif("TP" + "FN", 0) AS tpr, "FP" / nullif("FP" + "TN", 0) AS fpr FROM s)
            SELECT density, shape, round(quantile_cont(tpr, 0.025), 9) AS tpr_low, round(quantile_cont(tpr, 0.975), 9) AS tpr_high,
              round(quantile_cont(fpr, 0.025), 9) AS fpr_low, round(quantile_cont(fpr, 0.975), 9) AS fpr_high, CAST(max(draws) AS BIGINT) AS n_clusters FROM r GROUP BY density, shape""",
        "sensitivity": f"""{shaped}, sh(shift_pct, h, v) AS (VALUES (-20, 160e0, 40e0), (0, 200e0, 50e0), (20, 240e0, 60e0)),
            hit AS (SELECT DISTINCT drone_id, step, shift_pct FROM inside, sh WHERE horizontal <= h AND vertical <= v),
            m AS (SELECT l.density, l.shape, l.alert, s.*, hit.drone_id IS NOT NULL AS danger FROM long l CROSS JOIN sh s LEFT JOIN hit ON hit.drone_id = l.drone_id AND hit.step = l.step AND hit.shift_pct = s.shift_pct),
            c AS (SELECT density, shape, shift_pct, h AS horizontal_threshold_m, v AS vertical_threshold_m, {COUNTS} FROM m GROUP BY ALL) SELECT *, {RATES} FROM c""",
        "dedup_keep_last": f"WITH {DAYS} SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS n FROM days) WHERE n = 1",
        "dedup_null_passthrough": f"""WITH {DAYS}, m AS (SELECT * REPLACE (CASE WHEN event_type <> 'signup' THEN day END AS day) FROM days)
            SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS n FROM m WHERE day IS NOT NULL) WHERE n = 1
            UNION ALL SELECT * FROM m WHERE day IS NULL""",
        "distinct_keys": f"WITH {DAYS} SELECT DISTINCT user_id, day FROM days",
        "airborne_filter": f"WITH {EVENTS}, {REPORTS} SELECT * FROM reports WHERE NOT on_ground AND geo_altitude IS NOT NULL",
        "airborne_display": f"WITH {EVENTS}, {REPORTS} SELECT * FROM reports WHERE NOT on_ground AND latitude IS NOT NULL AND longitude IS NOT NULL",
        "box_filter": f"WITH {OBS} SELECT id, event_id, round(t, 6) AS t, round(x, 6) AS x, round(y, 6) AS y, round(alt, 6) AS alt FROM obs WHERE y BETWEEN 40 AND 400 AND x BETWEEN 200 AND 1500",
        "range_overlap": "SELECT CAST(epoch(min(o_orderdate)) AS BIGINT) AS first_s, CAST(epoch(max(o_orderdate)) AS BIGINT) AS last_s, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_totalprice > 100000) AS large FROM orders",
        "partition_latest": "WITH d AS (SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders) SELECT * FROM d WHERE date = (SELECT max(date) FROM d)",
        "partitions_open": f"WITH {DAYS} SELECT DISTINCT day FROM days WHERE day < (SELECT max(day) FROM days) AND CAST(right(day, 2) AS INTEGER) % 2 = 1",
        "coerce_numeric": f"""WITH {EVENTS}, r AS (SELECT event_id, k, CASE WHEN k % 3 = 0 THEN k || '.0' WHEN k % 3 = 1 THEN 'abc' WHEN k % 5 = 0 THEN '' ELSE value::VARCHAR END AS raw FROM ev)
            SELECT event_id, round(try_cast(raw AS DOUBLE), 6) AS as_double, CAST(trunc(try_cast(raw AS DOUBLE)) AS BIGINT) AS as_long,
              CASE WHEN k % 3 = 0 THEN CAST(try_cast(raw AS DOUBLE) AS INTEGER) ELSE 0 END AS as_byte FROM r""",
        "bool_parse": f"WITH {EVENTS} SELECT event_id, k % 6 = 0 AS parsed FROM ev",
        "trim_variants": """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN '' WHEN 2 THEN c_name END AS reported, CASE c_custkey % 4 WHEN 2 THEN c_name END AS stored,
            lower(replace(c_name, ' ', '_')) AS slug, 'dense_' || lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INTEGER, '0') AS numbered, '10-20-30' AS safe FROM customer""",
        "list_parse": f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 4 = 0 THEN k || ',2' END AS items FROM ev",
        "epoch_forms": f"WITH {EVENTS} SELECT event_id, round(t, 6) AS seconds, CAST(round_even(t, 0) AS BIGINT) AS whole, strftime(ts, '%Y-%m-%d') AS day FROM ev",
        "left_fill": "SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
        "semi_flag": "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS flagged FROM orders",
        "fanout_left": "SELECT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_discount > 0.05 WHERE o_orderstatus = 'F'",
        "grain_inner": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
        "full_outer": """SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, a, b FROM (SELECT l_partkey, bool_or(l_returnflag = 'R') AS a FROM lineitem GROUP BY 1) a
            FULL JOIN (SELECT l_partkey, bool_or(l_linestatus = 'O') AS b FROM lineitem WHERE l_quantity < 10 GROUP BY 1) b ON a.l_partkey = b.l_partkey""",
        "coalesced": f"WITH {EVENTS} SELECT event_id, round(CASE WHEN k % 2 = 0 THEN value ELSE k END, 6) AS alt FROM ev",
        "group_first_last": f"""WITH {EVENTS} SELECT user_id, round(min(t), 6) AS t0, round(max(t), 6) AS t1, round(arg_min(value, (ts, event_id)) FILTER (k % 7 <> 0), 6) AS first_value,
            arg_max(k, (ts, event_id)) AS last_k, count(*) AS n FROM ev GROUP BY user_id""",
        "collect_points": f"WITH {OBS} SELECT id, string_agg(CAST(round_even(t, 0) AS BIGINT) || ':' || CAST(round_even(x, 0) AS BIGINT), ';' ORDER BY CAST(round_even(t, 0) AS BIGINT), event_id) AS points FROM obs GROUP BY id",
        "first_nonblank": f"WITH {EVENTS} SELECT user_id, arg_min('C' || k || ' ', (ts, event_id)) FILTER (k % 3 = 1) AS callsign FROM ev GROUP BY user_id",
        "quantized": """WITH b AS (SELECT min(p_retailprice) AS l1, max(p_retailprice) AS h1, CAST(min(p_size) AS DOUBLE) AS l2, CAST(max(p_size) AS DOUBLE) AS h2 FROM part), s AS (SELECT *, (h1 - l1) / 65535 AS s1, (h2 - l2) / 65535 AS s2 FROM b)
            SELECT p_partkey, CAST(round_even(p_retailprice / s1, 0) + round_even(-l1 / s1, 0) - 32768 AS BIGINT) AS q_p_retailprice,
              CAST(round_even(p_size / s2, 0) + round_even(-l2 / s2, 0) - 32768 AS BIGINT) AS q_p_size FROM part, s""",
        "dequant_error": """WITH b AS (SELECT min(p_retailprice) AS l1, max(p_retailprice) AS h1, CAST(min(p_size) AS DOUBLE) AS l2, CAST(max(p_size) AS DOUBLE) AS h2 FROM part), s AS (SELECT *, (h1 - l1) / 65535 AS s1, (h2 - l2) / 65535 AS s2 FROM b)
            SELECT round(max(abs(s1 * round_even(p_retailprice / s1, 0) - p_retailprice)), 6) AS error_p_retailprice, round(max(abs(s2 * round_even(p_size / s2, 0) - p_size)), 6) AS error_p_size, round(max(s1 / 2), 6) AS half_step FROM part, s""",
        "bbox_overlap": """SELECT vec_id, greatest(embedding[1], embedding[3], embedding[5]) >= -0.1 AND least(embedding[1], embedding[3], embedding[5]) <= 0.1
            AND greatest(embedding[2], embedding[4], embedding[6]) >= -0.1 AND least(embedding[2], embedding[4], embedding[6]) <= 0.1 AS overlaps FROM embeddings""",
        "utm_project": utm_sql(),
        "geodesic_direct": f"""WITH {PLACES}, aimed AS (SELECT *, (s_suppkey * 7) % 360 AS azimuth, 100e0 + (s_suppkey % 79) * 100e0 AS metres FROM places),
            {direct_sql("aimed", "s_suppkey", "lon", "lat", "azimuth", "metres")} SELECT s_suppkey, round(lon2, 9) AS lon2, round(lat2, 9) AS lat2 FROM ended""",
        "json_states_explode": """WITH """ + EVENTS + """, r AS (SELECT date_trunc('hour', ts) AS query_timestamp_utc, event_id, 'u' || user_id AS icao24, event_type AS callsign, CAST(floor(t) AS BIGINT) AS time_position,
              k * 0.1e0 AS longitude, value AS latitude, event_type = 'signup' AS on_ground, k * 1.2e0 AS geo_altitude, '0743' AS squawk FROM ev)
            SELECT query_timestamp_utc, icao24, callsign, time_position, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, on_ground, round(geo_altitude, 6) AS geo_altitude, squawk
            FROM (SELECT *, row_number() OVER (PARTITION BY icao24, query_timestamp_utc ORDER BY event_id DESC) AS n FROM r) WHERE n = 1""",
        "equal_volumes": """WITH v AS (SELECT c_custkey, lower(replace(n_name, ' ', '_')) AS slug, pi() * pow(50e0 + c_custkey % 300, 2) * 2 * (10e0 + c_nationkey % 25) AS volume
              FROM customer JOIN nation ON c_nationkey = n_nationkey)
            SELECT c_custkey, slug, round(cbrt(volume * 3 / (4 * pi())), 6) AS sphere_m, round(3 * cbrt(volume / (4 * pi())), 6) AS major_m, round(cbrt(volume / (4 * pi())), 6) AS minor_m FROM v""",
        "aircraft_points": f"""WITH {OBS}, b AS (SELECT min(y) AS ly, (max(y) - min(y)) / 65535 AS sy, min(x) AS lx, (max(x) - min(x)) / 65535 AS sx, min(alt) AS la, (max(alt) - min(alt)) / 65535 AS sa FROM obs),
            o AS (SELECT id, event_id, CAST(round_even(t, 0) - round_even(min(t) OVER (PARTITION BY id), 0) AS BIGINT) AS dt, CAST(round_even(y / sy, 0) + round_even(-ly / sy, 0) - 32768 AS BIGINT) AS qy,
              CAST(round_even(x / sx, 0) + round_even(-lx / sx, 0) - 32768 AS BIGINT) AS qx, CAST(round_even(alt / sa, 0) + round_even(-la / sa, 0) - 32768 AS BIGINT) AS qa FROM obs, b)
            SELECT id, string_agg(dt || ':' || qy || ':' || qx || ':' || qa, ';' ORDER BY dt, event_id) AS points FROM o GROUP BY id""",
        "cylinder_agrees": f"{shaped} SELECT density, count(*) AS n, count(*) FILTER (cylinder <> danger) AS differing FROM evaluated GROUP BY density",
        "zoned_times": f"""WITH {EVENTS} SELECT event_id, CASE WHEN k % 4 <> 3 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CASE WHEN k % 4 = 1 THEN 7200 ELSE 0 END END AS seconds, k % 4 = 2 AS assumed FROM ev""",
        "micros": f"WITH {EVENTS} SELECT event_id, CAST(round_even((t + k * 0.001234e0) * 1e6, 0) AS BIGINT) AS micros FROM ev",
    }
    for shape in ("cylinder", "sphere", "ellipsoid"):
        out[f"alerts_{shape}"] = f"{shaped} SELECT drone_id, step, density, {shape} AS alert, n AS n_candidates FROM evaluated"
    return out
