"""SQL counterparts of the registered queries, written independently of the DataFrame code.

Each query selects from named views; `sql` puts the views it needs, and the views those need, in
front as common table expressions. Nearest searches are brute force, fits use the built-in
regression aggregates, and the text reports are skipped: values come straight from the tables.
"""

from __future__ import annotations

import re

from airtoll import schemas as S
from airtoll.functions.student import NORMAL_975
from airtoll.plans import bindings as B
from airtoll.sources import reports as P

PAIRS = list(S.ENDPOINT_OF_RATE.items())
SVI_NAMES = list((S.SVI_RANKS | S.SVI_INDICATORS).items())


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)


def _rank(column: str, order: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_text(v)} THEN {i}" for i, v in enumerate(order, 1)) + " END"


def _series(kind: str, coefficients: list[float], angle: str, other: str | None = None) -> str:
    trig, hyper = ("sin", "cosh") if kind == "sin" else ("cos", "sinh")
    parts = []
    for j, c in enumerate(coefficients, 1):
        part = f"({c!r}) * {trig}({2 * j} * {angle})"
        parts.append(part + (f" * {hyper}({2 * j} * {other})" if other else ""))
    return " + ".join(parts)


POLLUTANT = "CASE l_returnflag WHEN 'A' THEN 'PM' WHEN 'N' THEN 'NOx' ELSE 'SO2' END"
CONDITION = ("(CASE WHEN l_linenumber % 3 = 0 THEN 'Max' ELSE 'Typical' END || ' ' || "
             "CASE l_linestatus WHEN 'F' THEN 'Controlled' ELSE 'Uncontrolled' END)")
LEVEL = "abs(l_discount) * 100"
ENDPOINT = "[" + ", ".join(_text(e) for e in S.ENDPOINT_OF_RATE.values()) + f"][l_linenumber % {len(S.ENDPOINT_OF_RATE)} + 1]"
IDLE_CONDITION = f"CASE WHEN l_linenumber % 7 = 0 THEN 'Idle Controlled' ELSE {CONDITION} END"
GEOID = "printf('%05d%06d', c_nationkey, c_custkey)"
SVI_SQL = ", ".join(
    f"c_custkey * {prime} % 1000 / {1000.0 if i < 5 else 10.0} AS {new}"
    for i, ((_, new), prime) in enumerate(zip(SVI_NAMES, B.SVI_PRIMES, strict=True)))
# The inverse transverse Mercator series in powers of the third flattening, to the fourth.
FLAT = 1 / 298.257223563
N = FLAT / (2 - FLAT)
SCALE = 0.9996 * (6378137.0 / (1 + N) * (1 + N**2 / 4 + N**4 / 64))
TO_CONFORMAL = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840,
                4397 * N**4 / 161280]
TO_GEODETIC = [2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35,
               4279 * N**4 / 630]


def _tail(t: str, df: str) -> str:
    """Two-sided Student t probability: finite trigonometric series for even and odd df."""
    cos2 = f"({df} / ({df} + {t} * {t}))"
    even = f"exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow({cos2}, k)"
    odd = f"exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow({cos2}, k + 0.5)"
    sine = f"abs({t}) / sqrt({df} + {t} * {t})"
    return f"""CASE WHEN {df} % 2 = 0
        THEN 1 - {sine} * list_sum(list_transform(range(0, {df} // 2), lambda k: {even}))
        ELSE 1 - 2 / pi() * (atan(abs({t}) / sqrt({df}))
            + {sine} * list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: {odd}))) END"""


def _models(tag: str, keys: list[str], source: str, outcome: str, always: list[str], chosen: str,
            variables: list[str] = S.INDICATORS) -> dict[str, str]:
    """Views of one multi-variable model per group: chosen variables followed by the `always` terms.

    model_{tag}(keys, term, b, se, df, n). A value list per row ends with the outcome.
    """
    key = ", ".join(keys)
    named = ", ".join(f"r.{k}" for k in keys)
    cases = " ".join(f"WHEN '{v}' THEN r.{v}" for v in (*variables, *always))
    order = "[" + ", ".join(_text(v) for v in (*variables, *always)) + "]"
    return {
        f"terms_{tag}": f"""
            SELECT {key}, list_filter({order}, lambda v: list_contains(vars, v) OR list_contains({always!r}, v)) AS terms
            FROM ({chosen})""",
        f"value_{tag}": f"""
            SELECT {named}, terms, list_append(list_transform(terms, lambda v: CASE v {cases} END), {outcome}) AS v
            FROM {source} r JOIN terms_{tag} t ON {' AND '.join(f't.{k} = r.{k}' for k in keys)}""",
        f"pair_{tag}": f"""
            SELECT {key}, terms, v, unnest(range(1, len(v) + 1)) AS i FROM value_{tag}
            WHERE len(list_filter(v, lambda x: x IS NULL)) = 0""",
        f"product_{tag}": f"""
            SELECT {key}, terms, i, j, covar_pop(v[i], v[j]) * count(*) AS s, avg(v[i]) AS mean, count(*) AS n
            FROM (SELECT *, unnest(range(1, len(v) + 1)) AS j FROM pair_{tag}) GROUP BY {key}, terms, i, j""",
        f"matrix_{tag}": f"""
            SELECT {key}, terms, n, list(line ORDER BY i) AS m, list(mean ORDER BY i) AS means FROM (
                SELECT {key}, terms, i, max(n) AS n, max(mean) AS mean, list(s ORDER BY j) AS line
                FROM product_{tag} GROUP BY {key}, terms, i) GROUP BY {key}, terms, n""",
        f"sweep_{tag}": f"""
            SELECT {key}, terms, n, means, 1 AS k, m FROM matrix_{tag}
            UNION ALL
            SELECT {key}, terms, n, means, k + 1, list_transform(m, lambda line, i: list_transform(line, lambda s, j:
                CASE WHEN i = k AND j = k THEN 1 / s WHEN i = k THEN s / m[k][k] WHEN j = k THEN -s / m[k][k]
                     ELSE s - m[i][k] * m[k][j] / m[k][k] END))
            FROM sweep_{tag} WHERE k <= len(terms)""",
        f"solved_{tag}": f"""
            SELECT *, len(terms) AS p, n - 1 - len(terms) AS df, m[len(terms) + 1][len(terms) + 1] AS rest
            FROM sweep_{tag} WHERE k = len(terms) + 1""",
        f"model_{tag}": f"""
            SELECT {key}, terms[w] AS term, m[w][p + 1] AS b, sqrt(rest / df * m[w][w]) AS se, df, n
            FROM (SELECT *, unnest(range(1, p + 1)) AS w FROM solved_{tag})
            UNION ALL
            SELECT {key}, '(Intercept)', means[p + 1] - list_sum(list_transform(range(1, p + 1), lambda a: means[a] * m[a][p + 1])),
                   sqrt(rest / df * (1 / n + list_sum(list_transform(range(1, p + 1), lambda a: list_sum(list_transform(
                       range(1, p + 1), lambda c: means[a] * means[c] * m[a][c])))))), df, n
            FROM solved_{tag}""",
    }


B_RADIUS = "6371010.0"


def _hav(lon: str, lat: str, other_lon: str, other_lat: str) -> str:
    """Metres between two places by the haversine formula."""
    return (f"(2 * {B_RADIUS} * asin(sqrt(pow(sin(radians(({other_lat}) - ({lat})) / 2), 2)"
            f" + cos(radians({lat})) * cos(radians({other_lat})) * pow(sin(radians(({other_lon}) - ({lon})) / 2), 2))))")


def _bearing(lon: str, lat: str, other_lon: str, other_lat: str) -> str:
    turn = f"radians({other_lon} - {lon})"
    return (f"atan2(sin({turn}) * cos(radians({other_lat})), cos(radians({lat})) * sin(radians({other_lat}))"
            f" - sin(radians({lat})) * cos(radians({other_lat})) * cos({turn}))")


VIEWS: dict[str, str] = {
    "tract": f"""
        SELECT c_custkey, {GEOID} AS GEOID, printf('%06d', c_custkey) AS TRACTCE,
               CAST(c_custkey % 1000 AS VARCHAR) AS NAME, 'County ' || c_nationkey % 20 AS NAMELSADCO,
               lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS STATEFP,
               CASE WHEN c_nationkey % 2 = 0 THEN 'MD' ELSE 'DC' END AS STUSPS,
               lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS county_fips,
               CASE WHEN c_custkey % 97 <> 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS x0, CAST(c_custkey // 50 AS DOUBLE) AS y0
        FROM customer""",
    "city_tract": f"SELECT GEOID, NAME, NAMELSADCO FROM tract WHERE county_fips = '{B.CITY}'",
    "county": """
        SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS GEOID, n_name AS NAME,
               'County ' || n_nationkey % 20 AS NAMELSAD FROM nation""",
    "point": f"""
        SELECT {POLLUTANT} AS pollutant, {CONDITION} AS condition,
               2 * (l_partkey % 20) + (l_orderkey * 7 + l_linenumber * 13) % 1000 / 1000.0::DOUBLE
                   + 0.0005::DOUBLE AS x,
               (l_suppkey * 3 + l_partkey) % 20 + (l_orderkey * 11 + l_suppkey * 17) % 1000 / 1000.0::DOUBLE
                   + 0.0005::DOUBLE AS y,
               CASE WHEN (l_orderkey + l_linenumber) % 37 <> 0 THEN {LEVEL} END AS conc
        FROM lineitem""",
    "match": """
        SELECT pollutant, condition, x, y, conc, GEOID FROM point LEFT JOIN tract
        ON x >= x0 AND x <= x0 + 1 AND y >= y0 AND y <= y0 + 1""",
    "inside": """
        SELECT pollutant, condition, GEOID, avg(conc) AS mean FROM match WHERE GEOID IS NOT NULL
        GROUP BY ALL""",
    "site": "SELECT DISTINCT pollutant, condition, x, y, conc FROM point",
    "empty_tract": """
        SELECT s.pollutant, s.condition, t.GEOID, t.x0, t.y0
        FROM tract t, (SELECT DISTINCT pollutant, condition FROM point) s
        WHERE t.x0 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.GEOID = t.GEOID AND i.pollutant = s.pollutant
                          AND i.condition = s.condition)""",
    "distance": """
        SELECT e.pollutant, e.condition, e.GEOID, s.x, s.y, s.conc,
               round(sqrt(pow(greatest(e.x0 - s.x, s.x - (e.x0 + 1), 0), 2)
                        + pow(greatest(e.y0 - s.y, s.y - (e.y0 + 1), 0), 2)), 9) AS d
        FROM empty_tract e JOIN site s ON e.pollutant = s.pollutant AND e.condition = s.condition""",
    "near": """
        SELECT pollutant, condition, GEOID, min(struct_pack(
            d := d, x := x, y := y, known := CASE WHEN conc IS NULL THEN 0 ELSE 1 END, conc := conc)) AS best
        FROM distance GROUP BY ALL""",
    "assigned": f"""
        SELECT pollutant, condition, GEOID, mean AS Final_Conc, '{S.AVERAGED}' AS Source FROM inside
        UNION ALL SELECT pollutant, condition, GEOID, best.conc, '{S.NEAREST}' FROM near""",
    "outline": f"""
        SELECT c_custkey AS k, {GEOID} AS GEOID, printf('%06d', c_custkey) AS TRACTCE, c_custkey % 64 AS i, c_custkey // 64 % 8192 AS j
        FROM customer""",
    "outline_vertex": """
        SELECT k, 0 AS ring, v, 0.125::DOUBLE + v // 4 * (0.75::DOUBLE / n) + v % 4 * (0.75::DOUBLE / n) / 4 AS px,
               CASE WHEN v % 4 IN (1, 2) THEN 0.875::DOUBLE ELSE 0.5 END AS py
        FROM (SELECT k, n, unnest(range(0, 4 * n)) AS v FROM (SELECT k, CASE WHEN k % 50 = 0 THEN 256 ELSE 16 END AS n FROM outline WHERE k % 3 = 0))
        UNION ALL SELECT k, 0, 5000 + w.v, w.px, w.py FROM outline, (VALUES (0, 0.875, 0.5), (1, 0.875, 0.125), (2, 0.125, 0.125)) w(v, px, py)
        WHERE k % 3 = 0
        UNION ALL SELECT k, b.ring, c.v, CASE WHEN c.v IN (1, 2) THEN b.x1 ELSE b.x0 END, CASE WHEN c.v IN (2, 3) THEN b.y1 ELSE b.y0 END
        FROM outline, (VALUES (1, 0, 0.125, 0.875, 0.125, 0.875), (1, 1, 0.375, 0.625, 0.375, 0.625),
                              (2, 0, 0.125, 0.375, 0.125, 0.875), (2, 1, 0.625, 0.875, 0.125, 0.875)) b(kind, ring, x0, x1, y0, y1),
             (VALUES (0), (1), (2), (3)) c(v) WHERE k % 3 = b.kind""",
    "outline_edge": """
        SELECT k, i, j, GEOID, ax, ay, coalesce(lead(ax) OVER w, first_value(ax) OVER w) AS ex, coalesce(lead(ay) OVER w, first_value(ay) OVER w) AS ey
        FROM (SELECT o.*, ring, v, -77.0::DOUBLE + (i + px) * (1.0::DOUBLE / 128) AS ax, 10.0::DOUBLE + (j + py) * (1.0::DOUBLE / 128) AS ay
              FROM outline o JOIN outline_vertex USING (k) WHERE k % 97 <> 0)
        WINDOW w AS (PARTITION BY k, ring ORDER BY v)""",
    "outline_point": f"""
        SELECT {POLLUTANT} AS pollutant, {CONDITION} AS condition,
               -77.0::DOUBLE + (2 * (l_partkey % 32) + (l_orderkey * 7 + l_linenumber * 13) % 1000 / 1000.0::DOUBLE
                   + 0.0005::DOUBLE) * (1.0::DOUBLE / 128) AS x,
               10.0::DOUBLE + ((l_suppkey * 3 + l_partkey) % 20 + (l_orderkey * 11 + l_suppkey * 17) % 1000 / 1000.0::DOUBLE
                   + 0.0005::DOUBLE) * (1.0::DOUBLE / 128) AS y,
               CASE WHEN (l_orderkey + l_linenumber) % 37 <> 0 THEN {LEVEL} END AS conc
        FROM lineitem""",
    "outline_inside": """
        SELECT x, y, GEOID FROM (SELECT DISTINCT x, y FROM outline_point) p
        JOIN outline_edge e ON e.i = floor((x + 77) * 128) AND e.j = floor((y - 10) * 128)
        GROUP BY x, y, GEOID
        HAVING count(*) FILTER ((ax > x) <> (ex > x) AND y < ay + (ey - ay) * (x - ax) / (ex - ax)) % 2 = 1""",
    "outline_match": "SELECT p.*, GEOID FROM outline_point p LEFT JOIN outline_inside USING (x, y)",
    "outline_mean": """
        SELECT pollutant, condition, GEOID, avg(conc) AS mean FROM outline_match WHERE GEOID IS NOT NULL GROUP BY ALL""",
    "outline_ring": """
        SELECT k, GEOID, -77.0::DOUBLE + (i + 0.5) / 128 AS mx, 10.0::DOUBLE + (j + 0.5) / 128 AS my FROM outline WHERE k % 97 <> 0""",
    "outline_far": f"""
        SELECT pollutant, condition, t.GEOID, s.x, s.y, conc, {_hav('mx', 'my', 's.x', 's.y')} AS d,
               {_hav('mx', 'my', 'mx - 1 / 256.0', 'my - 1 / 256.0')} AS half
        FROM outline_ring t, (SELECT DISTINCT pollutant, condition, x, y, conc FROM outline_point) s
        WHERE NOT EXISTS (SELECT 1 FROM outline_mean m WHERE m.GEOID = t.GEOID AND m.pollutant = s.pollutant AND m.condition = s.condition)""",
    "outline_least": "SELECT pollutant, condition, GEOID, min(d) + 2.02 * max(half) AS most FROM outline_far GROUP BY ALL",
    "outline_close": """
        SELECT f.* FROM outline_far f JOIN outline_least l USING (pollutant, condition, GEOID) WHERE d <= most""",
    "outline_arc": f"""
        SELECT pollutant, condition, c.GEOID, x, y, conc, {_hav('ax', 'ay', 'x', 'y')} / {B_RADIUS} AS d13, {_hav('ex', 'ey', 'x', 'y')} / {B_RADIUS} AS d23,
               {_hav('ax', 'ay', 'ex', 'ey')} / {B_RADIUS} AS d12, {_bearing('ax', 'ay', 'x', 'y')} - {_bearing('ax', 'ay', 'ex', 'ey')} AS turn
        FROM outline_close c JOIN outline_edge e ON e.GEOID = c.GEOID""",
    "outline_near": f"""
        SELECT pollutant, condition, GEOID, min(struct_pack(d := d, x := x, y := y, known := CASE WHEN conc IS NULL THEN 0 ELSE 1 END, conc := conc)) AS best
        FROM (SELECT pollutant, condition, GEOID, x, y, conc, round(min(CASE WHEN atan2(sin(d13) * cos(turn), cos(d13)) BETWEEN 0 AND d12
                  THEN abs(asin(sin(d13) * sin(turn))) ELSE least(d13, d23) END) * {B_RADIUS}, 4) AS d
              FROM outline_arc GROUP BY ALL)
        GROUP BY ALL""",
    "outline_assigned": f"""
        SELECT pollutant, condition, GEOID, mean AS Final_Conc, '{S.AVERAGED}' AS Source FROM outline_mean
        UNION ALL SELECT pollutant, condition, GEOID, best.conc, '{S.NEAREST}' FROM outline_near""",
    "receptor": f"""
        SELECT 350000 + l_partkey * 37 % 20000 + l_linenumber * 0.25::DOUBLE AS X,
               4340000 + l_orderkey * 13 % 20000 + l_suppkey % 2 * 0.5::DOUBLE AS Y, {LEVEL} AS conc,
               'Plant ' || year(l_shipdate) || ' ' || {POLLUTANT} || ' Annual.csv' AS file_name
        FROM lineitem""",
    "mixed": f"""
        SELECT file_name, X, Y, CASE WHEN yr % 3 <> 2 THEN conc END AS conc, k, n, conc AS c0, yr % 3 AS layout,
               CASE WHEN yr % 3 = 2 OR yr % 3 = 1 AND pollutant = 'PM' THEN 'row, ' || n END AS note
        FROM (SELECT 350000 + l_partkey * 37 % 20000 + l_linenumber * 0.25::DOUBLE AS X, year(l_shipdate) AS yr, {POLLUTANT} AS pollutant,
                     4340000 + l_orderkey * 13 % 20000 + l_suppkey % 2 * 0.5::DOUBLE AS Y, {LEVEL} AS conc, l_orderkey AS k, l_linenumber AS n,
                     'Plant ' || year(l_shipdate) || ' ' || {POLLUTANT} || ' Annual.csv' AS file_name
              FROM lineitem)""",
    "utm0": f"""
        SELECT DISTINCT X, Y, Y / {SCALE!r} AS xi, (X - 500000) / {SCALE!r} AS eta FROM receptor""",
    "utm1": f"""
        SELECT X, Y, xi - ({_series('sin', TO_CONFORMAL, 'xi', 'eta')}) AS xi,
               eta - ({_series('cos', TO_CONFORMAL, 'xi', 'eta')}) AS eta FROM utm0""",
    "utm2": "SELECT X, Y, xi, eta, asin(sin(xi) / cosh(eta)) AS chi FROM utm1",
    "lonlat": f"""
        SELECT X, Y, -75.0 + degrees(atan2(sinh(eta), cos(xi))) AS lon,
               degrees(chi + {_series('sin', TO_GEODETIC, 'chi')}) AS lat FROM utm2""",
    "place": """
        SELECT s_name AS place, -76.9::DOUBLE + s_suppkey * 7 % 100 / 250.0::DOUBLE AS px,
               39.15::DOUBLE + s_suppkey * 13 % 100 / 400.0::DOUBLE AS py FROM supplier""",
    "named": """
        SELECT X, Y, lon, lat, arg_min(place, struct_pack(d := d, px := px, py := py, place := place)) AS place
        FROM (SELECT *, round(sqrt(pow((px - lon) * cos(radians(lat)), 2) + pow(py - lat, 2)), 9) AS d
              FROM lonlat, place)
        GROUP BY X, Y, lon, lat""",
    "monitor": """
        SELECT r.file_name, X, Y, conc, f.at * 100
            + row_number() OVER (PARTITION BY r.file_name ORDER BY Y, X, conc NULLS LAST) AS id
        FROM receptor r JOIN (SELECT file_name, row_number() OVER (ORDER BY file_name) - 1 AS at
                              FROM (SELECT DISTINCT file_name FROM receptor)) f USING (file_name)""",
    "people": f"""
        SELECT c_custkey, {GEOID} AS GEOID, 'Tract ' || c_custkey AS NAME,
               least(y.year, 2000) AS vintage, y.year,
               CASE WHEN c_custkey % 29 <> 0
                    THEN CAST(1000 + c_custkey % 5000 + (least(y.year, 2000) - 1995) * 10 AS DOUBLE) END AS total_pop,
               CAST(c_custkey * 7 % 3000 AS DOUBLE) AS white, CAST(c_custkey * 11 % 2000 AS DOUBLE) AS black,
               CAST(c_custkey * 13 % 500 AS DOUBLE) AS asian, CAST(c_custkey * 17 % 700 AS DOUBLE) AS hispanic,
               CAST(30000 + c_custkey * 19 % 90000 AS DOUBLE) AS median_income
        FROM customer, (SELECT unnest(range(1995, 2002)) AS year) y""",
    "release": """
        SELECT *, year AS released FROM people WHERE c_custkey % 101 <> 0 AND year <= 2000 AND (c_custkey * 7 + year * 11) % 13 < 4
        AND (c_custkey % 5 <> 0 OR year >= 1998)""",
    "some_people": "SELECT * FROM people WHERE c_custkey % 101 <> 0",
    "rate": """
        SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS county_fips, y.year,
               CAST(700 + 10 * n_nationkey + y.year - 1995 AS VARCHAR) AS mortality_rate,
               CAST(90 + n_nationkey + y.year - 1995 AS VARCHAR) AS diabetes_rate,
               CAST(50 + 2 * n_nationkey AS VARCHAR) AS cancer_rate,
               CAST(40 + n_nationkey AS VARCHAR) AS stroke_rate,
               CASE WHEN n_nationkey = 11 THEN 'NA' ELSE CAST(60 + n_nationkey AS VARCHAR) END AS asthma_rate,
               CAST(120 + 3 * n_nationkey AS VARCHAR) AS ihd_rate,
               CAST(30 + n_nationkey AS VARCHAR) AS copd_rate
        FROM nation, (SELECT unnest(range(1995, 2002)) AS year) y""",
    "some_rate": "SELECT * FROM rate WHERE county_fips <> '00007'",
    "risk": f"SELECT * FROM (VALUES {_rows(B.RISKS)}) t(pollutant, endpoint, RR)",
    "unit_cost": f"SELECT * FROM (VALUES {_rows(B.COSTS)}) t(endpoint, unit)",
    "conc_c": f"""
        SELECT t.*, pollutant, condition, Final_Conc FROM (
            SELECT o_custkey, {POLLUTANT} AS pollutant, {IDLE_CONDITION} AS condition, avg({LEVEL}) AS Final_Conc
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) JOIN tract t ON c_custkey = o_custkey""",
    "conc_y": f"""
        SELECT t.*, pollutant, year, Final_Conc FROM (
            SELECT o_custkey, {POLLUTANT} AS pollutant, year(l_shipdate) AS year, avg({LEVEL}) AS Final_Conc
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) JOIN tract t ON c_custkey = o_custkey""",
    "release_of": """
        SELECT c.GEOID, c.year, max(r.released) AS vintage FROM (SELECT DISTINCT GEOID, year FROM conc_y) c
        JOIN release r ON r.GEOID = c.GEOID AND r.released <= c.year GROUP BY ALL""",
    "long_c": f"""
        SELECT c.*, p.total_pop, p.white, p.black, p.asian, p.hispanic, p.median_income,
               unnest([{', '.join(f"struct_pack(endpoint := {_text(e)}, rate := r.{c})" for c, e in PAIRS)}],
                      recursive := true)
        FROM conc_c c LEFT JOIN people p ON p.GEOID = c.GEOID AND p.year = 2000
        JOIN rate r ON r.county_fips = c.county_fips AND r.year = (SELECT max(year) FROM rate)""",
    "long_y": f"""
        SELECT c.*, p.total_pop, p.white, p.black, p.asian, p.hispanic, p.median_income,
               unnest([{', '.join(f"struct_pack(endpoint := {_text(e)}, rate := r.{c})" for c, e in PAIRS)}],
                      recursive := true)
        FROM conc_y c LEFT JOIN people p ON p.GEOID = c.GEOID AND p.year = c.year
        LEFT JOIN rate r ON r.county_fips = c.county_fips AND r.year = c.year""",
    "case_c": """
        SELECT l.*, RR, ln(RR) AS beta, TRY_CAST(rate AS DOUBLE) / 100000 AS baseline_rate,
               TRY_CAST(rate AS DOUBLE) / 100000 * total_pop * (1 - exp(-ln(RR) * Final_Conc)) AS additional_cases
        FROM long_c l LEFT JOIN risk USING (pollutant, endpoint)""",
    "case_y": """
        SELECT l.*, RR, ln(RR) AS beta, TRY_CAST(rate AS DOUBLE) / 100000 AS baseline_rate,
               TRY_CAST(rate AS DOUBLE) / 100000 * total_pop * (1 - exp(-ln(RR) * Final_Conc)) AS additional_cases
        FROM long_y l LEFT JOIN risk USING (pollutant, endpoint)""",
    "sum_c": """
        SELECT pollutant, endpoint, condition, sum(additional_cases) AS cases FROM case_c
        GROUP BY ALL HAVING sum(additional_cases) > 0""",
    "sum_y": """
        SELECT pollutant, endpoint, year, sum(additional_cases) AS cases FROM case_y
        GROUP BY ALL HAVING sum(additional_cases) > 0""",
    "priced_c": "SELECT s.*, unit, cases * unit AS cost FROM sum_c s LEFT JOIN unit_cost USING (endpoint)",
    "priced_y": "SELECT s.*, unit, cases * unit AS cost FROM sum_y s LEFT JOIN unit_cost USING (endpoint)",
    "tract_cost": """
        SELECT c.*, unit, additional_cases * unit AS cost FROM case_c c LEFT JOIN unit_cost USING (endpoint)""",
    "tract_cost_y": """
        SELECT c.*, unit, additional_cases * unit AS cost FROM case_y c LEFT JOIN unit_cost USING (endpoint)""",
    "county_cost": """
        SELECT county_fips AS GEOID, coalesce(sum(cost), 0) AS total FROM tract_cost
        WHERE condition = 'Typical Uncontrolled' GROUP BY ALL""",
    "saving": """
        SELECT GEOID, NAMELSADCO, """ + ", ".join(
        f"""CASE WHEN count(*) FILTER (WHERE condition = {_text(c)}) > 0
                 THEN coalesce(sum(cost) FILTER (WHERE condition = {_text(c)}), 0) END AS "economic_cost_{c}" """
        for c in B.CONDITIONS) + " FROM tract_cost GROUP BY ALL",
    "delta": """
        SELECT *, "economic_cost_Typical Uncontrolled" - "economic_cost_Typical Controlled" AS delta FROM saving""",
    "svi0": f"SELECT c_custkey, {GEOID} AS FIPS, {SVI_SQL} FROM customer",
    "svi": """
        SELECT * REPLACE (CASE WHEN c_custkey % 17 <> 0 THEN Pct_Unemployed END AS Pct_Unemployed)
        FROM svi0 WHERE c_custkey % 23 <> 0""",
    "mortality": """
        SELECT s.*, c.pollutant, c.condition, c.Final_Conc, c.total_pop,
               additional_cases + Pct_Below_150_Poverty * 0.001::DOUBLE + Pct_Minority * 0.0005::DOUBLE AS cases
        FROM case_c c JOIN svi s ON s.FIPS = c.GEOID
        WHERE endpoint = 'All-cause mortality' AND additional_cases IS NOT NULL""",
    "pooled": f"""
        SELECT FIPS, condition, sum(cases * 100000) AS outcome, {', '.join(f'avg({c}) AS {c}' for c in S.INDICATORS)},
               avg(Final_Conc) AS Final_Conc, avg(total_pop) AS total_pop
        FROM mortality GROUP BY FIPS, condition""",
    "fit_c": f"""
        SELECT pollutant, condition, v AS svi_variable, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
               regr_count(y, x) AS n, sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0)
                   / (regr_count(y, x) - 2) / regr_sxx(y, x)) AS se
        FROM (SELECT pollutant, condition, cases * 1000 AS y, unnest([
            {', '.join(f"struct_pack(v := '{c}', x := {c})" for c in S.INDICATORS)}], recursive := true)
            FROM mortality) GROUP BY ALL""",
    "theme_row": """
        SELECT s.*, c.pollutant, c.condition, c.Final_Conc,
               additional_cases * 0.0001::DOUBLE + SVI_SES * 0.0005::DOUBLE + SVI_HTT * 0.0003::DOUBLE AS cases
        FROM case_c c JOIN svi s ON s.FIPS = c.GEOID
        WHERE endpoint = 'All-cause mortality' AND additional_cases IS NOT NULL""",
    "fit_t": f"""
        SELECT pollutant, condition, v AS svi_variable, regr_slope(y, x) AS b, regr_count(y, x) AS n,
               sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0)
                   / (regr_count(y, x) - 2) / regr_sxx(y, x)) AS se
        FROM (SELECT pollutant, condition, cases * 1000 AS y, unnest([
            {', '.join(f"struct_pack(v := '{c}', x := {c})" for c in S.THEME_RANKS)}], recursive := true)
            FROM theme_row) GROUP BY ALL""",
    "fit_p": f"""
        SELECT condition, v AS svi_variable, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
               regr_count(y, x) AS n, sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0)
                   / (regr_count(y, x) - 2) / regr_sxx(y, x)) AS se
        FROM (SELECT condition, outcome AS y, unnest([
            {', '.join(f"struct_pack(v := '{c}', x := {c})" for c in S.INDICATORS)}], recursive := true)
            FROM pooled) GROUP BY ALL""",
    # two-sided 5 % point of Student t by its expansion around the normal quantile
    "selected": f"""
        SELECT pollutant, condition, svi_variable FROM (
            SELECT *, {NORMAL_975!r} AS z, n - 2 AS df FROM fit_c)
        WHERE abs(b / se) > z + (pow(z, 3) + z) / (4 * df)
            + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96.0::DOUBLE * df * df)""",
    "selected_t": f"""
        SELECT pollutant, condition, svi_variable FROM (
            SELECT *, {NORMAL_975!r} AS z, n - 2 AS df FROM fit_t)
        WHERE abs(b / se) > z + (pow(z, 3) + z) / (4 * df)
            + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96.0::DOUBLE * df * df)""",
    "selected_p": f"""
        SELECT condition, svi_variable FROM (SELECT *, {NORMAL_975!r} AS z, n - 2 AS df FROM fit_p)
        WHERE abs(b / se) > z + (pow(z, 3) + z) / (4 * df)
            + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96.0::DOUBLE * df * df)""",
    **_models("c", ["pollutant", "condition"], "mortality", "r.cases * 1000", ["Final_Conc"], """
        SELECT g.pollutant, g.condition, list(svi_variable) AS vars
        FROM (SELECT DISTINCT pollutant, condition FROM mortality) g LEFT JOIN selected s
            ON s.pollutant = g.pollutant AND s.condition = g.condition GROUP BY ALL"""),
    **_models("t", ["pollutant", "condition"], "theme_row", "r.cases * 1000", ["Final_Conc"], """
        SELECT g.pollutant, g.condition, list(svi_variable) AS vars
        FROM (SELECT DISTINCT pollutant, condition FROM theme_row) g LEFT JOIN selected_t s
            ON s.pollutant = g.pollutant AND s.condition = g.condition GROUP BY ALL""", S.THEME_RANKS),
    **_models("p", ["condition"], "pooled", "r.outcome", ["Final_Conc", "total_pop"],
              "SELECT condition, list(svi_variable) AS vars FROM selected_p GROUP BY ALL"),
    "event": """
        SELECT *, CASE WHEN user_id % 3 = 0 THEN 'SITE' ELSE 'Site' END || user_id % 10 || ' '
            || [{conditions}][user_id // 10 % 4 + 1] || ' ' || [{pollutants}][user_id // 40 % 4 + 1] AS run
        FROM events""".format(conditions=", ".join(map(_text, S.CONDITION_ORDER)),
                              pollutants=", ".join(map(_text, S.POLLUTANT_ORDER))),
    "manifest": """
        SELECT DISTINCT run || '_RUN.log' AS file_name, upper(split_part(run, ' ', 1)) AS facility,
               split_part(run, ' ', 2) || ' ' || split_part(run, ' ', 3) AS scenario,
               split_part(run, ' ', 4) AS pollutant FROM event""",
    "day": "SELECT DISTINCT run || '_RUN.log' AS file_name, dayofyear(ts) AS day FROM event",
    "run_line": """
        SELECT run || '_RUN.log' AS file_name, year(ts) AS y, dayofyear(ts) AS d, false AS c FROM event
        UNION ALL SELECT run || '_RUN.log', NULL, NULL, true FROM event WHERE event_type = 'signup'
        UNION ALL SELECT 'Full' || event_id // 366 || ' Typical Controlled PM_RUN.log', 2024, event_id % 366 + 1, false FROM events
        WHERE event_id // 366 % 3 <> 0 OR event_id % 366 <> 99
        UNION ALL SELECT 'Full' || event_id // 366 || ' Typical Controlled PM_RUN.log', NULL, NULL, true FROM events
        WHERE event_id // 366 % 2 = 0 AND event_id % 366 = 365""",
    "sector_item": """
        SELECT year(l_shipdate) + 19 AS year, l_suppkey // 4 AS site_no, l_partkey % 12 + 1 AS sector, month(l_shipdate) AS month,
               l_linenumber, CAST(l_quantity AS INTEGER) AS class FROM lineitem""",
    "month_cell": """
            SELECT k.site, k.year, k.sector, CAST(k.month AS INTEGER) AS month, CASE WHEN site_no % 2 = 0 THEN k.s % 1000 + CASE WHEN k.month = 1 THEN 4 ELSE 0 END
                   ELSE coalesce(m.s, 0) % 1000 END AS n
            FROM (SELECT 'S' || site_no AS site, site_no, year, sector, unnest(range(1, 13)) AS month, s
                  FROM (SELECT site_no, year, sector, sum(l_linenumber) AS s FROM sector_item GROUP BY ALL)) k
            LEFT JOIN (SELECT site_no, year, sector, month, sum(l_linenumber) AS s FROM sector_item GROUP BY ALL) m USING (site_no, year, sector, month)""",
    "site_value": """
        SELECT year, site_no, 'S' || site_no AS site, sector, count(*) % 100 / 100.0::DOUBLE AS albedo,
               CAST(sum(l_linenumber) AS BIGINT) % 1000 AS s,
               CAST(sum(l_linenumber) AS BIGINT) % 150 / 100.0::DOUBLE AS bowen,
               CAST(sum(l_linenumber) AS BIGINT) % 1000 / 1000.0::DOUBLE AS roughness
        FROM sector_item GROUP BY ALL""",
    "inventory": """
        SELECT CAST(l_suppkey AS VARCHAR) AS registry_id, [{names}][l_partkey % {count} + 1] AS pollutant_name,
               year(l_shipdate) + 24 AS year, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
        FROM lineitem GROUP BY ALL""".format(names=", ".join(map(_text, B.INVENTORY_NAMES)),
                                             count=len(B.INVENTORY_NAMES)),
    "pounds": "SELECT registry_id, pollutant_name, year, CAST(q AS DOUBLE) AS pounds FROM inventory WHERE q % 7 <> 0",
    "short": "SELECT * FROM (VALUES {}) t(pollutant_name, short_name)".format(
        _rows(list(S.CRITERIA_OF_INVENTORY.items()))),
    "criteria": """
        SELECT registry_id, short_name, year, pounds, pounds / 2000 AS tons FROM pounds JOIN short USING (pollutant_name)""",
}


def sql(body: str) -> str:
    """Body with the views it refers to, in the order in which they are defined."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    chosen = ",\n".join(f"{name} AS ({text.strip()})" for name, text in VIEWS.items() if name in needed)
    return f"WITH RECURSIVE {chosen}\n{body.strip()}" if chosen else body.strip()


def _case_columns(scenario: str) -> str:
    return f"""county_fips, GEOID, TRACTCE, NAMELSADCO, pollutant, {scenario}, round(Final_Conc, 8) AS Final_Conc,
        {', '.join(S.DEMOGRAPHICS)}, endpoint, rate, RR, round(beta, 10) + 0 AS beta,
        round(baseline_rate, 10) AS baseline_rate, round(additional_cases, 8) + 0 AS additional_cases"""


def _wide(view: str, scenario: str, values: list, quote) -> str:
    cells = [f"""round(max(cases) FILTER (WHERE {scenario} = {quote(v)}), 6) AS "total_additional_cases_{v}" """
             for v in values]
    cells += [f"""round(max(cost) FILTER (WHERE {scenario} = {quote(v)}) / 1e6, 6) AS "total_cost_{v}" """
              for v in values]
    return (f"SELECT endpoint, pollutant, {', '.join(cells)}, {_rank('pollutant', S.POLLUTANT_ORDER)} AS pollutant_rank "
            f"FROM {view} GROUP BY pollutant, endpoint")


def _fit(view: str, keys: str, digits: int) -> str:
    return f"""
        SELECT {keys}, svi_variable, round(b, {digits}) AS estimate, round(a, {digits}) AS intercept,
               round(se, {digits}) AS std_error, n - 2 AS df, n, round(b / se, {digits}) AS statistic,
               round(b - {NORMAL_975!r} * se, {digits}) AS conf_low, round(b + {NORMAL_975!r} * se, {digits}) AS conf_high
        FROM {view}"""


def _model(view: str, keys: str, digits: int) -> str:
    return f"""
        SELECT {keys}, term, round(b, {digits}) + 0 AS estimate, round(se, {digits}) AS std_error, df, n,
               round(b / se, {digits}) + 0 AS statistic, round(b - {NORMAL_975!r} * se, {digits}) + 0 AS conf_low,
               round(b + {NORMAL_975!r} * se, {digits}) + 0 AS conf_high,
               abs(round({_tail('(b / se)', 'df')}, 9)) AS p_value
        FROM {view}"""


def _short(value: str) -> str:
    """Three decimals without trailing zeros."""
    return f"regexp_replace(regexp_replace(printf('%.3f', round({value}, 3) + 0.0), '0+$', ''), '\\.$', '')"


def _result_cells() -> str:
    text = (f"{_short('b')} || ' (' || {_short('low')} || '–' || {_short('high')} || '), ' || bold || 'p = ' || "
            f"{_short('p')} || bold")
    return ", ".join(f'max({text}) FILTER (WHERE condition = {_text(c)}) AS "{c}"' for c in B.CONDITIONS)


def _formatted(keys: str, view: str, link: str) -> str:
    return f"""
        SELECT {keys}svi_variable, {_result_cells()} FROM (
            SELECT * EXCLUDE (b), {link}(b) AS b, CASE WHEN round(p, 3) < 0.05 THEN '**' ELSE '' END AS bold FROM (
                SELECT *, {link}(b - {NORMAL_975!r} * se) AS low, {link}(b + {NORMAL_975!r} * se) AS high,
                       {_tail('(b / se)', 'df')} AS p
                FROM (SELECT *, n - 2 AS df FROM {view})))
        GROUP BY {keys}svi_variable"""


RATES = ", ".join(S.ENDPOINT_OF_RATE)
PEOPLE = ", ".join(S.DEMOGRAPHICS)
TOTALS = """
    SELECT condition, pollutant, sum(cost) AS cost FROM priced_c GROUP BY ALL
    UNION ALL SELECT condition, 'Total', sum(cost) FROM priced_c GROUP BY ALL"""

BODIES: dict[str, str] = {
    "s4_scenario_keys": f"""
        SELECT DISTINCT file_name, year, year_pollutant, condition, condition_pollutant,
               regexp_replace(file_name, '\\.[a-z]+$', '') AS stem
        FROM (
            SELECT 'reformatted_Plant ' || year(l_shipdate) || ' ' || {POLLUTANT} || ' Annual.csv' AS file_name,
                   year(l_shipdate) AS year, {POLLUTANT} AS year_pollutant,
                   CAST(year(l_shipdate) AS VARCHAR) AS condition, {POLLUTANT} AS condition_pollutant FROM lineitem
            UNION ALL
            SELECT 'reformatted_Plant ' || {CONDITION} || ' ' || {POLLUTANT} || ' Annual.csv', NULL, NULL,
                   {CONDITION}, {POLLUTANT} FROM lineitem
            UNION ALL SELECT 'notes ' || {POLLUTANT} || '.txt', NULL, NULL, NULL, NULL FROM lineitem)""",
    "p1_drop_empty_columns": """
        SELECT file_name, 'X, Y, Concentration (AVERAGE CONC) [ug/m^3], file_name' AS kept_columns, count(*) AS "rows", min(X) AS min_x, max(Y) AS max_y FROM receptor GROUP BY file_name""",
    "p5_p6_wide_demographics": f"SELECT GEOID, NAME, {PEOPLE} FROM people WHERE year = 2000",
    "p11_sentinel_clean": f"SELECT FIPS, {', '.join(n for _, n in SVI_NAMES)} FROM svi",
    "w1_monitor_ids": """
        SELECT file_name, X, Y, 'M' || CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 3, '0')
            ELSE CAST(id AS VARCHAR) END AS monitor, conc FROM monitor""",
    "d1_monitor_table": """
        SELECT m.file_name, 'M' || CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 3, '0')
                   ELSE CAST(id AS VARCHAR) END AS "Monitor Name",
               n.place AS "Monitor Description", round(n.lat, 7) AS Latitude, round(n.lon, 7) AS Longitude,
               'D24HourMean' AS Metric, 'Annual' AS "Seasonal Metric", 'Mean' AS Statistic, m.conc AS "Values"
        FROM monitor m JOIN named n ON m.X = n.X AND m.Y = n.Y""",
    "g2_utm_to_lonlat": "SELECT X, Y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM lonlat",
    "g4_nearest_place": "SELECT X, Y, place FROM named",
    "j1_points_in_tracts": "SELECT pollutant, condition, GEOID, round(mean, 8) AS Avg_Conc FROM inside",
    "j1_point_matches": """
        SELECT pollutant, condition, x AS longitude, y AS latitude, conc AS Conc, GEOID FROM match""",
    "j1_outline_matches": """
        SELECT pollutant, condition, x AS longitude, y AS latitude, conc AS Conc, GEOID FROM outline_match""",
    "g6_outline_distance": """
        SELECT pollutant, condition, GEOID, round(best.d, 1) AS distance, best.x AS x, best.y AS y, best.conc AS Nearest_Conc FROM outline_near""",
    "g7_outline_concentration": """
        SELECT o.GEOID, TRACTCE, pollutant, condition, round(Final_Conc, 8) AS Final_Conc, Source
        FROM outline_assigned a JOIN outline o ON a.GEOID = o.GEOID
        UNION ALL SELECT GEOID, TRACTCE, NULL, NULL, NULL, NULL FROM outline WHERE k % 97 = 0""",
    "j2_nearest_receptor": """
        SELECT pollutant, condition, GEOID, best.d AS distance, best.x AS x, best.y AS y,
               best.conc AS Nearest_Conc FROM near""",
    "g7_assign_concentration": """
        SELECT t.GEOID, TRACTCE, NAME, NAMELSADCO, STATEFP, pollutant, condition,
               round(Final_Conc, 8) AS Final_Conc, Source FROM assigned a JOIN tract t ON a.GEOID = t.GEOID
        UNION ALL SELECT GEOID, TRACTCE, NAME, NAMELSADCO, STATEFP, NULL, NULL, NULL, NULL FROM tract WHERE x0 IS NULL""",
    "g7_map_variant": """
        SELECT t.GEOID, TRACTCE, NAME, STUSPS, NAMELSADCO, 5 AS vertices, pollutant,
               round(Final_Conc, 8) AS Final_Conc, Source FROM assigned a JOIN tract t ON a.GEOID = t.GEOID
        WHERE pollutant = 'PM' AND condition = 'Typical Controlled'
        UNION ALL SELECT GEOID, TRACTCE, NAME, STUSPS, NAMELSADCO, NULL, NULL, NULL, NULL FROM tract WHERE x0 IS NULL""",
    "r1_demographics_wide": f"SELECT GEOID, NAME, year, {PEOPLE} FROM people",
    "j4_conc_demographics": f"""
        SELECT c.GEOID, TRACTCE, c.NAME, NAMELSADCO, STATEFP, county_fips, pollutant, c.year,
               round(Final_Conc, 8) AS Final_Conc, {PEOPLE}
        FROM conc_y c LEFT JOIN some_people p ON p.GEOID = c.GEOID AND p.year = c.year""",
    "d3_vintages_as_of": f"""
        SELECT c.GEOID, TRACTCE, c.NAME, NAMELSADCO, STATEFP, county_fips, pollutant, c.year,
               round(Final_Conc, 8) AS Final_Conc, {PEOPLE}, o.vintage
        FROM conc_y c LEFT JOIN release_of o ON o.GEOID = c.GEOID AND o.year = c.year
        LEFT JOIN release r ON r.GEOID = c.GEOID AND r.released = o.vintage""",
    "d3_vintages_within_two_years": """
        SELECT c.GEOID, pollutant, c.year, r.released AS vintage, total_pop
        FROM conc_y c LEFT JOIN release_of o ON o.GEOID = c.GEOID AND o.year = c.year AND c.year - o.vintage <= 2
        LEFT JOIN release r ON r.GEOID = c.GEOID AND r.released = o.vintage""",
    "j4_unmatched_tracts": """
        SELECT c.year, count(*) AS unmatched_rows, count(DISTINCT c.GEOID) AS unmatched_tracts
        FROM conc_y c ANTI JOIN some_people p ON p.GEOID = c.GEOID AND p.year = c.year GROUP BY ALL""",
    "j5_conc_latest_demographics": f"""
        SELECT c.GEOID, TRACTCE, c.NAME, NAMELSADCO, STATEFP, county_fips, pollutant, condition,
               round(Final_Conc, 8) AS Final_Conc, {PEOPLE}
        FROM conc_c c LEFT JOIN people p ON p.GEOID = c.GEOID AND p.year = 2000""",
    "d2_county_of_tract": "SELECT substr(GEOID, 1, 5) AS county_fips, count(*) AS tracts FROM tract GROUP BY ALL",
    "j6_rates_left": f"""
        SELECT GEOID, pollutant, c.year, c.county_fips, round(Final_Conc, 8) AS Final_Conc, {RATES}
        FROM conc_y c LEFT JOIN some_rate r ON r.county_fips = c.county_fips AND r.year = c.year""",
    "j7_rates_latest_inner": f"""
        SELECT GEOID, pollutant, condition, c.county_fips, round(Final_Conc, 8) AS Final_Conc, {RATES}
        FROM conc_c c JOIN some_rate r ON r.county_fips = c.county_fips AND r.year = 2001""",
    "r2_unpivot_rates": "SELECT GEOID, pollutant, condition, endpoint, rate FROM long_c",
    "d8_tract_cases": f"SELECT {_case_columns('condition')} FROM case_c",
    "d8_tract_cases_by_year": f"SELECT {_case_columns('year')} FROM case_y",
    "d9_case_summary": """
        SELECT pollutant, endpoint, condition, round(cases, 6) AS total_additional_cases FROM sum_c""",
    "d9_case_summary_by_year": """
        SELECT pollutant, endpoint, year, round(cases, 6) AS total_additional_cases FROM sum_y""",
    "d10_cost_table": """
        SELECT pollutant, endpoint, condition, round(cases, 6) AS total_additional_cases, unit AS "Economic Cost",
               round(cost, 2) AS total_cost FROM priced_c""",
    "d10_cost_by_pollutant": """
        SELECT pollutant, condition, round(coalesce(sum(cost), 0), 2) AS total_cost FROM priced_c GROUP BY ALL""",
    "a4_cost_in_millions": f"""
        SELECT year, pollutant, round(coalesce(sum(cost), 0), 2) AS total_cost,
               round(coalesce(sum(cost), 0) / 1e6, 6) AS total_cost_million,
               {_rank('pollutant', S.LEGEND_ORDER)} AS pollutant_rank FROM priced_y GROUP BY year, pollutant""",
    "a9_subtotals": f"""
        SELECT condition, pollutant, round(coalesce(cost, 0), 2) AS total_cost,
               round(coalesce(cost, 0) / 1e6, 6) AS total_cost_million FROM ({TOTALS})""",
    "d16_control_ranges": f"""
        SELECT split_part(condition, ' ', 1) AS operations, split_part(condition, ' ', 2) AS controls, pollutant,
               round(coalesce(cost, 0), 2) AS total_cost, round(coalesce(cost, 0) / 1e6, 6) AS total_cost_million,
               {_rank('pollutant', S.RANGE_ORDER)} AS pollutant_rank,
               {_rank("split_part(condition, ' ', 2)", S.CONTROL_ORDER)} AS controls_rank,
               printf('%.2f', round(coalesce(cost, 0) / 1e6, 2)) AS label FROM ({TOTALS})""",
    "d17_endpoint_trend": f"""
        SELECT year, endpoint, round(sum(cases), 6) AS total_cases, {_rank('endpoint', S.TREND_ORDER)} AS endpoint_rank
        FROM priced_y GROUP BY year, endpoint""",
    "d18_damage_wide": _wide("priced_c", "condition", B.CONDITIONS, _text),
    "d18_damage_wide_by_year": _wide("priced_y", "year", B.YEARS, str),
    "r6_damage_display": "SELECT endpoint, pollutant, {}, {} AS pollutant_rank FROM priced_c GROUP BY pollutant, endpoint".format(
        ", ".join(
            f"""coalesce(printf('%.{d}f', round(max({m}) FILTER (WHERE condition = {_text(c)}), {d})), 'XX')
                AS "{name}_{c}" """
            for name, m, d in (("total_additional_cases", "cases", 3), ("total_cost", "cost / 1e6", 1))
            for c in B.CONDITIONS), _rank("pollutant", S.POLLUTANT_ORDER)),
    "d11_tract_cost": """
        SELECT GEOID, pollutant, condition, endpoint, round(additional_cases, 8) + 0 AS additional_cases,
               unit AS unit_cost, round(cost, 2) + 0 AS economic_cost FROM tract_cost""",
    "d14_county_damages": """
        SELECT c.GEOID, NAME, NAMELSAD, round(total, 2) AS total_economic_cost
        FROM county c LEFT JOIN county_cost t ON c.GEOID = t.GEOID""",
    "d14_county_damages_of_year": """
        SELECT c.GEOID, NAME, NAMELSAD, round(total, 2) AS total_economic_cost
        FROM county c LEFT JOIN (SELECT county_fips, coalesce(sum(cost), 0) AS total FROM tract_cost_y
                                 WHERE year = 2001 GROUP BY ALL) t ON c.GEOID = t.county_fips""",
    "d15_county_tracts": f"""
        SELECT c.GEOID, NAME, NAMELSADCO, round(total, 2) AS total_economic_cost
        FROM city_tract c LEFT JOIN (
            SELECT GEOID, coalesce(sum(cost), 0) AS total FROM tract_cost
            WHERE condition = 'Typical Uncontrolled' AND county_fips = '{B.CITY}' GROUP BY ALL) t ON c.GEOID = t.GEOID""",
    "d12_savings": "SELECT GEOID, NAMELSADCO, {}, round(delta, 2) + 0 AS delta_economic_cost FROM delta".format(
        ", ".join(f'round("economic_cost_{c}", 2) + 0 AS "economic_cost_{c}"' for c in B.CONDITIONS)),
    "d13_savings_map": """
        SELECT NAMELSAD, NAME, d.GEOID, round(delta, 2) + 0 AS delta_economic_cost
        FROM county c LEFT JOIN delta d ON NAMELSAD = NAMELSADCO""",
    "d13_county_savings": """
        SELECT GEOID, NAME, NAMELSAD, round(total, 2) + 0 AS delta_economic_cost
        FROM county LEFT JOIN (SELECT substr(GEOID, 1, 5) AS id, sum(delta) AS total FROM delta GROUP BY ALL) ON id = GEOID""",
    "d13_tract_savings": """
        SELECT c.GEOID, c.NAME, c.NAMELSADCO, round(delta, 2) + 0 AS delta_economic_cost
        FROM city_tract c JOIN delta d ON c.GEOID = d.GEOID""",
    "k_math4_plot_scales": """
        SELECT c.GEOID, CASE WHEN total IS NOT NULL THEN round(sqrt(least(greatest(total / 1e6, 0), 40)), 8) END AS county_colour,
               CASE WHEN total IS NOT NULL THEN round(sqrt(least(greatest(total / 1e6, 0), 1.3)), 8) END AS tract_colour,
               CASE WHEN total > 0 THEN round(log10(total / 1e6), 8) END AS log_millions
        FROM county c LEFT JOIN county_cost t ON c.GEOID = t.GEOID""",
    "d19_vulnerability": f"""
        SELECT s.FIPS, c.pollutant, c.condition, c.endpoint, round(additional_cases, 8) + 0 AS additional_cases,
               {', '.join(n for _, n in SVI_NAMES)} FROM case_c c JOIN svi s ON s.FIPS = c.GEOID""",
    "j15_svi_by_tract": """
        SELECT t.GEOID, NAME, NAMELSADCO, SVI FROM city_tract t LEFT JOIN (
            SELECT DISTINCT FIPS, s.SVI FROM case_c c JOIN svi s ON s.FIPS = c.GEOID) v ON v.FIPS = t.GEOID""",
    "d20_scaled_cases": "SELECT FIPS, pollutant, condition, round(cases * 1000, 6) AS scaled_cases FROM mortality",
    "a12_tract_condition": f"""
        SELECT FIPS, condition, round(outcome, 3) AS total_scaled_cases, round(Final_Conc, 8) AS Final_Conc,
               round(total_pop, 6) AS total_pop, {', '.join(f'round({c}, 6) AS {c}' for c in S.INDICATORS)} FROM pooled""",
    "t1_univariate": _fit("fit_c", "pollutant, condition", 6),
    "t1_p_values": f"""
        SELECT pollutant, condition, svi_variable, abs(round({_tail('(b / se)', 'df')}, 9)) AS p_value, df
        FROM (SELECT *, n - 2 AS df FROM fit_c)""",
    "t2_themes": f"""
        SELECT pollutant, condition, svi_variable, round(exp(b), 7) AS estimate,
               round(exp(b - {NORMAL_975!r} * se), 7) AS conf_low, round(exp(b + {NORMAL_975!r} * se), 7) AS conf_high,
               abs(round({_tail('(b / se)', 'df')}, 9)) AS p_value, df FROM (SELECT *, n - 2 AS df FROM fit_t)""",
    "t3_unstratified": _fit("fit_p", "condition", 4),
    "t5_selected": """
        SELECT pollutant, condition, string_agg(svi_variable, ' + ' ORDER BY svi_variable) AS svi_variables
        FROM selected_t GROUP BY pollutant, condition""",
    "t5_selected_indicators": """
        SELECT pollutant, condition, string_agg(svi_variable, ' + ' ORDER BY svi_variable) AS svi_variables
        FROM selected GROUP BY pollutant, condition""",
    "a14_selected_map": """
        SELECT pollutant, string_agg(condition || ': ' || names, '; ' ORDER BY condition) AS condition_lists
        FROM (SELECT pollutant, condition, string_agg(svi_variable, ' + ' ORDER BY svi_variable) AS names
              FROM selected_t GROUP BY pollutant, condition) GROUP BY pollutant""",
    "t6_multivariate": _model("model_t", "pollutant, condition", 6),
    "t6_multivariate_indicators": _model("model_c", "pollutant, condition", 6),
    "t7_multivariate": _model("model_p", "condition", 4),
    "t9_coefficient_plot": f"""
        SELECT condition, term, replace(regexp_replace(term, '^Pct_', ''), '_', ' ') AS clean_term, svi_theme,
               {_rank('svi_theme', [*S.SVI_THEMES, S.OTHER_THEME])} AS theme_rank, term_position,
               round(b, 4) + 0 AS estimate, round(b - {NORMAL_975!r} * se, 4) + 0 AS conf_low,
               round(b + {NORMAL_975!r} * se, 4) + 0 AS conf_high
        FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY b, term) AS term_position,
                     CASE {' '.join(f"WHEN term IN ({', '.join(map(_text, names))}) THEN {_text(theme)}"
                                    for theme, names in S.SVI_THEMES.items())} ELSE {_text(S.OTHER_THEME)} END AS svi_theme
              FROM model_p WHERE term NOT IN ('(Intercept)', 'Final_Conc', 'total_pop'))""",
    "t10_formatted": _formatted("pollutant, ", "fit_t", "exp"),
    "t10_formatted_indicators": _formatted("pollutant, ", "fit_c", ""),
    "t10_formatted_pooled": _formatted("", "fit_p", ""),
    "k_str6_number_text": """
        SELECT p_partkey, regexp_replace(regexp_replace(printf('%.3f', round(p_retailprice / 8, 3)), '0+$', ''), '\\.$', '')
               AS text, CASE WHEN p_partkey % 5 <> 0 THEN printf('%.2f', round(p_retailprice / 8, 2)) ELSE 'XX' END AS fixed
        FROM part""",
    "s5_incidence_file": f"""
        SELECT county_fips, year, {", ".join(f"NULLIF({c}, 'NA') AS {c}" for c in S.ENDPOINT_OF_RATE)} FROM rate""",
    "s6_demographics_file": f"SELECT GEOID, NAME, year, {PEOPLE} FROM people WHERE year = vintage",
    "s7_wide_demographics_file": f"SELECT GEOID, NAME, {PEOPLE} FROM people WHERE year = 2000",
    "s8_boundaries_file": """
        SELECT GEOID, STUSPS, x0 AS west, CASE WHEN x0 IS NOT NULL THEN y0 END AS south, CASE WHEN x0 IS NOT NULL THEN 5 END AS vertices, 2021 AS vintage
        FROM tract""",
    "s10_vulnerability_file": f"SELECT FIPS, {', '.join(n for _, n in SVI_NAMES)} FROM svi",
    "s12_monitor_files": """
        SELECT 'reformatted_' || r.file_name AS file_name, CAST(regexp_extract(r.file_name, '[0-9]{4}') AS INTEGER) AS year,
               split_part(r.file_name, ' ', 3) AS pollutant, round(lat, 7) AS latitude, round(lon, 7) AS longitude, conc AS "Conc"
        FROM receptor r JOIN lonlat n ON r.X = n.X AND r.Y = n.Y""",
    "s5_risk_file": f"""
        SELECT pollutant, endpoint, CASE WHEN s % 7 <> 0 THEN 1 + s % 40 / 1000.0::DOUBLE END AS "RR"
        FROM (SELECT {POLLUTANT} AS pollutant, {ENDPOINT} AS endpoint, CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY ALL)""",
    "s5_cost_file": f"""
        SELECT endpoint AS "Health Endpoint", CAST(sum(l_suppkey) AS BIGINT) % 1000000 / 4.0::DOUBLE AS "Economic Cost"
        FROM (SELECT {ENDPOINT} AS endpoint, l_suppkey FROM lineitem) GROUP BY endpoint""",
    "s9_county_file": """
        SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS GEOID, n_name AS NAME, 'County ' || n_nationkey AS NAMELSAD,
               lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS STATEFP, n_nationkey * 3::DOUBLE AS west,
               n_nationkey * 3 + CASE WHEN n_nationkey % 2 = 1 THEN 11 ELSE 1 END::DOUBLE AS east, n_nationkey % 2 + 1 AS parts, (n_nationkey % 2 + 1) * 5 AS vertices
        FROM nation""",
    "s11_partitioned_table": """
        SELECT pollutant, condition, CASE WHEN pollutant = 'PM' THEN -n ELSE n END AS readings
        FROM (SELECT pollutant, condition, count(conc) AS n FROM point GROUP BY ALL)""",
    "o1_display_order": f"""
        SELECT condition, pollutant, row_number() OVER (ORDER BY {_rank('condition', S.CONDITION_ORDER)} NULLS LAST,
               {_rank('pollutant', S.POLLUTANT_ORDER)} NULLS LAST) AS place FROM (SELECT DISTINCT condition, pollutant FROM priced_c)""",
    "s12_named_files": """
        SELECT 'reformatted_' || r.file_name AS file_name, round(lat, 7) AS latitude, round(lon, 7) AS longitude, conc AS "Conc"
        FROM receptor r JOIN lonlat n ON r.X = n.X AND r.Y = n.Y""",
    "s1_mixed_headings": "SELECT file_name, X, Y, conc, note AS NOTE, CAST(NULL AS VARCHAR) AS ZELEV FROM mixed",
    "p1_kept_columns_by_file": """
        SELECT file_name, CASE WHEN max(layout) < 2 THEN 'Concentration (AVERAGE CONC) [ug/m^3], ' ELSE '' END
            || CASE WHEN count(note) > 0 THEN 'NOTE, ' ELSE '' END || 'X, Y' AS kept_columns FROM mixed GROUP BY file_name""",
    "w1_file_order": """
        SELECT file_name, X, Y, conc, 'M' || CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 3, '0') ELSE CAST(id AS VARCHAR) END AS monitor
        FROM (SELECT m.*, f.at * 100 + row_number() OVER (PARTITION BY m.file_name ORDER BY k, n, X, Y, c0) AS id FROM mixed m
              JOIN (SELECT file_name, row_number() OVER (ORDER BY file_name) - 1 AS at FROM (SELECT DISTINCT file_name FROM mixed)) f USING (file_name))""",
    "s13_inventory_file": "SELECT registry_id, pollutant_name, year, pounds FROM pounds",
    "x1_inventory_long": """
        SELECT registry_id, pollutant_name, 'Pounds' AS unit_of_measure, year, pounds FROM pounds""",
    "x2_x3_criteria_tons": "SELECT registry_id, short_name, year, pounds, tons FROM criteria",
    "x3_particulate_total": """
        SELECT registry_id, year, sum(tons) AS pm_total_tons FROM criteria
        WHERE short_name IN ('PM2.5', 'PM10') GROUP BY registry_id, year""",
    "x4_run_manifest": "SELECT file_name, facility, scenario, pollutant FROM manifest",
    "x5_run_completeness": """
        SELECT *, coalesce(days = expected_days AND day_lines = expected_days AND first_day = 1
                           AND last_day = expected_days AND years = 1 AND closed, false) AS complete
        FROM (SELECT file_name, max(y) AS year, count(DISTINCT y) AS years, count(d) AS day_lines,
                     count(DISTINCT d) AS days, min(d) AS first_day, max(d) AS last_day, bool_or(c) AS closed,
                     dayofyear(make_date(max(y), 12, 31)) AS expected_days FROM run_line GROUP BY file_name)""",
    "x5_run_gaps": """
        SELECT file_name, gap_after, day AS gap_before, day - gap_after - 1 AS missing_days FROM (
            SELECT *, lag(day) OVER (PARTITION BY file_name ORDER BY day) AS gap_after FROM day)
        WHERE day - gap_after > 1""",
    "x6_coverage": """
        SELECT facility, scenario, pollutant FROM (SELECT DISTINCT facility, scenario FROM manifest),
            (VALUES ('PM'), ('NOx'), ('SO2'), ('CO')) p(pollutant)
        EXCEPT SELECT facility, scenario, pollutant FROM manifest""",
    "x7_site_characteristics": """
        SELECT site, year, sector, (sector - 1) * 30.0::DOUBLE AS start_dir, sector * 30.0::DOUBLE AS end_dir, albedo, bowen,
               roughness FROM site_value""",
    "x8_annual_roughness": """
        SELECT site, year, sector, round(mean, 6) AS monthly_mean, 12 AS months, roughness AS annual,
               abs(mean - roughness) <= 0.0005 + 1e-9 AS agrees
        FROM (SELECT v.*, CASE WHEN v.site_no % 2 = 0 THEN (12 * v.s + 4) / 12.0::DOUBLE / 1000 ELSE m.mean END AS mean
              FROM site_value v JOIN (
                  SELECT year, site_no, sector, sum(CAST(s AS BIGINT) % 1000 / 1000.0::DOUBLE) / 12 AS mean FROM (
                      SELECT year, site_no, sector, month, sum(l_linenumber) AS s FROM sector_item GROUP BY ALL) GROUP BY ALL) m
              USING (year, site_no, sector))""",
    "x8_sections": f"""
        SELECT '{P.MONTHLY_SECTION}' AS section, site, year, sector, month, n / 1000.0::DOUBLE AS roughness FROM month_cell
        UNION ALL SELECT '{P.FETCH_SECTION}', site, year, sector, month,
               (n // 1000 * 1000 + n % 10 * 100 + n // 10 % 10 * 10 + n // 100 % 10) / 1000.0::DOUBLE FROM month_cell""",
    "x9_cover_check": """
        SELECT site, year, sector, class_sum, class_sum + extra AS total, classes, extra = 0 AS agrees FROM (
            SELECT 'S' || site_no AS site, year, s.sector, count(*) FILTER (WHERE i.sector = s.sector) AS class_sum,
                   count(DISTINCT class) AS classes, CASE WHEN site_no % 5 = 0 AND s.sector = 1 THEN 1 ELSE 0 END AS extra
            FROM sector_item i, (SELECT unnest(range(1, 13)) AS sector) s GROUP BY site_no, year, s.sector)""",
    "x10_roughness_change": """
        SELECT site, year, sector, roughness, lag(year) OVER w AS previous_year,
               round(roughness - lag(roughness) OVER w, 6) + 0 AS change
        FROM site_value WINDOW w AS (PARTITION BY site_no, sector ORDER BY year)""",
    "x11_sector": """
        SELECT event_id, value AS direction, CAST(floor((value + 15) / 30) AS BIGINT) % 12 + 1 AS sector FROM events""",
    "x12_warnings": """
        SELECT (year(ts) - event_id % 3) || ' site.OUT' AS file_name, year(ts) - event_id % 3 AS year, 'CO' AS pathway,
               'W' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') AS code, event_id % 100 AS input_line,
               upper(event_type) AS module, 'Check input value ' || user_id % 7 AS message,
               CASE WHEN user_id % 2 = 0 THEN 'HINT' END AS hint
        FROM events WHERE event_type = 'error'""",
    "x13_flow_audit": """
        SELECT *, len(missing_flows) = 0 AND ended AS complete FROM (
            SELECT run || '_FLOW.log' AS file_name, count(DISTINCT event_id % 36) AS flow_count,
                   array_to_string(list_filter(range(10, 361, 10),
                       lambda f: NOT list_contains(list((event_id % 36 + 1) * 10), f)), ',') AS missing_flows,
                   bool_or(event_type = 'click' AND user_id % 2 = 0) AS grouped,
                   bool_or(event_type = 'purchase') AS ended
            FROM event GROUP BY run)""",
}


def all_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in BODIES.items()}
