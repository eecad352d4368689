"""SQL equivalents of the registered tracing queries, for an engine without any of ours.

They join without bins and cells, so they are the plain statement of each query.
"""

from __future__ import annotations

from hopwise.functions.category import PREFIXES
from hopwise.sources.fixture import CODES, EDGE_SITES, N_POIS, SEED_EVERY, SITE, SITES

R = 6378.13720703125
DUR, HOPS, EPS, RADIUS, TOL, MIN_PROB, SEED = 600, 5, 4.0, 0.12, 0.001, 0.05, 60


def hav(a: str, b: str, c: str, d: str) -> str:
    """Distance in km between (a, b) and (c, d): expressions of longitude and latitude."""
    h = f"pow(sin((radians({b}) - radians({d})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin((radians({a}) - radians({c})) / 2), 2)"
    return f"(CASE WHEN {a} = {c} AND {b} = {d} THEN 0.0::DOUBLE ELSE floor(2 * {R}::DOUBLE * asin(sqrt({h})) * 100000.0::DOUBLE + 0.5::DOUBLE) / 100000.0::DOUBLE END)"


def real(x: str) -> str:
    """A float32's value as a double."""
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def category(code: str) -> str:
    """The highest category that matches: the last one."""
    cases = " ".join(
        f"WHEN {' OR '.join(f'{code} = {p!r}' if len(p) == 4 else f'starts_with({code}, {p!r})' for p in PREFIXES[k])} THEN {k}" for k in sorted(PREFIXES, reverse=True)
    )
    return f"(CASE {cases} END)"


def uniform(*key: str) -> str:
    total = "17::BIGINT"
    for k in key:
        total = f"(({total} * 1000003 + {k}) % 2147483648)"
    for _ in range(2):
        total = f"(({total} * 1103515245 + 12345) % 2147483648)"
    return f"({total} / 2147483648.0::DOUBLE)"


ROUND = "round(CAST({} AS DOUBLE), 6)".format
CODE_LIST = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"



def origin(site: str) -> tuple[str, str]:
    return f"(CASE WHEN {site} < {SITES - EDGE_SITES} THEN 115.0::DOUBLE + 0.037::DOUBLE * {site} ELSE 118.9965::DOUBLE END)", f"(39.9::DOUBLE + 0.0113::DOUBLE * {site})"


SITE_LNG, SITE_LAT = origin(f"((p - 1) // {SITE})")
PLACE = f'{real(SITE_LNG + " + 0.001::DOUBLE * ((p - 1) % 5)")} AS lng, {real(SITE_LAT + f" + 0.001::DOUBLE * ((p - 1) % {SITE} // 5)")} AS lat FROM range(1, {N_POIS + 1}) t(p)'
GPS_LNG, GPS_LAT = origin(f"(user_id % {SITES})")

#: Places with their labels, stays, and trips; each WITH below begins with these.
BASE = f"""WITH raw_pois AS (
  SELECT p AS poi_id, {CODE_LIST}[(p % 17 + 1)::INT] AS code, {PLACE}
  UNION ALL SELECT p, {CODE_LIST}[((p + 7) % 17 + 1)::INT], {PLACE} WHERE p % 5 = 0
), labels AS (SELECT DISTINCT poi_id, code, {category("code")} AS category_id, lng, lat FROM raw_pois WHERE lng BETWEEN 114 AND 119 AND lat BETWEEN 38 AND 43),
pois AS (
  SELECT poi_id, any_value(lng) AS lng, any_value(lat) AS lat, CAST(floor((43.0::DOUBLE - any_value(lat)) / 0.01::DOUBLE) AS BIGINT) AS cell_row,
    CAST(floor((any_value(lng) - 114.0::DOUBLE) / 0.01::DOUBLE) AS BIGINT) AS cell_col, count(*) AS n_labels FROM labels GROUP BY poi_id
), events_at AS (
  SELECT user_id AS trip_id, (CAST(regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1) AS BIGINT) + 100 * CAST(floor(value) AS BIGINT)) % {N_POIS} + 1 AS point_id, CAST(floor(epoch(ts)) AS BIGINT) AS arrive_ts, ts, event_id
  FROM events
), visits AS (
  SELECT *, least(coalesce(lead(arrive_ts) OVER (PARTITION BY trip_id ORDER BY ts, event_id), arrive_ts + 600), arrive_ts + 7200) AS leave_ts FROM events_at
), changes AS (
  SELECT *, CASE WHEN lag(point_id) OVER w = point_id THEN 0 ELSE 1 END AS c FROM visits WHERE leave_ts > arrive_ts WINDOW w AS (PARTITION BY trip_id ORDER BY arrive_ts, event_id)
), islands AS (SELECT *, sum(c) OVER (PARTITION BY trip_id ORDER BY arrive_ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS seq FROM changes),
stays AS (
  SELECT trip_id, CAST(seq AS INT) AS seq, point_id, any_value(lng) AS lng, any_value(lat) AS lat, min(arrive_ts) AS arrive_ts, max(leave_ts) AS leave_ts, 0.0::DOUBLE AS radius
  FROM islands JOIN pois ON poi_id = point_id GROUP BY trip_id, seq, point_id
), trips AS (
  SELECT trip_id, min(arrive_ts) AS t_start, max(leave_ts) AS t_end, count(*) AS n_stays, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat
  FROM stays GROUP BY trip_id
), seeds AS (SELECT trip_id FROM trips WHERE trip_id % {SEED_EVERY} = 0),
gps AS (
  SELECT user_id AS trip_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, {real(GPS_LNG + " + 0.0001::DOUBLE * (floor(value) % 30) + CASE WHEN user_id % 5 = 0 THEN -0.016::DOUBLE ELSE 0.0::DOUBLE END")} AS lng,
    {real(GPS_LAT + " + 0.0001::DOUBLE * (floor(value * 10) % 20)")} AS lat, event_id
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL
), points AS (
  SELECT row_number() OVER (ORDER BY f, lng, lat) AS point_id, lng, lat FROM (SELECT lng, lat, min(event_id) AS f FROM gps GROUP BY lng, lat)
), q AS (SELECT * FROM stays WHERE trip_id NOT IN (SELECT trip_id FROM seeds)),
p AS (SELECT s.*, t.t_start AS vs, t.t_end AS ve FROM stays s JOIN seeds USING (trip_id) JOIN trips t USING (trip_id)),
hist AS (
  SELECT poi_id, list(share ORDER BY k) AS h FROM (
    SELECT p.poi_id, k, (SELECT count(*) FROM labels l WHERE l.poi_id = p.poi_id AND l.category_id = k) / p.n_labels::DOUBLE AS share FROM pois p CROSS JOIN range(17) c(k)
  ) GROUP BY poi_id
)
"""


def near(points: str, key: str, k: int, max_km: float, rings: int) -> str:
    """key, rank, poi_id, dist: nearest places in rings of cells."""
    return f"""SELECT * FROM (SELECT {key}, poi_id, dist, row_number() OVER (PARTITION BY {key} ORDER BY dist, poi_id) AS rank FROM (
      SELECT x.{key}, o.poi_id, {hav("x.lng", "x.lat", "o.lng", "o.lat")} AS dist FROM {points} x JOIN pois o ON
        abs(o.cell_row - CAST(floor((43.0::DOUBLE - x.lat) / 0.01::DOUBLE) AS BIGINT)) < {rings} AND abs(o.cell_col - CAST(floor((x.lng - 114.0::DOUBLE) / 0.01::DOUBLE) AS BIGINT)) < {rings}
    ) WHERE dist <= {max_km}) WHERE rank <= {k}"""


def dists(weight: str = "1.0::DOUBLE") -> str:
    """dists: point_id, category_id, share; dlist: the shares as a list; around: the places near each place."""
    return f""", around AS ({near("(SELECT poi_id AS point_id, lng, lat FROM pois)", "point_id", 17, 2.0, 2)}),
weighted AS (SELECT a.point_id, a.poi_id, {weight} / n_labels AS w FROM around a JOIN pois USING (poi_id)),
summed AS (SELECT point_id, category_id, sum(w) AS s FROM weighted JOIN labels USING (poi_id) GROUP BY point_id, category_id),
totals AS (SELECT point_id, sum(s) AS t FROM summed GROUP BY point_id),
dists AS (
  SELECT t.point_id, k AS category_id, coalesce((SELECT s FROM summed s2 WHERE s2.point_id = t.point_id AND s2.category_id = k), 0.0::DOUBLE) / t AS share FROM totals t CROSS JOIN range(17) c(k)
), dlist AS (SELECT point_id, list(share ORDER BY category_id) AS d FROM dists GROUP BY point_id)
"""


def jaccard(a: str, b: str) -> str:
    low, high = f"list_sum([least({a}[z], {b}[z]) FOR z IN range(1, 18)])", f"list_sum([greatest({a}[z], {b}[z]) FOR z IN range(1, 18)])"
    return f"coalesce({low} / nullif({high}, 0), 0)"


def pair_ctes(n: str, q: str, p: str, condition: str, dist: str = "0.0::DOUBLE", more: str = "") -> str:
    """pairs_n, runs_n: pairs of stays of q and p (with vs and ve), and their runs."""
    return f""", pairs_{n} AS (
  SELECT q.trip_id AS q_trip, p.trip_id AS p_trip, q.seq AS i, p.seq AS j, q.leave_ts AS ql, p.leave_ts AS pl, greatest(q.arrive_ts, p.arrive_ts, p.vs) AS start_ts,
    least(q.leave_ts, p.leave_ts, p.ve) AS end_ts, p.vs, p.ve, q.radius AS q_radius, p.radius AS p_radius, {dist} AS dist{more}
  FROM {q} q JOIN {p} p ON q.trip_id <> p.trip_id AND p.leave_ts > p.vs AND p.arrive_ts < p.ve AND q.arrive_ts < least(p.leave_ts, p.ve) AND greatest(p.arrive_ts, p.vs) < q.leave_ts AND {condition}
), marked_{n} AS (
  SELECT *, CASE WHEN (i = lag(i) OVER w + 1 AND j = lag(j) OVER w) OR (i = lag(i) OVER w AND j = lag(j) OVER w + 1)
      OR (i = lag(i) OVER w + 1 AND j = lag(j) OVER w + 1 AND lag(ql) OVER w = lag(pl) OVER w) THEN 0 ELSE 1 END AS fresh
  FROM pairs_{n} WINDOW w AS (PARTITION BY q_trip, p_trip ORDER BY i, j)
), numbered_{n} AS (SELECT *, sum(fresh) OVER (PARTITION BY q_trip, p_trip ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS run FROM marked_{n}),
runs_{n} AS (
  SELECT *, sum(end_ts - start_ts) OVER w AS cum, min(start_ts) OVER w AS run_start FROM numbered_{n}
  WINDOW w AS (PARTITION BY q_trip, p_trip, run ORDER BY i, j ROWS UNBOUNDED PRECEDING)
)"""


def contact_ctes(n: str, hop: int) -> str:
    """new_n: one contact per susceptible from runs_n."""
    return f""", firsts_{n} AS (
  SELECT q_trip, p_trip, min(run_start) AS cst, any_value(vs) AS vs, any_value(ve) AS ve FROM runs_{n} WHERE cum >= {DUR} GROUP BY q_trip, p_trip
), new_{n} AS (
  SELECT q_trip AS susceptible_id, p_trip AS spreader_id, cst, {hop} AS hop FROM (
    SELECT *, row_number() OVER (PARTITION BY q_trip ORDER BY cst, vs, ve, p_trip) AS rn FROM firsts_{n}) WHERE rn = 1
)"""


def trace(stays: str = "stays", seed_stays: str = "p", condition: str = "q.point_id = p.point_id", tag: str = "h", hops: int = HOPS) -> str:
    """CTEs up to all_<tag>: the contacts of every hop."""
    out = f", {tag}_ranges AS (SELECT trip_id, max(leave_ts) AS t_end FROM {stays} GROUP BY trip_id), {tag}_pool1 AS (SELECT * FROM {stays} WHERE trip_id NOT IN (SELECT trip_id FROM seeds))"
    spreading = seed_stays
    for k in range(1, hops + 1):
        n = f"{tag}{k}"
        out += pair_ctes(n, f"{tag}_pool{k}", spreading, condition) + contact_ctes(n, k)
        out += f""", {tag}_pool{k + 1} AS (SELECT * FROM {tag}_pool{k} WHERE trip_id NOT IN (SELECT susceptible_id FROM new_{n})),
{tag}_front{k + 1} AS (SELECT s.*, c.cst AS vs, r.t_end AS ve FROM {stays} s JOIN new_{n} c ON c.susceptible_id = s.trip_id JOIN {tag}_ranges r ON r.trip_id = s.trip_id)"""
        spreading = f"{tag}_front{k + 1}"
    union = " UNION ALL ".join(f"SELECT * FROM new_{tag}{k}" for k in range(1, hops + 1))
    return out + f", all_{tag} AS ({union})"


def box_of(side: str) -> dict[str, str]:
    return {k: f"{side}.{k}" for k in ("min_lng", "min_lat", "max_lng", "max_lat")}


A, B = box_of("a"), box_of("b")
NEXT = "FROM trips a JOIN trips b ON b.trip_id = a.trip_id + 1"


def contains(x: dict, y: dict) -> str:
    return f"({y['min_lng']} >= {x['min_lng']} AND {y['max_lng']} <= {x['max_lng']} AND {y['min_lat']} >= {x['min_lat']} AND {y['max_lat']} <= {x['max_lat']})"


def intersects(x: dict, y: dict) -> str:
    return f"({x['min_lng']} < {y['max_lng']} AND {y['min_lng']} < {x['max_lng']} AND {x['min_lat']} < {y['max_lat']} AND {y['min_lat']} < {x['max_lat']})"


def circle(lng: str, lat: str, r: str) -> dict[str, str]:
    e = f"(CASE WHEN {r} > 0 THEN degrees({r} / ({R}::DOUBLE * cos(radians({lat})))) ELSE 0 END)"
    n = f"(CASE WHEN {r} > 0 THEN degrees({r} / {R}::DOUBLE) ELSE 0 END)"
    return {"min_lng": f"({lng} - {e})", "min_lat": f"({lat} - {n})", "max_lng": f"({lng} + {e})", "max_lat": f"({lat} + {n})"}


def perimeter(x: dict) -> str:
    w, s, e, n = x["min_lng"], x["min_lat"], x["max_lng"], x["max_lat"]
    return f"({hav(w, s, w, n)} + {hav(w, n, e, n)} + {hav(e, s, e, n)} + {hav(w, s, e, s)})"


def union_box(x: dict, y: dict) -> dict[str, str]:
    return {k: f"{'least' if k.startswith('min') else 'greatest'}({x[k]}, {y[k]})" for k in x}


def box_distance(x: dict, y: dict) -> str:
    """0 if they meet; else the least distance between the facing edges' ends, by sector."""
    sectors = []
    for side, xl, yl in (("left", "min_lng", "max_lng"), ("right", "max_lng", "min_lng")):
        beside = f"{y['max_lng']} < {x['min_lng']}" if side == "left" else f"{y['min_lng']} > {x['max_lng']}"
        for height, xa, ya in (("below", "min_lat", "max_lat"), ("above", "max_lat", "min_lat")):
            over = f"{y['max_lat']} < {x['min_lat']}" if height == "below" else f"{y['min_lat']} > {x['max_lat']}"
            sectors.append(f"WHEN {beside} AND {over} THEN {hav(x[xl], x[xa], y[yl], y[ya])}")
    low, high = f"greatest({x['min_lat']}, {y['min_lat']})", f"least({x['max_lat']}, {y['max_lat']})"
    for xl, yl, beside in (("min_lng", "max_lng", f"{y['max_lng']} < {x['min_lng']}"), ("max_lng", "min_lng", f"{y['min_lng']} > {x['max_lng']}")):
        sectors.append(f"WHEN {beside} THEN least({hav(x[xl], low, y[yl], low)}, {hav(x[xl], high, y[yl], high)})")
    low, high = f"greatest({x['min_lng']}, {y['min_lng']})", f"least({x['max_lng']}, {y['max_lng']})"
    for xa, ya, over in (("min_lat", "max_lat", f"{y['max_lat']} < {x['min_lat']}"), ("max_lat", "min_lat", f"{y['min_lat']} > {x['max_lat']}")):
        sectors.append(f"WHEN {over} THEN least({hav(low, x[xa], low, y[ya])}, {hav(high, x[xa], high, y[ya])})")
    return f"(CASE {' '.join(sectors)} ELSE 0.0 END)"


def lambert_ctes(source: str, u: str, tag: str = "w") -> str:
    """tag: source's columns and wv, Lambert's lower branch at (u - 1) / e, by ten Halley steps."""
    x = f"(({u}) - 1) * exp(-1.0::DOUBLE)"
    out = f""", {tag}_x AS (SELECT *, {x} AS lx FROM {source}),
{tag}0 AS (SELECT *, CASE WHEN lx < -0.25 THEN -1 - sqrt(greatest(0.0::DOUBLE, 2 * (1 + {2.718281828459045!r}::DOUBLE * lx))) - greatest(0.0::DOUBLE, 2 * (1 + {2.718281828459045!r}::DOUBLE * lx)) / 3
    ELSE ln(-lx) - ln(-ln(-lx)) END AS wv FROM {tag}_x)"""
    for k in range(10):
        f = "(wv * exp(wv) - lx)"
        slope = f"(exp(wv) * (wv + 1) - (wv + 2) * {f} / (2 * wv + 2))"
        out += f", {tag}{k + 1} AS (SELECT * REPLACE (CASE WHEN abs(wv + 1) < 1e-9 OR {slope} = 0 THEN wv ELSE wv - {f} / {slope} END AS wv) FROM {tag}{k})"
    return out + f", {tag} AS (SELECT * FROM {tag}10)"


def geo_ctes(source: str = "q", compat: bool = False) -> str:
    """noisy: source's stays with nlng, nlat, nr; geo_stays: the noisy trips' stays."""
    angle = f"(360 * {uniform(str(SEED), 'trip_id', 'seq', '1')})"
    theta = angle if compat else f"radians({angle})"
    east, north = f"degrees(cos({theta}) * nr / ({R}::DOUBLE * cos(radians(lat))))", f"degrees(sin({theta}) * nr / {R}::DOUBLE)"
    if compat:
        east = f"(CASE WHEN {angle} <= 90 OR {angle} > 270 THEN 1 ELSE -1 END * {east})"
        north = f"(CASE WHEN {angle} <= 180 THEN 1 ELSE -1 END * {north})"
    return lambert_ctes(source, uniform(str(SEED), "trip_id", "seq", "2")) + f""", noisy0 AS (SELECT *, -(wv + 1) / {EPS}::DOUBLE AS nr FROM w),
noisy AS (SELECT *, lng + {east} AS nlng, lat + {north} AS nlat FROM noisy0)""" + noisy_stays("noisy", "geo_stays")


def noisy_stays(source: str, name: str) -> str:
    return f""", {name}_m AS (SELECT *, CASE WHEN lag(nlng) OVER w = nlng AND lag(nlat) OVER w = nlat THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY trip_id ORDER BY seq)),
{name}_i AS (SELECT *, sum(fresh) OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS isl FROM {name}_m),
{name} AS (SELECT trip_id, CAST(isl AS INT) AS seq, any_value(nlng) AS lng, any_value(nlat) AS lat, min(arrive_ts) AS arrive_ts, max(leave_ts) AS leave_ts, arg_min(nr, seq) AS radius,
  arg_min(point_id, seq) AS orig_point_id FROM {name}_i GROUP BY trip_id, isl)"""


def semantic_ctes() -> str:
    top = f"(exp({EPS / 2}::DOUBLE) - 1)"
    weight = f"exp({EPS}::DOUBLE * (1 - {jaccard('h', 'd')}) / 2)"
    place = uniform(str(SEED), "q.trip_id", "q.seq", "4", "v.class_no")
    return dists() + f""", labelled AS (SELECT poi_id, string_agg(category_id::VARCHAR, ',' ORDER BY category_id) AS labels FROM labels GROUP BY poi_id),
classes AS (SELECT labels, count(*) AS members, min(poi_id) AS one, row_number() OVER (ORDER BY labels) AS class_no FROM labelled GROUP BY labels),
members AS (SELECT *, row_number() OVER (PARTITION BY labels ORDER BY poi_id) - 1 AS nth FROM labelled),
turns AS (SELECT d.point_id, c.class_no, arg_min(d.category_id, (d.share, d.category_id)) AS category_id, min(d.share) AS share
  FROM dists d JOIN labels l USING (category_id) JOIN classes c ON c.one = l.poi_id GROUP BY d.point_id, c.class_no),
class_visits AS (SELECT t.*, c.labels, c.members, round(({weight} - 1) / {top}, 9) AS bar FROM turns t JOIN classes c USING (class_no) JOIN hist ON hist.poi_id = c.one JOIN dlist USING (point_id)),
tries AS (SELECT q.trip_id, q.seq, v.share, v.category_id, v.class_no, v.labels, v.members, CASE WHEN v.bar <= 0 THEN 0 ELSE floor(ln(1 - {place}) / ln(v.bar)) END AS nth
  FROM q JOIN class_visits v USING (point_id) WHERE v.bar < 1),
firsts AS (SELECT trip_id, seq, labels, nth::BIGINT AS nth, row_number() OVER (PARTITION BY trip_id, seq ORDER BY share, category_id, class_no) AS n FROM tries WHERE nth < members),
every AS (SELECT poi_id, row_number() OVER (ORDER BY poi_id) AS number FROM pois),
chosen AS (SELECT q.*, coalesce(m.poi_id, e.poi_id) AS poi_id FROM q LEFT JOIN firsts f ON f.trip_id = q.trip_id AND f.seq = q.seq AND f.n = 1
  LEFT JOIN members m ON m.labels = f.labels AND m.nth = f.nth
  LEFT JOIN every e ON e.number = CAST(floor({uniform(str(SEED), 'q.trip_id', 'q.seq', '5')} * (SELECT count(*) FROM pois)) AS BIGINT) + 1),
semantic AS (SELECT c.*, o.lng AS nlng, o.lat AS nlat, {hav('c.lng', 'c.lat', 'o.lng', 'o.lat')} AS nr FROM chosen c JOIN pois o USING (poi_id))""" + noisy_stays("semantic", "semantic_stays")


def geosemantic_ctes() -> str:
    weight = f"round(exp({EPS}::DOUBLE * (1 - {jaccard('h', 'd')}) / 2), 9)"
    far = hav("n.nlng", "n.nlat", "o.lng", "o.lat")
    return geo_ctes() + dists() + f""", cand0 AS (
  SELECT n.trip_id, n.seq, n.nr, n.point_id, o.poi_id, {far} AS dist FROM noisy n JOIN pois o ON {far} <= n.nr * 7
), cand1 AS (SELECT *, greatest(0, CAST(ceil((dist / nr - 1) * 2 - 1e-12) AS INT)) AS step FROM cand0),
cand2 AS (SELECT * FROM (SELECT *, min(step) OVER (PARTITION BY trip_id, seq) AS least_step FROM cand1) WHERE step = least_step),
cand AS (SELECT c.*, {weight} AS weight FROM cand2 c JOIN hist USING (poi_id) JOIN dlist USING (point_id)),
cum AS (SELECT *, sum(weight) OVER (PARTITION BY trip_id, seq ORDER BY weight, poi_id ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY trip_id, seq) AS total FROM cand),
pick AS (SELECT trip_id, seq, arg_min(poi_id, (weight, poi_id)) AS poi_id FROM cum WHERE {uniform(str(SEED), 'trip_id', 'seq', '3')} * total < upto GROUP BY trip_id, seq),
gs0 AS (SELECT n.*, k.poi_id, o.lng AS plng, o.lat AS plat FROM noisy n LEFT JOIN pick k ON k.trip_id = n.trip_id AND k.seq = n.seq LEFT JOIN pois o ON o.poi_id = k.poi_id),
gs AS (SELECT * REPLACE (coalesce(plng, nlng) AS nlng, coalesce(plat, nlat) AS nlat,
  CASE WHEN poi_id IS NULL THEN nr ELSE greatest({hav('nlng', 'nlat', 'plng', 'plat')}, {hav('lng', 'lat', 'plng', 'plat')}) END AS nr) FROM gs0)""" + noisy_stays("gs", "gs_stays")


def probability(dist: str, radius: str, delta: str) -> str:
    """By 1000 steps over z = 0 .. 999."""
    density = f"exp(-({{r}})) / (1 - exp(-{radius}))"
    arc = f"(CASE WHEN abs((({{r}}) * ({{r}}) + {dist} * {dist} - {delta} * {delta}) / nullif(2 * ({{r}}) * {dist}, 0)) <= 1 THEN acos((({{r}}) * ({{r}}) + {dist} * {dist} - {delta} * {delta}) / nullif(2 * ({{r}}) * {dist}, 0)) / pi() ELSE 0.001 END)"
    rim = f"least({radius}, {dist} + {delta})"

    def integral(left: str, right: str, term: str) -> str:
        r = f"({left}) + z * ((({right}) - ({left})) / 1000)"
        return f"list_sum([({term.format(r=r)}) * ((({right}) - ({left})) / 1000) FOR z IN range(1000)])"

    partial = f"{density} * {arc}"
    return f"""least(1.0::DOUBLE, CASE WHEN {radius} <= 0 THEN 0 WHEN {dist} >= {delta} + {radius} THEN 0 WHEN {delta} >= {radius} AND {dist} <= {delta} - {radius} THEN 1
      WHEN {dist} >= {delta} THEN {integral(f'{dist} - {delta}', rim, partial)} ELSE {integral('0.0::DOUBLE', f'{delta} - {dist}', density)} + {integral(f'{delta} - {dist}', rim, partial)} END)"""


def private_ctes() -> str:
    """runs_x with prob (so far) for noisy susceptible stays and exact seeds."""
    far = hav("q.lng", "q.lat", "p.lng", "p.lat")
    return geo_ctes() + pair_ctes("x", "geo_stays", "p", f"{far} <= {RADIUS} + {TOL} + q.radius + p.radius", far) + f""",
probs AS (SELECT *, {probability('dist', 'q_radius', f'(p_radius + {RADIUS})')} AS prob FROM runs_x),
sofar AS (SELECT *, max(prob) OVER (PARTITION BY q_trip, p_trip, run ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS run_prob FROM probs),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_trip, p_trip ORDER BY run_start, run, i, j) AS rn FROM sofar WHERE cum >= {DUR}) WHERE rn = 1),
joint AS (SELECT q_trip AS susceptible_id, arg_min(p_trip, (run_start, -run_prob, vs, ve, p_trip)) AS spreader_id, min(run_start) AS cst, 1 - product(1 - run_prob) AS probability, max(run_prob) AS most FROM hits GROUP BY q_trip)"""


def angle(v1: str, v2: str, opposite: str) -> str:
    """Degrees between two sides of a triangle; null where there is none."""
    cosine = f"(({v1} * {v1} + {v2} * {v2} - {opposite} * {opposite}) / nullif(2 * {v1} * {v2}, 0))"
    return f"(CASE WHEN abs({cosine}) <= 1 THEN degrees(acos({cosine})) END)"


def fold(a: str) -> str:
    return f"(CASE WHEN {a} <= 180 THEN {a} ELSE 180 - {a} END)"


def correlated_ctes(name: str, source: str, keys: str, series: bool) -> str:
    """name: keys, tied, from source's keys, dist, pp, qp (distances to the stay before), radius, delta.

    1000 radii; the 1000 angles at each are added up one by one, or (series) as the geometric series on both sides of 0.
    """
    density = "exp(-r) / (1 - exp(-radius))"
    out = f""", {name}_s AS (SELECT *, least(abs(dist - delta), least(radius, dist + delta)) AS lo, greatest(abs(dist - delta), least(radius, dist + delta)) AS hi,
  CASE WHEN dist < delta THEN list_sum([exp(-(k * ((delta - dist) / 1000))) / (1 - exp(-radius)) * ((delta - dist) / 1000) FOR k IN range(1000)]) ELSE 0 END AS whole,
  {angle("qp", "dist", "pp")} AS turn FROM {source}),
{name}_r AS (SELECT *, (hi - lo) / 1000 AS step, lo + z * ((hi - lo) / 1000) AS r FROM {name}_s CROSS JOIN range(1000) t(z) WHERE radius > 0 AND dist < delta + radius AND NOT (delta >= radius AND dist <= delta - radius)),
{name}_h AS (SELECT *, {angle("r", "dist", "delta")} AS half FROM {name}_r),
{name}_a AS (SELECT *, {fold("(turn - half)")} AS one, {fold("(turn + half)")} AS other FROM {name}_h),
{name}_w AS (SELECT *, least(one, other) AS low, (greatest(one, other) - least(one, other)) / 1000 AS width FROM {name}_a WHERE half IS NOT NULL AND turn IS NOT NULL),"""
    if series:
        some = "CASE WHEN width < 1e-12 THEN {n} ELSE (1 - exp(-width * {n})) / nullif(1 - exp(-width), 0) END"
        out += f"""
{name}_n AS (SELECT *, CASE WHEN width = 0 THEN 0 ELSE least(1000.0::DOUBLE, greatest(0.0::DOUBLE, ceil(-low / width))) END AS m FROM {name}_w),
{name}_m AS (SELECT *, (CASE WHEN m > 0 THEN exp(least(low + (m - 1) * width, 0)) * ({some.format(n="m")}) ELSE 0 END
  + CASE WHEN m < 1000 THEN exp(-greatest(low + m * width, 0)) * ({some.format(n="(1000 - m)")}) ELSE 0 END) * width / (2 * (1 - exp(-180.0::DOUBLE))) AS mass FROM {name}_n),"""
    else:
        out += f"""
{name}_m AS (SELECT *, list_sum([exp(-abs(low + k * width)) FOR k IN range(1000)]) * width / (2 * (1 - exp(-180.0::DOUBLE))) AS mass FROM {name}_w),"""
    return out + f"""
{name}_t AS (SELECT {keys}, sum(least(mass, 1.0::DOUBLE) * {density} * step) AS part FROM {name}_m GROUP BY ALL),
{name} AS (SELECT s.*, CASE WHEN radius <= 0 OR dist >= delta + radius THEN 0.0::DOUBLE WHEN delta >= radius AND dist <= delta - radius THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, whole + coalesce(part, 0)) END AS tied
  FROM {name}_s s LEFT JOIN {name}_t USING ({keys}))"""


def probable_trace(hops: int, independent: bool) -> str:
    """CTEs up to all_c: contacts of noisy trips with their probability, over hops."""
    far, delta = hav("q.lng", "q.lat", "p.lng", "p.lat"), f"(p_radius + {RADIUS})"
    more = ", q.prev_lng AS pvx, q.prev_lat AS pvy, q.lng AS qx, q.lat AS qy, p.lng AS px, p.lat AS py"
    out = geo_ctes() + """, g9 AS (SELECT * REPLACE (round(lng, 9) AS lng, round(lat, 9) AS lat, round(radius, 9) AS radius) FROM geo_stays),
gp AS (SELECT *, lag(lng) OVER w AS prev_lng, lag(lat) OVER w AS prev_lat FROM g9 WINDOW w AS (PARTITION BY trip_id ORDER BY seq)),
c_ranges AS (SELECT trip_id, max(leave_ts) AS t_end FROM gp GROUP BY trip_id), c_pool1 AS (SELECT * FROM gp)"""
    spreading = "p"
    for k in range(1, hops + 1):
        n = f"c{k}"
        out += pair_ctes(n, f"c_pool{k}", spreading, f"{far} <= {RADIUS} + {TOL} + q.radius + p.radius", far, more)
        alone = probability("dist", "q_radius", delta)
        if independent:
            out += f", probs_{n} AS (SELECT *, {alone} AS prob FROM runs_{n})"
        else:
            out += f""", tie_{n} AS (SELECT q_trip, p_trip, i, j, dist, {hav("px", "py", "pvx", "pvy")} AS pp, {hav("qx", "qy", "pvx", "pvy")} AS qp, q_radius AS radius, {delta} AS delta FROM runs_{n} WHERE pvx IS NOT NULL)"""
            out += correlated_ctes(f"tied_{n}", f"tie_{n}", "q_trip, p_trip, i, j", True)
            out += f", probs_{n} AS (SELECT r.*, CASE WHEN pvx IS NULL THEN {alone.replace('dist', 'r.dist')} ELSE tied END AS prob FROM runs_{n} r LEFT JOIN tied_{n} USING (q_trip, p_trip, i, j))"
        out += f""", sofar_{n} AS (SELECT *, max(prob) OVER (PARTITION BY q_trip, p_trip, run ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS run_prob FROM probs_{n}),
hits_{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_trip, p_trip ORDER BY run_start, run, i, j) AS rn FROM sofar_{n} WHERE cum >= {DUR}) WHERE rn = 1),
new_{n} AS (SELECT * FROM (SELECT q_trip AS susceptible_id, arg_min(p_trip, (run_start, -run_prob, vs, ve, p_trip)) AS spreader_id, min(run_start) AS cst, {k} AS hop,
  1 - product(greatest(0.0::DOUBLE, 1 - run_prob / {k})) AS probability, max(run_prob / {k}) AS most FROM hits_{n} GROUP BY q_trip) WHERE probability >= {MIN_PROB} OR most >= {MIN_PROB}),
c_pool{k + 1} AS (SELECT * FROM c_pool{k} WHERE trip_id NOT IN (SELECT susceptible_id FROM new_{n})),
c_front{k + 1} AS (SELECT s.*, c.cst AS vs, r.t_end AS ve FROM gp s JOIN new_{n} c ON c.susceptible_id = s.trip_id JOIN c_ranges r ON r.trip_id = s.trip_id)"""
        spreading = f"c_front{k + 1}"
    return out + ", all_c AS (" + " UNION ALL ".join(f"SELECT susceptible_id, spreader_id, cst, hop, probability FROM new_c{k}" for k in range(1, hops + 1)) + ")"


#: Stays from raw positions, one position after another.
STAY_POINTS = f""", seen AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY trip_id) AS n FROM gps),
walk(trip_id, n, anchor, j, made) AS (
  SELECT trip_id, any_value(n), 1::BIGINT, 1::BIGINT, -1::BIGINT FROM seen WHERE n > 2 GROUP BY trip_id
  UNION ALL
  SELECT w.trip_id, w.n, CASE WHEN b.k = w.n - 1 OR {hav("a.lng", "a.lat", "b.lng", "b.lat")} > 0.2 THEN b.k ELSE w.anchor END, b.k,
    CASE WHEN (b.k = w.n - 1 OR {hav("a.lng", "a.lat", "b.lng", "b.lat")} > 0.2) AND b.ts - a.ts > 1800 THEN w.anchor ELSE -1 END
  FROM walk w JOIN seen a ON a.trip_id = w.trip_id AND a.k = w.anchor JOIN seen b ON b.trip_id = w.trip_id AND b.k = w.j + 1
), inner_stays AS (
  SELECT w.trip_id, w.j, avg(s.lng) AS lng, avg(s.lat) AS lat, min(s.ts) AS arrive_ts, max(s.ts) AS leave_ts FROM walk w JOIN seen s ON s.trip_id = w.trip_id AND s.k BETWEEN w.made AND w.j WHERE w.made >= 0 GROUP BY w.trip_id, w.j
), every_stay AS (
  SELECT a.trip_id, -1 AS j, a.lng, a.lat, a.ts AS arrive_ts, coalesce(b.ts, a.ts) AS leave_ts FROM seen a LEFT JOIN seen b ON b.trip_id = a.trip_id AND b.k = 1 WHERE a.k = 0
  UNION ALL SELECT * FROM inner_stays
  UNION ALL SELECT trip_id, n, lng, lat, ts, ts FROM seen WHERE k = n - 1 AND n > 1
)"""


def _boxes(x: dict[str, str]) -> str:
    return ", ".join(f"{ROUND(v)} AS {k}" for k, v in x.items())


CASES = "SELECT id AS case_id, id % 10 * 0.07::DOUBLE + 0.01::DOUBLE AS dist, id % 7 * 0.1::DOUBLE + 0.05::DOUBLE AS radius, id % 4 * 0.12::DOUBLE + 0.02::DOUBLE AS delta FROM range(200) t(id)"
TIED_CASES = "SELECT *, id % 9 * 0.05::DOUBLE + 0.02::DOUBLE AS pp, id % 6 * 0.08::DOUBLE + 0.03::DOUBLE AS qp FROM (SELECT *, case_id AS id FROM (" + CASES + "))"
#: The entries of a distribution d, 0 for none, and its label; for no distribution.
ZEROS = ",".join("0" * 18)
SHARES = f"coalesce(array_to_string([CASE WHEN x > 0 THEN printf('%.5f', x) ELSE '0' END FOR x IN {{0}}], ',') || ',' || (list_position({{0}}, list_max({{0}})) - 1), '{ZEROS}')"
ROW, COL = "CAST(floor((43.0::DOUBLE - n.nlat) / 0.01::DOUBLE) AS BIGINT)", "CAST(floor((n.nlng - 114.0::DOUBLE) / 0.01::DOUBLE) AS BIGINT)"
POINT = {"min_lng": "116.3045", "min_lat": "39.9025", "max_lng": "116.3045", "max_lat": "39.9025"}
DISC = circle("116.3045::DOUBLE", "39.9025::DOUBLE", "0.3::DOUBLE")
CELL = {"min_lng": "114.0::DOUBLE + cell_col * 0.01::DOUBLE", "min_lat": "43.0::DOUBLE - cell_row * 0.01::DOUBLE - 0.01::DOUBLE", "max_lng": "114.0::DOUBLE + cell_col * 0.01::DOUBLE + 0.01::DOUBLE", "max_lat": "43.0::DOUBLE - cell_row * 0.01::DOUBLE"}
CLAMP = (
    hav("x", "y", "greatest(least(x, max_lng), min_lng)", "greatest(least(y, max_lat), min_lat)"),
    "SELECT a.*, 116.0::DOUBLE + a.trip_id % 7 * 0.1::DOUBLE AS x, 39.8::DOUBLE + a.trip_id % 5 * 0.05::DOUBLE AS y " + NEXT,
)
MOVED = {"min_lng": "(b.min_lng + a.trip_id % 3 * 0.02::DOUBLE)", "min_lat": "(b.min_lat + a.trip_id % 2 * 0.02::DOUBLE)", "max_lng": "(b.max_lng + a.trip_id % 3 * 0.02::DOUBLE)", "max_lat": "(b.max_lat + a.trip_id % 2 * 0.02::DOUBLE)"}
NOISY = f"trip_id, seq, {ROUND('lng')} AS lng, {ROUND('lat')} AS lat, arrive_ts, leave_ts, {{}} AS radius, orig_point_id"
INVERSE = "1 / CASE WHEN a.dist > 0 THEN a.dist ELSE coalesce(least((SELECT min(b.dist) FROM around b WHERE b.point_id = a.point_id AND b.dist > 0), 1.0::DOUBLE), 1.0::DOUBLE) END"
FAR = hav("q.lng", "q.lat", "p.lng", "p.lat")
DISC_PAIRS = f"(SELECT x.poi_id AS point_key, o.poi_id, {hav('x.lng', 'x.lat', 'o.lng', 'o.lat')} AS dist FROM pois x JOIN pois o ON true)"
HISTS = f"FROM {DISC_PAIRS} d JOIN hist ha ON ha.poi_id = d.point_key JOIN hist hb ON hb.poi_id = d.poi_id WHERE dist <= 0.25"

ORACLES: dict[str, str] = {
    "stays_from_events": BASE + f"SELECT trip_id, seq, point_id, {ROUND('lng')} AS lng, {ROUND('lat')} AS lat, arrive_ts, leave_ts FROM stays",
    "trip_summary": BASE + f"SELECT trip_id, t_start, t_end, n_stays, {_boxes({k: k for k in A})} FROM trips",
    "poi_dimension": BASE + f"SELECT poi_id, {ROUND('any_value(lng)')} AS lng, {ROUND('any_value(lat)')} AS lat, any_value(cell_row) AS cell_row, any_value(cell_col) AS cell_col, string_agg(code || ':' || category_id, '|' ORDER BY code) AS categories FROM labels JOIN (SELECT poi_id, cell_row, cell_col FROM pois) USING (poi_id) GROUP BY poi_id",
    "point_dictionary": BASE + f"SELECT point_id, {ROUND('lng')} AS lng, {ROUND('lat')} AS lat FROM points",
    "poi_category_lookup": f"SELECT code, {category('code')} AS category_id FROM (SELECT unnest({CODE_LIST[:-1]}, '808A', '808B', '8081', '9800', '2800', '2801', 'A983', 'ZZZZ']) AS code)",
    "category_dimension": BASE + "SELECT k.category_id, k.n AS n_prefixes, (SELECT count(DISTINCT poi_id) FROM labels l WHERE l.category_id = k.category_id) AS n_places FROM (VALUES " + ", ".join(f"({k}, {len(v)}::BIGINT)" for k, v in PREFIXES.items()) + ") k(category_id, n)",
    "first_n_trips": BASE + "SELECT trip_id, t_start, t_end FROM trips ORDER BY t_start, t_end, trip_id LIMIT 20",
    "seed_sample": BASE + f"SELECT trip_id FROM (SELECT trip_id, row_number() OVER (ORDER BY {uniform('trip_id')}, trip_id) AS n, count(*) OVER () AS c FROM trips) WHERE n <= CAST(floor(c * 0.1::DOUBLE) AS BIGINT)",
    "susceptible_pool": BASE + "SELECT trip_id, n_stays FROM trips WHERE trip_id NOT IN (SELECT trip_id FROM seeds)",
    "haversine_pairs": BASE + f"SELECT trip_id, seq, round({hav('x', 'y', 'lng', 'lat')}, 5) AS dist_km FROM (SELECT *, lag(lng) OVER w AS x, lag(lat) OVER w AS y FROM stays WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) WHERE x IS NOT NULL",
    "grid_cells": BASE + f"SELECT poi_id, cell_row, cell_col, cell_row * 500 + cell_col AS cell_id, lng BETWEEN 114 AND 119 AND lat BETWEEN 38 AND 43 AS covered, {_boxes(CELL)} FROM pois",
    "circle_bbox": BASE + f"SELECT poi_id, {_boxes(circle('lng', 'lat', '(poi_id % 4 * 0.25::DOUBLE)'))} FROM pois",
    "bbox_relations": BASE + f"SELECT a.trip_id, {contains(A, B)} AS contains, {contains(B, A)} AS inside, NOT {contains(B, A)} AS not_inside, {intersects(A, B)} AS intersects, {contains(A, POINT)} AS has_point, CASE WHEN {contains(A, DISC)} OR {contains(DISC, A)} THEN 1 WHEN {intersects(A, DISC)} THEN 0 ELSE -1 END AS circle_state {NEXT}",
    "point_box_mindist": BASE + f"SELECT trip_id, round({CLAMP[0]}, 4) AS dist_km FROM ({CLAMP[1]})",
    "box_box_mindist": BASE + f"SELECT a.trip_id, round({box_distance(A, MOVED)}, 4) AS dist_km {NEXT}",
    "box_perimeter": BASE + f"SELECT a.trip_id, round({perimeter(A)}, 4) AS perimeter_km, round(CASE WHEN {contains(A, B)} THEN 0 ELSE {perimeter(union_box(A, B))} - {perimeter(A)} END, 4) AS increment_km {NEXT}",
    "ring_neighbors": BASE + 'SELECT poi_id, CAST(greatest(abs(r), abs(c)) AS INT) AS ring, cell_row + r AS "row", cell_col + c AS col FROM pois CROSS JOIN range(-2, 3) a(r) CROSS JOIN range(-2, 3) b(c) WHERE cell_row + r BETWEEN 0 AND 499 AND cell_col + c BETWEEN 0 AND 499',
    "pois_in_disc": BASE + f"SELECT point_key, poi_id, round(dist, 5) AS dist_km FROM {DISC_PAIRS} WHERE dist <= 0.25",
    "nearest_poi": BASE + f"""SELECT point_id, poi_id, round(dist, 5) AS dist_km, ring FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ring, dist, poi_id) AS n FROM (
      SELECT x.point_id, o.poi_id, {hav('x.lng', 'x.lat', 'o.lng', 'o.lat')} AS dist, CAST(greatest(abs(o.cell_row - CAST(floor((43.0::DOUBLE - x.lat) / 0.01::DOUBLE) AS BIGINT)), abs(o.cell_col - CAST(floor((x.lng - 114.0::DOUBLE) / 0.01::DOUBLE) AS BIGINT))) AS INT) AS ring
      FROM points x JOIN pois o ON true) WHERE ring < 5) WHERE n = 1""",
    "knn_pois": BASE + f"SELECT point_id, CAST(rank AS INT) AS rank, poi_id, round(dist, 5) AS dist_km FROM ({near('points', 'point_id', 5, 0.5, 2)})",
    "trip_prefilter_pairs": BASE + f"""SELECT * FROM (SELECT a.trip_id AS q_trip, b.trip_id AS p_trip, a.t_start <= b.t_end AND b.t_start <= a.t_end AS in_time, {intersects(A, B)} OR {box_distance(A, B)} <= 0.1 AS in_space
      FROM trips a JOIN trips b ON a.trip_id <> b.trip_id WHERE a.trip_id NOT IN (SELECT trip_id FROM seeds) AND b.trip_id IN (SELECT trip_id FROM seeds)) WHERE in_time OR in_space""",
    "interval_overlap_join": BASE + "SELECT q.trip_id AS q_trip, q.seq AS i, count(*) AS n_overlaps, CAST(sum(least(q.leave_ts, p.leave_ts) - greatest(q.arrive_ts, p.arrive_ts)) AS BIGINT) AS overlap_s FROM q JOIN p ON q.trip_id <> p.trip_id AND q.arrive_ts < p.leave_ts AND p.arrive_ts < q.leave_ts GROUP BY ALL",
    "long_overlaps": BASE + "SELECT q.trip_id AS q_trip, q.seq AS i, p.trip_id AS p_trip, p.seq AS j, least(q.leave_ts, p.leave_ts) - greatest(q.arrive_ts, p.arrive_ts) AS overlap_s FROM q JOIN p ON q.trip_id <> p.trip_id AND least(q.leave_ts, p.leave_ts) - greatest(q.arrive_ts, p.arrive_ts) >= 3600",
    "neighbouring_spans": BASE + ", f AS (SELECT trip_id, arg_min(arrive_ts, seq) AS a, arg_min(leave_ts, seq) AS l FROM stays GROUP BY trip_id) SELECT x.trip_id, x.a <= y.l AND y.a <= x.l AS meet, least(x.l, y.l) - greatest(x.a, y.a) >= 600 AS long FROM f x JOIN f y ON y.trip_id = x.trip_id + 1",
    "contact_pairs": BASE + pair_ctes("x", "q", "p", "q.point_id = p.point_id") + "SELECT q_trip, i, p_trip, j, start_ts, end_ts FROM pairs_x",
    "contact_pairs_radius": BASE + pair_ctes("x", "q", "p", f"{FAR} <= {RADIUS}", FAR) + "SELECT q_trip, i, p_trip, j, start_ts, end_ts, round(dist, 5) AS dist_km FROM pairs_x",
    "contact_runs": BASE + pair_ctes("x", "q", "p", f"{FAR} <= {RADIUS}") + "SELECT q_trip, p_trip, CAST(run AS BIGINT) AS run, min(run_start) AS run_start, CAST(max(cum) AS BIGINT) AS duration_s, count(*) AS n_pairs FROM runs_x GROUP BY q_trip, p_trip, run",
    "direct_contacts": BASE + pair_ctes("x", "q", "p", "q.point_id = p.point_id") + contact_ctes("x", 1) + "SELECT susceptible_id, spreader_id, cst FROM new_x",
    "multi_hop_contacts": BASE + trace() + "SELECT susceptible_id, spreader_id, cst, hop FROM all_h",
    "contacts_per_hop": BASE + trace() + "SELECT hop, count(*) AS n_contacts, min(cst) AS first_cst FROM all_h GROUP BY hop",
    "category_distribution": BASE + dists() + "SELECT point_id, CAST(category_id AS INT) AS category_id, round(share, 6) AS share FROM dists",
    "category_distribution_by_distance": BASE + dists(INVERSE) + "SELECT point_id, CAST(category_id AS INT) AS category_id, round(share, 5) AS share FROM dists",
    "distribution_argmax": BASE + dists() + "SELECT point_id, CAST(arg_max(category_id, (round(share, 9), -category_id)) AS INT) AS label FROM dists GROUP BY point_id",
    "jaccard_similarity": BASE + f"SELECT point_key, d.poi_id, round({jaccard('ha.h', 'hb.h')}, 6) AS similarity {HISTS}",
    "poi_weights": BASE + f"SELECT point_key, d.poi_id, round(exp({EPS}::DOUBLE * (1 - {jaccard('hb.h', 'ha.h')}) / 2), 6) AS weight {HISTS}",
    "uniform_draws": BASE + f"SELECT trip_id, seq, round({uniform(str(SEED), 'trip_id', 'seq', '1')}, 9) AS u FROM stays",
    "planar_laplace_noise": BASE + lambert_ctes("stays", uniform(str(SEED), "trip_id", "seq", "2")) + f"SELECT trip_id, seq, round(-(wv + 1) / {EPS}::DOUBLE, 6) AS radius_km FROM w",
    "geo_ind_trips": BASE + geo_ctes() + f"SELECT {NOISY.format(ROUND('radius'))} FROM geo_stays",
    "geo_ind_trips_compat": BASE + geo_ctes(compat=True) + f"SELECT {NOISY.format(ROUND('radius'))} FROM geo_stays",
    "semantic_ind_trips": BASE + semantic_ctes() + f"SELECT {NOISY.format('round(radius, 5)')} FROM semantic_stays",
    "geosemantic_ind_trips": BASE + geosemantic_ctes() + f"SELECT {NOISY.format('round(radius, 5)')} FROM gs_stays",
    "contact_prob_independent": f"SELECT case_id, round({probability('dist', 'radius', 'delta')}, 5) AS probability FROM ({CASES})",
    "pair_probabilities": BASE + private_ctes() + "SELECT q_trip, i, p_trip, j, round(prob, 4) AS probability FROM probs",
    "aggregated_contact_prob": BASE + private_ctes() + "SELECT susceptible_id, round(probability, 4) AS probability FROM joint WHERE probability >= 1e-12 OR most >= 1e-12",
    "probabilistic_contacts": BASE + private_ctes() + f"SELECT susceptible_id, spreader_id, cst, round(probability, 4) AS probability FROM joint WHERE probability >= {MIN_PROB} OR most >= {MIN_PROB}",
    "private_multi_hop_contacts": BASE + geo_ctes() + trace("geo_stays", "p", f"{FAR} <= {TOL} + q.radius + p.radius", "g") + "SELECT susceptible_id, spreader_id, cst, hop FROM all_g",
    "contact_metrics": BASE + geo_ctes() + trace("geo_stays", "p", f"{FAR} <= {TOL} + q.radius + p.radius", "g") + trace() + """, m AS (
      SELECT (SELECT count(*) FROM all_g WHERE susceptible_id IN (SELECT susceptible_id FROM all_h)) AS true_positive, (SELECT count(*) FROM all_g) AS "found", (SELECT count(*) FROM all_h) AS actual)
      SELECT true_positive, "found", actual, round(true_positive / "found", 6) AS precision, round(true_positive / actual, 6) AS recall FROM m""",
    "semantic_multi_hop_contacts": BASE + semantic_ctes() + trace("semantic_stays", "p", f"{FAR} <= {TOL} + q.radius + p.radius", "s") + "SELECT susceptible_id, spreader_id, cst, hop FROM all_s",
    "geosemantic_multi_hop_contacts": BASE + geosemantic_ctes() + trace("gs_stays", "p", f"{FAR} <= {TOL} + q.radius + p.radius", "s") + "SELECT susceptible_id, spreader_id, cst, hop FROM all_s",
    "interval_search_contacts": BASE + trace(hops=2) + "SELECT susceptible_id, spreader_id, cst, hop FROM all_h",
    "probabilistic_multi_hop_contacts": BASE + probable_trace(2, True) + "SELECT susceptible_id, spreader_id, cst, hop, round(probability, 4) AS probability FROM all_c",
    "correlated_multi_hop_contacts": BASE + probable_trace(2, False) + "SELECT susceptible_id, spreader_id, cst, hop, round(probability, 4) AS probability FROM all_c",
    "contact_prob_correlated": f"WITH cases AS ({TIED_CASES})" + correlated_ctes("c", "cases", "case_id", False) + "SELECT case_id, round(tied, 6) AS probability FROM c",
    "stay_points": BASE.replace("WITH ", "WITH RECURSIVE ", 1) + STAY_POINTS + f"SELECT trip_id, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY j) - 1 AS INT) AS seq, {ROUND('lng')} AS lng, {ROUND('lat')} AS lat, arrive_ts, leave_ts FROM every_stay",
    "probability_export": BASE + probable_trace(2, True) + "SELECT susceptible_id || ', ' || spreader_id || ', ' || cst || ',' || hop || ',' || printf('%g', round(probability, 4)) AS line FROM all_c",
    "number_texts": "SELECT id, printf('%g', id * pow(10.0::DOUBLE, id % 12 - 8) / 7) AS text FROM range(240) t(id)",
    "date_to_epoch": "SELECT event_id, CAST(floor(epoch(strptime(strftime(ts, '%Y.%m.%d %H:%M:%S'), '%Y.%m.%d %H:%M:%S'))) AS BIGINT) AS epoch_s FROM events",
    "day_gap": BASE + "SELECT trip_id, CAST(date_diff('day', CAST(to_timestamp(t_start) AT TIME ZONE 'UTC' AS DATE), CAST(to_timestamp(t_end) AT TIME ZONE 'UTC' AS DATE)) AS INT) AS days, CAST(date_diff('day', CAST(to_timestamp(t_start) AT TIME ZONE 'UTC' AS DATE), CAST(to_timestamp(t_end + 40000000) AT TIME ZONE 'UTC' AS DATE)) AS INT) AS days_on FROM trips",
    "float_tag": "SELECT id, replace(regexp_replace(printf('%.6f', id / 8), '(\\.[0-9]+?)0+$', '\\1'), '.', '-') AS tag FROM range(300) t(id)",
    "split_tokens": "SELECT event_id, CAST(len(t) AS BIGINT) AS n_tokens, t[1] AS first, t[-1] AS last FROM (SELECT event_id, string_split(event_type || ',,' || props, ',') AS t FROM events)",
    "contact_export": BASE + trace() + "SELECT susceptible_id || ', ' || spreader_id || ', ' || cst || ',' || hop AS line FROM all_h",
    "noisy_trip_export": BASE + semantic_ctes() + f"SELECT printf('%d,%.7f,%.7f,%s,%.7f,%.7f,%.7f,%s,%d,%d', trip_id, lng, lat, {SHARES.format('a.d')}, nlng, nlat, round(nr, 5), {SHARES.format('b.d')}, arrive_ts, leave_ts) AS line FROM semantic s LEFT JOIN dlist a ON a.point_id = s.point_id LEFT JOIN dlist b ON b.point_id = s.poi_id",
    "noisy_trip_export_geo": BASE + geo_ctes() + f"SELECT printf('%d,%.7f,%.7f,%s,%.7f,%.7f,%.7f,%s,%d,%d', trip_id, lng, lat, '{ZEROS}', round(nlng, 6), round(nlat, 6), round(nr, 6), '{ZEROS}', arrive_ts, leave_ts) AS line FROM noisy",
    "snapped_points": BASE + geo_ctes() + f"""SELECT n.trip_id, n.seq, f.poi_id AS noisy_poi_id, {ROUND('coalesce(f.x, n.nlng)')} AS noisy_lng, {ROUND('coalesce(f.y, n.nlat)')} AS noisy_lat FROM noisy n LEFT JOIN (
      SELECT * FROM (SELECT n.trip_id, n.seq, o.poi_id, o.lng AS x, o.lat AS y, row_number() OVER (PARTITION BY n.trip_id, n.seq ORDER BY greatest(abs(o.cell_row - {ROW}), abs(o.cell_col - {COL})), {hav('n.nlng', 'n.nlat', 'o.lng', 'o.lat')}, o.poi_id) AS rn
        FROM noisy n JOIN pois o ON abs(o.cell_row - {ROW}) < 5 AND abs(o.cell_col - {COL}) < 5) WHERE rn = 1) f ON f.trip_id = n.trip_id AND f.seq = n.seq""",
    "first_stays": BASE + "SELECT trip_id, seq, point_id, arrive_ts, leave_ts FROM stays s WHERE seq = (SELECT min(seq) FROM stays t WHERE t.trip_id = s.trip_id)",
    "run_totals": BASE + f"SELECT count(DISTINCT trip_id) AS n_trips, count(*) AS n_stays, {ROUND('count(*) / count(DISTINCT trip_id)::DOUBLE')} AS stays_a_trip, count(DISTINCT arrive_ts) AS n_starts, max(leave_ts) AS last_end FROM stays",
    "place_categories": BASE + "SELECT CAST(category_id AS INT) AS category_id, code, poi_id FROM labels",
    "category_codes": BASE + "SELECT CAST(category_id AS INT) AS category_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(DISTINCT poi_id) AS n_places FROM (SELECT category_id, code, poi_id FROM labels UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}', NULL::BIGINT)" for k, v in PREFIXES.items() for c in v) + ") v(a, b, c)) GROUP BY category_id",
    "equal_distributions": BASE + "SELECT a.poi_id, coalesce(a.h = b.h, false) AS equal FROM hist a LEFT JOIN hist b ON b.poi_id = a.poi_id + 17",
    "point_texts": BASE + "SELECT poi_id, printf('%.7f,%.7f', lng, lat) AS text FROM pois",
    "trip_candidate_pairs": BASE + f""", pieces AS (SELECT trip_id * 1000 + seq // 20 AS trip_id, min(arrive_ts) AS t_start, max(leave_ts) AS t_end, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat
      FROM stays WHERE seq % 40 < 3 OR seq % 40 = 20 GROUP BY 1)
      SELECT a.trip_id AS q_trip, b.trip_id AS p_trip FROM pieces a JOIN pieces b ON a.trip_id <> b.trip_id AND a.trip_id // 1000 % {SEED_EVERY} <> 0 AND b.trip_id // 1000 % {SEED_EVERY} = 0
      AND a.t_start <= b.t_end AND b.t_start <= a.t_end AND ({intersects(A, B)} OR {box_distance(A, B)} <= 0.1)""",
    "run_parameters": "SELECT * FROM (VALUES ('contact_min_duration', '600'), ('contact_min_prob', '0.0'), ('data_total', '10'), ('dataset_type', 'Synthetic'), ('home_path', './Testing/'), ('identical_poi_dist_max', '0.0'), ('independent_contact_prob', 'True'), ('init_contact_ratio', '0.2'), ('multi_hop', '5'), ('privacy_epsilon_geo', '4.0'), ('privacy_epsilon_semantic', '4.0'), ('privacy_model', 'geo'), ('search_type', 'IR'), ('run_name', 'Synthetic_D10_QR0-2_G_EG4-0_FS_MH5_CD0-0_CT600_IR')) t(key, value)",
    "run_names": "SELECT * FROM (VALUES (0::BIGINT, 'PCTi', 'Synthetic_D200_QR0-2_G_EG4-0_FS_MH1_ICP0-05_CD0-1_CT60_IR'), (1, 'PCTc', 'Synthetic_D200_QR0-2_S_ES4-0_FS_MH1_CCP0-05_CD0-1_CT60_IR'), (2, 'PCT', 'Geolife_D200_DS0_QR0-2_GS_EG4-0_ES4-0_FS_MH1_CD0-1_CT60_IR'), (3, 'PCTi', 'Geolife_D200_DS0_QR0-2_GS_EG4-0_ES4-0_FS_MH1_ICP0-125_CD0-1_CT60_IR'), (4, 'PCT', 'Synthetic_D200_QR0-2_ground_truth_FS_MH1_CD0-1_CT60_IR')) t(case_id, mode, name)",
}
