"""The contact join: stays that meet in time and place, runs of them, and contacts.

The interval-and-distance join is rewritten to an equi-join on time bin and place: both sides are
exploded to the bins that they touch, and a pair is kept in the one bin where its overlap begins, so no
pair repeats and nothing has to be made distinct. Bins come in levels, each BINS_EACH times as wide as the one
below; a stay takes the lowest level at which it touches few bins, and a pair meets at the higher level of both,
so long stays don't fall into very many bins.

The place is the coordinate itself where places must be equal; else a grid cell. Radii come in classes, each
twice the one below and with a grid of its own; a pair meets in the grid of the larger class, where the stay of that class (of
equal ones, that of the side with fewer stays) is in all cells within reach and the other in its own. So a few wide radii don't coarsen the grid of the others.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopwise.functions.geo import EARTH_RADIUS_KM, degrees_for, haversine
from hopwise.functions.probability import correlated_probability, independent_probability
from hopwise.plans.lineage import cut

BIN_FACTOR = 3
BINS_EACH = 16
#: Cells across the reach of the exploded side: more cells mean fewer pairs to test, and more rows.
CELLS_ACROSS = 4
#: Shares of the arrivals at which earliest() cuts time, where there are more than so many.
SLICES = (0.02, 0.06, 0.15, 0.4)
SLICED_FROM = 300_000
#: Shares of the arrivals up to which probable() joins, before it joins what is open yet as a whole; where there are so many
#: susceptible times infectious stays.
PREFIXES = (0.01, 0.03, 0.08, 0.25)
PREFIXED_FROM = 100_000_000_000


def _bins(start: Column, end: Column, width) -> Column:
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def widths(width: int, longest: int) -> list[int]:
    """The bins' widths by level, so that the longest stay touches few of the last."""
    out = [width]
    while longest > BINS_EACH * out[-1]:
        out.append(out[-1] * BINS_EACH)
    return out


def _level(length: Column, levels: list[int]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(BINS_EACH * w) for w in levels[:-1])), lambda w: w < length)) if len(levels) > 1 else F.lit(0)


def _in_bins(rows: DataFrame, start: str, end: str, level: str, levels: list[int]) -> DataFrame:
    """rows with level, and a row for each bin (lvl, bin) of that level and those above."""
    each = F.array(*(F.struct(F.lit(k).alias("lvl"), F.lit(w).cast("long").alias("width")) for k, w in enumerate(levels)))
    ranked = rows.withColumn(level, _level(F.col(end) - F.col(start), levels))
    of_level = lambda x: F.transform(_bins(F.col(start), F.col(end), x["width"]), lambda b: F.struct(x["lvl"].alias("lvl"), b.alias("bin")))
    if len(levels) == 1:
        return ranked.withColumn("bin", F.explode(_bins(F.col(start), F.col(end), levels[0]))).withColumn("lvl", F.lit(0))
    own = F.flatten(F.transform(F.filter(each, lambda x: x["lvl"] >= F.col(level)), of_level))
    return ranked.withColumn("__b", F.explode(own)).withColumns({"lvl": F.col("__b.lvl"), "bin": F.col("__b.bin")}).drop("__b")


def infectious(stays: DataFrame, frontier: DataFrame) -> DataFrame:
    """The frontier's stays, cut to their trips' infectious time. frontier: trip_id, valid_start, valid_end."""
    return stays.join(frontier.select("trip_id", "valid_start", "valid_end"), "trip_id").filter(
        "leave_ts > valid_start and arrive_ts < valid_end"
    )


def alike(p: DataFrame) -> DataFrame:
    """Infectious stays with copies: of trips that are equal in all their stays and valid times only that of the least trip_id, and how many there are.

    A susceptible that is none of them meets them all alike, at one time and with one probability.
    """
    stay = F.struct(*(F.col(c).cast("string") for c in ("seq", "lng", "lat", "arrive_ts", "leave_ts", "radius", "valid_start", "valid_end")))
    each = p.groupBy("trip_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(stay))), 256).alias("__all"))
    first = each.groupBy("__all").agg(F.min("trip_id").alias("trip_id"), F.count("*").alias("copies")).drop("__all")
    return p.join(first, "trip_id")


def longest_stay(*sides: DataFrame) -> int:
    """Seconds of the longest stay."""
    return max(x.agg(F.coalesce(F.max(F.col("leave_ts") - F.col("arrive_ts")), F.lit(0))).first()[0] for x in sides)


def usual_stay(*sides: DataFrame) -> int:
    """Seconds of the stay of mean length, of the side where it is longer."""
    return math.ceil(max(x.agg(F.coalesce(F.avg(F.col("leave_ts") - F.col("arrive_ts")), F.lit(0.0))).first()[0] for x in sides))


def lengths(*sides: DataFrame) -> tuple[int, int]:
    """longest_stay() and usual_stay(), in one pass over each side."""
    length = F.col("leave_ts") - F.col("arrive_ts")
    found = [x.agg(F.coalesce(F.max(length), F.lit(0)), F.coalesce(F.avg(length), F.lit(0.0))).first() for x in sides]
    return max(r[0] for r in found), math.ceil(max(r[1] for r in found))


def _classes(q: DataFrame, p: DataFrame, least: float) -> tuple[list[float], bool]:
    """The largest radius of each class, doubling from what is usual up to the largest there is; and whether q has fewer rows than p."""
    found = [x.agg(F.coalesce(F.max("radius"), F.lit(0.0)), F.coalesce(F.avg("radius"), F.lit(0.0)), F.count("*")).first() for x in (q, p)]
    most, fewer = float(max(r[0] for r in found)), found[0][2] < found[1][2]
    if most <= 0:
        return [0.0], fewer
    out = [min(most, max(least, *(float(r[1]) for r in found)))]
    while out[-1] < most:
        out.append(min(most, out[-1] * 2))
    return out, fewer


def _in_cells(rows: DataFrame, n: str, classes: list[float], base: float, mode: int) -> DataFrame:
    """rows, once for each grid cell (mode, cls, cx, cy) where they can meet the other side.

    In its own mode a row is in all cells of its class's grid within reach; in the other mode, in its own cell of the grids
    of larger classes (for mode 1 rows of its own class too, as of equal classes the side of mode 0 reaches out).
    """
    sizes = F.array(*(F.lit(max(degrees_for(base + 2 * r) * 2 / CELLS_ACROSS, 1e-5)) for r in classes))
    largest = F.array(*(F.lit(r) for r in classes))
    radius, lng, lat = (F.col(f"{n}_{c}").cast("double") for c in ("radius", "lng", "lat"))
    ranked = rows.withColumn("__c", F.size(F.filter(largest, lambda r: r < radius)))
    cls = F.col("__c")
    span = F.lit(base) + radius + F.get(largest, cls)
    high = F.degrees(span / EARTH_RADIUS_KM)
    wide = F.degrees(span / (EARTH_RADIUS_KM * F.cos(F.radians(F.least(F.abs(lat) + high, F.lit(89.0))))))
    size = F.get(sizes, cls)
    line = lambda c, r: F.sequence(F.floor((c - r) / size), F.floor((c + r) / size))
    cell = lambda m, c, x, y: F.struct(F.lit(m).alias("mode"), c.cast("int").alias("cls"), x.alias("cx"), y.alias("cy"))
    around = F.flatten(F.transform(line(lng, wide), lambda x: F.transform(line(lat, high), lambda y: cell(mode, cls, x, y))))
    if mode == 1:
        around = F.when(cls > 0, around).otherwise(F.slice(around, 1, 0))
    others = F.array(*(F.lit(k) for k in range(len(classes))))
    sits = F.transform(F.filter(others, lambda c: c >= cls if mode == 1 else c > cls), lambda c: cell(1 - mode, c, F.floor(lng / F.get(sizes, c)), F.floor(lat / F.get(sizes, c))))
    return ranked.withColumn("__at", F.explode(F.concat(around, sits))).select(*rows.columns, cls.alias(f"{n}_class"), "__at.mode", "__at.cls", "__at.cx", "__at.cy")


def pairs(
    q: DataFrame,
    p: DataFrame,
    *,
    d_km: float = 0.0,
    tolerance_km: float = 0.0,
    min_duration: int = 600,
    exact: bool | None = None,
    longest: int | None = None,
    usual: int | None = None,
    cells: bool = True,
    only: DataFrame | None = None,
) -> DataFrame:
    """Pairs of stays of different trips that overlap in time within d + both radii (+ tolerance).

    q: susceptible stays; p: infectious stays with valid_start and valid_end. Out: q_trip, p_trip, i, j,
    start_ts, end_ts, dist and what runs() and probabilities need. exact: places must be equal; by default, if
    d and all radii are 0. longest, usual: seconds of the longest and of the mean stay, if known; bins are no narrower than that
    mean, so that most stays fall into two of them at most. cells: false joins by time alone. only: q_trip and p_trip, each once, of
    the trips to be joined, by trip and time; all by default.
    """
    base = d_km + tolerance_km
    if exact is None and only is not None:
        exact = base == 0 and cells and _classes(q, p, 0.01)[0] == [0.0]
    cells = cells and only is None
    classes, q_reaches = ([0.0], False) if exact or not cells else _classes(q, p, max(base, 0.01))
    if exact is None:
        exact = base == 0 and classes == [0.0] and cells
    levels = widths(max(BIN_FACTOR * min_duration, usual_stay(q, p) if usual is None else usual), longest_stay(q, p) if longest is None else longest)
    start, end = F.greatest("arrive_ts", "valid_start"), F.least("leave_ts", "valid_end")
    left = q.select(
        F.col("trip_id").alias("q_trip"), F.col("seq").alias("i"), F.col("lng").alias("q_lng"), F.col("lat").alias("q_lat"),
        F.col("arrive_ts").alias("q_arrive"), F.col("leave_ts").alias("q_leave"), F.col("radius").alias("q_radius"),
        *(F.col(c) for c in ("prev_lng", "prev_lat") if c in q.columns),
    ).filter("q_arrive < q_leave")
    right = p.select(
        F.col("trip_id").alias("p_trip"), F.col("seq").alias("j"), F.col("lng").alias("p_lng"), F.col("lat").alias("p_lat"),
        start.alias("p_start"), end.alias("p_end"), F.col("leave_ts").alias("p_leave"), F.col("radius").alias("p_radius"), "valid_start", "valid_end",
        *(c for c in ("copies",) if c in p.columns),
    ).filter("p_start < p_end")
    if only is not None:
        left = left.join(only.select("q_trip", "p_trip"), "q_trip")
        right = right.join(only.select("p_trip").distinct(), "p_trip", "left_semi")
    same = ["p_trip"] if only is not None else []
    left, right = _in_bins(left, "q_arrive", "q_leave", "q_level", levels), _in_bins(right, "p_start", "p_end", "p_level", levels)
    # Rows that meet in a bin are told apart from their meeting in another by the bin of the later start.
    width = F.get(F.array(*(F.lit(w).cast("long") for w in levels)), F.col("lvl")) if len(levels) > 1 else F.lit(levels[0])
    once = (F.col("bin") == F.floor(F.greatest("q_arrive", "p_start") / width)) & (F.col("lvl") == F.greatest("q_level", "p_level"))
    meet = (F.col("q_trip") != F.col("p_trip")) & (F.col("q_arrive") < F.col("p_end")) & (F.col("p_start") < F.col("q_leave")) & once
    if exact:
        met = left.withColumns({"lng": F.col("q_lng"), "lat": F.col("q_lat")}).join(right.withColumns({"lng": F.col("p_lng"), "lat": F.col("p_lat")}), ["lvl", "bin", "lng", "lat", *same]).filter(meet)
        near = met.withColumn("dist", F.lit(0.0)).drop("lng", "lat")
    else:
        keys = ["lvl", "bin", *same]
        if cells:
            # Of equal classes the side with fewer rows reaches out, which makes the fewest.
            left, right = _in_cells(left, "q", classes, base, 1 - q_reaches), _in_cells(right, "p", classes, base, int(q_reaches))
            keys += ["mode", "cls", "cx", "cy"]
            one, other = ("q_class", "p_class") if q_reaches else ("p_class", "q_class")
            reaches = F.when(F.col("mode") == 0, F.col(one) >= F.col(other)).otherwise(F.col(one) < F.col(other))
            meet = meet & (F.col("cls") == F.greatest("q_class", "p_class")) & reaches
        far = haversine("q_lng", "q_lat", "p_lng", "p_lat")
        near = left.join(right, keys).filter(meet).withColumn("dist", far).filter(F.col("dist") <= F.lit(base) + F.col("q_radius") + F.col("p_radius"))
        near = near.drop("mode", "cls", "cx", "cy", "q_class", "p_class")
    return near.withColumns({"start_ts": F.greatest("q_arrive", "p_start"), "end_ts": F.least("q_leave", "p_end")}).drop("lvl", "bin", "q_level", "p_level")


def with_previous(stays: DataFrame) -> DataFrame:
    """stays and the coordinates of the trip's stay before; null for the first."""
    trip = W.partitionBy("trip_id").orderBy("seq")
    return stays.withColumns({"prev_lng": F.lag("lng").over(trip), "prev_lat": F.lag("lat").over(trip)})


def with_probability(met: DataFrame, d_km: float, independent: bool = True) -> DataFrame:
    """met with prob: of contact between a noisy susceptible stay and a place; 0 for exact stays."""
    delta = F.col("p_radius") + d_km
    if independent:
        return met.withColumn("prob", independent_probability(F.col("dist"), F.col("q_radius"), delta))
    first = F.col("prev_lng").isNull()
    # Both are evaluated for all rows; nulls take no time.
    alone = independent_probability(F.when(first, F.col("dist")), F.col("q_radius"), delta)
    tied = correlated_probability(F.col("dist"), haversine("p_lng", "p_lat", "prev_lng", "prev_lat"), haversine("q_lng", "q_lat", "prev_lng", "prev_lat"), F.col("q_radius").cast("double"), delta.cast("double"))
    return met.withColumn("prob", F.when(first, alone).otherwise(tied))


def runs(met: DataFrame) -> DataFrame:
    """met with run (number within the pair of trips), cum (overlap so far), run_start and run_prob (max so far).

    A row continues the one before if either trip went on to its next stay while the other stayed, or
    both went on at the same moment.
    """
    pair = W.partitionBy("q_trip", "p_trip").orderBy("i", "j")
    last_i, last_j = F.lag("i").over(pair), F.lag("j").over(pair)
    together = (F.col("i") == last_i + 1) & (F.col("j") == last_j + 1) & (F.lag("q_leave").over(pair) == F.lag("p_leave").over(pair))
    goes_on = ((F.col("i") == last_i + 1) & (F.col("j") == last_j)) | ((F.col("i") == last_i) & (F.col("j") == last_j + 1)) | together
    numbered = met.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("__new").over(pair))
    run = W.partitionBy("q_trip", "p_trip", "run").orderBy("i", "j").rowsBetween(W.unboundedPreceding, W.currentRow)
    added = {"cum": F.sum(F.col("end_ts") - F.col("start_ts")).over(run), "run_start": F.min("start_ts").over(run)}
    if "prob" in met.columns:
        added["run_prob"] = F.max("prob").over(run)
    return numbered.withColumns(added).drop("__new")


def events(of_runs: DataFrame, min_duration: int) -> DataFrame:
    """The earliest contact of each pair of trips: q_trip, p_trip, cst, prob, valid_start, valid_end.

    A contact is a run whose overlap adds up to min_duration; it begins with the run.
    """
    prob = F.col("run_prob") if "run_prob" in of_runs.columns else F.lit(1.0)
    copies = [c for c in ("copies",) if c in of_runs.columns]
    long = of_runs.filter(F.col("cum") >= min_duration)
    earliest = F.min(F.struct(F.col("run_start").alias("cst"), F.col("run").alias("run"), F.col("i"), F.col("j"), prob.alias("prob"), F.col("valid_start"), F.col("valid_end"), *copies))
    return long.groupBy("q_trip", "p_trip").agg(earliest.alias("e")).select("q_trip", "p_trip", "e.cst", "e.prob", "e.valid_start", "e.valid_end", *(f"e.{c}" for c in copies))




def contacts(of_events: DataFrame, *, hop: int = 1, min_prob: float = 0.0, accept_max: bool = True) -> DataFrame:
    """One row per susceptible: susceptible_id, spreader_id, cst, hop, probability.

    The spreader is that of the earliest contact; ties go to the higher probability, then the earlier
    validity, then the smaller id. With min_prob, the probability is that of at least one contact, each damped by
    the hop, and susceptibles below it go, unless (accept_max) a single contact reaches it. Of trips that are alike (copies) each counts.
    """
    order = F.struct(F.col("cst"), (-F.col("prob")).alias("less"), F.col("valid_start"), F.col("valid_end"), F.col("p_trip"))
    damped = 1 - F.col("prob") / hop
    certain = F.max(F.when(damped <= 0, 1).otherwise(0))
    copies = F.col("copies") if "copies" in of_events.columns else F.lit(1)
    any_contact = F.when(certain == 1, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.when(damped > 0, F.log(damped) * copies))))
    best = of_events.groupBy(F.col("q_trip").alias("susceptible_id")).agg(F.min(order).alias("o"), any_contact.alias("probability"), F.max(F.col("prob") / hop).alias("most"))
    if min_prob > 0:
        reached = F.col("probability") >= min_prob
        best = best.filter(reached | (F.col("most") >= min_prob) if accept_max else reached)
    else:
        best = best.withColumn("probability", F.lit(1.0))
    return best.select("susceptible_id", F.col("o.p_trip").alias("spreader_id"), F.col("o.cst").alias("cst"), F.lit(hop).alias("hop"), "probability")


def _settled(met: DataFrame, last: DataFrame, until: int, min_duration: int, hop: int, enough: float) -> DataFrame:
    """susceptible_id, spreader_id, cst of those whose contact no later stay can change and whose probability is 1 - exp(enough) at least.

    met: pairs with prob of the stays that arrive before until, those of a trip being its first. So a row's run and what
    adds up in it are those of the whole trip. last: trip_id, last_i of the last of those stays. What comes later starts at until or after, in a
    new run or, if that has the last stay, in the last run of the pair of trips: a contact that began before until and not after such a
    run stays the earliest of its pair of trips, and other pairs' begin no earlier than such a run or until.
    """
    needed = met.select("q_trip", "p_trip", "i", "j", "q_leave", "p_leave", "start_ts", "end_ts", "valid_start", "valid_end", "prob", F.col("copies") if "copies" in met.columns else F.lit(1).alias("copies"))
    # By trip alone, which also serves the windows and groups by pairs of trips.
    of_runs = runs(needed.repartition("q_trip"))
    event = F.struct(F.col("run_start").alias("cst"), F.col("run").alias("run"), "i", "j", F.col("run_prob").alias("prob"), "valid_start", "valid_end", "copies")
    of_pairs = of_runs.groupBy("q_trip", "p_trip").agg(
        F.min(F.when(F.col("cum") >= min_duration, event)).alias("e"), F.max(F.struct("i", "j", "run_start", "run")).alias("o")
    )
    of_pairs = of_pairs.join(last.select(F.col("trip_id").alias("q_trip"), "last_i"), "q_trip")
    goes_on = F.col("o.i") >= F.col("last_i")
    kept = ~goes_on | (F.struct("e.cst", "e.run") <= F.struct(F.col("o.run_start").alias("cst"), F.col("o.run").alias("run")))
    final = F.col("e").isNotNull() & (F.col("e.cst") < until) & kept
    order = F.struct(F.col("e.cst").alias("cst"), (-F.col("e.prob")).alias("less"), F.col("e.valid_start").alias("valid_start"), F.col("e.valid_end").alias("valid_end"), "p_trip")
    damped = 1 - F.col("e.prob") / hop
    known = of_pairs.withColumn("final", F.coalesce(final, F.lit(False))).groupBy("q_trip").agg(
        F.min(F.when(F.col("final"), order)).alias("best"),
        F.min(F.when(~F.col("final"), F.least("e.cst", F.when(goes_on, F.col("o.run_start"))))).alias("open"),
        F.max(F.when(F.col("final") & (damped <= 0), 1).otherwise(0)).alias("certain"),
        F.sum(F.when(F.col("final") & (damped > 0), F.log(damped) * F.col("e.copies")).otherwise(0.0)).alias("none"),
    )
    sure = (F.col("certain") == 1) | (F.col("none") <= enough)
    return known.filter(sure & F.col("best").isNotNull() & (F.col("open").isNull() | (F.col("best.cst") < F.col("open")))).select(
        F.col("q_trip").alias("susceptible_id"), F.col("best.p_trip").alias("spreader_id"), F.col("best.cst").alias("cst")
    )


def probable(
    q: DataFrame, p: DataFrame, *, min_duration: int, min_prob: float, d_km: float = 0.0, independent: bool = True, accept_max: bool = True, hop: int = 1, digits: int | None = None, **how
) -> DataFrame:
    """contacts(events(runs(with_probability(pairs(q, p))))), but trips leave the join once their contact and probability are settled.

    More contacts only raise a probability, and those that begin earlier are met first. So trips are joined up to a share of the
    arrivals, and again up to a larger one; a trip whose earliest contact is known by then and whose probability is so near to 1
    that it is 1 as a double (digits: rounded to so many digits) is done. The others are joined as a whole. digits: probabilities
    are rounded to them, once they have been compared with min_prob. how: as for pairs().
    """

    def met(of: DataFrame, near: DataFrame) -> DataFrame:
        return with_probability(pairs(of, near, d_km=d_km, min_duration=min_duration, **how), d_km, independent)

    found: list[DataFrame] = []
    n, first, cuts = q.agg(F.count("*"), F.min("arrive_ts"), F.percentile_approx("arrive_ts", PREFIXES, 1000)).first()
    enough = -40.0 if digits is None or min_prob > 1 - 10.0**-digits else max(-40.0, math.log(0.49) - digits * math.log(10))
    many = n > 0 and min_prob <= 1 and n * p.count() > PREFIXED_FROM
    for until in sorted({c for c in cuts if c > first}) if many else []:
        before = F.col("arrive_ts") < until
        # Where seq doesn't follow arrival, what arrives before isn't the first of a trip.
        in_order = q.groupBy("trip_id").agg(F.max(F.when(before, F.col("seq"))).alias("a"), F.min(F.when(~before, F.col("seq"))).alias("b")).filter("a < b or b is null")
        part = cut(q.filter(before).join(in_order.select("trip_id"), "trip_id", "left_semi"))
        span = part.agg(F.min("arrive_ts"), F.max("leave_ts")).first()
        if span[0] is None:
            continue
        near = p.filter((F.least("leave_ts", "valid_end") > span[0]) & (F.greatest("arrive_ts", "valid_start") < span[1]))
        last = part.groupBy("trip_id").agg(F.max("seq").alias("last_i"))
        done = cut(_settled(met(part, near), last, until, min_duration, hop, enough))
        found.append(done.select("*", F.lit(hop).alias("hop"), F.lit(1.0).alias("probability")))
        q = q.join(done.select(F.col("susceptible_id").alias("trip_id")), "trip_id", "left_anti")
    if not found or not q.isEmpty():
        rest = contacts(events(runs(met(q, p)), min_duration), hop=hop, min_prob=min_prob, accept_max=accept_max)
        found.append(rest if digits is None else rest.withColumn("probability", F.round("probability", digits)))
    return reduce(DataFrame.unionByName, found)


def _slices(q: DataFrame) -> list[tuple[int, int]]:
    """Spans of time [from, to) that hold all arrivals; the first ones hold few, as most trips are settled there."""
    n, first, last, cuts = q.agg(F.count("*"), F.min("arrive_ts"), F.max("arrive_ts"), F.percentile_approx("arrive_ts", SLICES, 1000)).first()
    if not n:
        return []
    inner = sorted({c for c in cuts if first < c <= last}) if n > SLICED_FROM else []
    edges = [first, *inner, last + 1]
    return list(zip(edges[:-1], edges[1:], strict=True))


def earliest(q: DataFrame, p: DataFrame, *, min_duration: int, hop: int = 1, **how) -> DataFrame:
    """contacts(events(runs(pairs(q, p)))) without probabilities, but pairs of stays are neither written nor sorted.

    A pair that by itself lasts min_duration is a contact, at its start or before. So the least (start, validity, spreader) of such
    pairs bounds a susceptible's contact from above; it is a minimum for each trip, found slice by slice of time, where trips
    whose bound lies before a slice take no part in it. What is before the bound is a run with a shorter pair that starts
    there: only trips that meet in one are joined again, whole, and their runs numbered. how: as for pairs().
    """
    candidate = F.struct(F.col("start_ts").alias("cst"), "valid_start", "valid_end", "p_trip")
    long = F.col("end_ts") - F.col("start_ts") >= min_duration
    least = lambda found: reduce(DataFrame.unionByName, found).groupBy("q_trip").agg(F.min("best").alias("best"))
    found: list[DataFrame] = []
    parts: list[DataFrame] = []
    slices = _slices(q)
    for start, end in slices:
        part = q.filter((F.col("arrive_ts") >= start) & (F.col("arrive_ts") < end))
        if found:
            open_yet = F.col("best").isNull() | (F.col("arrive_ts") <= F.col("best.cst"))
            part = part.join(least(found).withColumnRenamed("q_trip", "trip_id"), "trip_id", "left").filter(open_yet).drop("best")
        if len(slices) > 1:
            part = cut(part)
        span = part.agg(F.min("arrive_ts"), F.max("leave_ts")).first()
        if span[0] is not None:
            near = p.filter((F.least("leave_ts", "valid_end") > span[0]) & (F.greatest("arrive_ts", "valid_start") < span[1]))
            parts.append(pairs(part, near, min_duration=min_duration, **how))
            found.append(cut(parts[-1].filter(long).groupBy("q_trip").agg(F.min(candidate).alias("best"))))
    if not parts:
        return contacts(events(runs(pairs(q, p, min_duration=min_duration, **how)), min_duration), hop=hop)
    short = reduce(DataFrame.unionByName, (x.filter(~long).select("q_trip", "start_ts", "valid_start", "valid_end", "p_trip") for x in parts))
    short = short.join(least(found), "q_trip", "left").filter(F.col("best").isNull() | (candidate < F.col("best")))
    short = cut(short.select("q_trip", "p_trip").distinct())
    if not short.isEmpty():
        trips = short.select(F.col("q_trip").alias("trip_id")).distinct()
        whole = events(runs(pairs(q.join(trips, "trip_id", "left_semi"), p, min_duration=min_duration, only=short, **how)), min_duration)
        found.append(whole.withColumn("start_ts", F.col("cst")).groupBy("q_trip").agg(F.min(candidate).alias("best")))
    return least(found).select(F.col("q_trip").alias("susceptible_id"), F.col("best.p_trip").alias("spreader_id"), F.col("best.cst").alias("cst"), F.lit(hop).alias("hop"), F.lit(1.0).alias("probability"))


def spans_overlap(a1: Column, l1: Column, a2: Column, l2: Column, least_s: int = 0) -> Column:
    """Whether two spans of time meet, ends included, and share least_s seconds at least."""
    return F.least(l1, l2) - F.greatest(a1, a2) >= least_s


def overlapping(q: DataFrame, p: DataFrame, width: int, keys: tuple[str, ...] = (), least_s: int = 0) -> DataFrame:
    """Pairs of intervals of different trips that overlap (half-open), by time bins alone; for least_s seconds at least.

    Both sides: trip_id, seq, arrive_ts, leave_ts. Out: q_trip, i, p_trip, j, overlap_s.
    """
    side = lambda x, n: x.select(
        F.col("trip_id").alias(f"{n}_trip"), F.col("seq").alias("i" if n == "q" else "j"), F.col("arrive_ts").alias(f"{n}_a"), F.col("leave_ts").alias(f"{n}_l"), *keys,
        F.explode(_bins(F.col("arrive_ts"), F.col("leave_ts"), width)).alias("bin"),
    )
    met = side(q, "q").join(side(p, "p"), ["bin", *keys]).filter(
        (F.col("q_trip") != F.col("p_trip")) & (F.col("q_a") < F.col("p_l")) & (F.col("p_a") < F.col("q_l")) & (F.col("bin") == F.floor(F.greatest("q_a", "p_a") / width))
    )
    return met.select("q_trip", "i", "p_trip", "j", (F.least("q_l", "p_l") - F.greatest("q_a", "p_a")).alias("overlap_s")).filter(F.col("overlap_s") >= least_s)


def bin_width(min_duration: int, longest: int = 0) -> int:
    """Bins of three times the least contact; wider if stays are long, so that none falls into very many."""
    return max(BIN_FACTOR * min_duration, math.ceil(longest / 16))
