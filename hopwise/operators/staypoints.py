"""Stay-point detection on raw positions: a walk along each trip, which holds no more than the anchor and sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hopwise.functions.geo import EARTH_RADIUS_KM
from hopwise.plans.workers import importable

STAYS = pa.schema([("seq", pa.int32()), ("lng", pa.float64()), ("lat", pa.float64()), ("arrive_ts", pa.int64()), ("leave_ts", pa.int64())])


def _apart(lng1: float, lat1: float, lng2: float, lat2: float) -> float:
    """The distance in km, as hopwise.functions.geo.haversine()."""
    if lng1 == lng2 and lat1 == lat2:
        return 0.0
    a, b = math.radians(lng1) - math.radians(lng2), math.radians(lat1) - math.radians(lat2)
    h = math.sin(b / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(a / 2) ** 2
    return math.floor(2 * EARTH_RADIUS_KM * math.asin(math.sqrt(h)) * 100000.0 + 0.5) / 100000.0


class Walk:
    """One trip's positions in order; gives its stays one by one."""

    def __init__(self, distance_km: float, min_seconds: int):
        self.distance_km, self.min_seconds = distance_km, min_seconds
        self.seen, self.made = 0, 0
        self.first = self.anchor = self.last = (0, 0.0, 0.0)
        self.lng = self.lat = 0.0
        self.held = 0

    def _stay(self, lng: float, lat: float, arrive: int, leave: int) -> tuple:
        self.made += 1
        return self.made - 1, lng, lat, arrive, leave

    def step(self, ts: int, lng: float, lat: float) -> Iterator[tuple]:
        """The position after the last one: it is the last no more, so it can be judged as one in between."""
        if self.seen == 1:
            yield self._stay(self.first[1], self.first[2], self.first[0], ts)
        if self.seen >= 2:
            yield from self._judge(False)
        self.last = (ts, lng, lat)
        if self.seen == 0:
            self.first = self.last
        elif self.seen == 1:
            self._hold(self.last)
        self.seen += 1

    def _hold(self, position: tuple) -> None:
        self.anchor, self.lng, self.lat, self.held = position, position[1], position[2], 1

    def _judge(self, is_last: bool) -> Iterator[tuple]:
        """Position last, the third or a later one, against the anchor, the second or a later one."""
        if self.seen < 3:
            return
        ts, lng, lat = self.last
        self.lng, self.lat, self.held = self.lng + lng, self.lat + lat, self.held + 1
        if is_last or _apart(self.anchor[1], self.anchor[2], lng, lat) > self.distance_km:
            if ts - self.anchor[0] > self.min_seconds:
                yield self._stay(self.lng / self.held, self.lat / self.held, self.anchor[0], ts)
            self._hold(self.last)

    def end(self) -> Iterator[tuple]:
        if self.seen == 1:
            yield self._stay(self.first[1], self.first[2], self.first[0], self.first[0])
        elif self.seen > 1:
            yield from self._judge(True)
            yield self._stay(self.last[1], self.last[2], self.last[0], self.last[0])


def stay_points(points: DataFrame, distance_km: float = 0.2, min_seconds: int = 1800) -> DataFrame:
    """trip_id, seq, lng, lat, arrive_ts, leave_ts. points: trip_id, ts, lng, lat, and event_id to break ties.

    The first and last positions are stays. In between, an anchor holds until a position is farther
    than distance_km, or the last; if more than min_seconds have passed by then, the mean of the
    positions from the anchor to that one, which is included, is a stay, and that one is the next anchor.

    A trip's positions come sorted and are read as a stream, so a very long trip takes time but no memory.
    """
    importable(points.sparkSession)
    kind = points.schema["trip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip, walk = None, None
        for batch in batches:
            trips, out = [], []
            for now, ts, lng, lat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if walk is None or now != trip:
                    ended = [*walk.end()] if walk else []
                    trips += [trip] * len(ended)
                    out += ended
                    trip, walk = now, Walk(distance_km, min_seconds)
                stays = [*walk.step(ts, lng, lat)]
                trips += [trip] * len(stays)
                out += stays
            yield made(trips, out, batch.schema.field(0).type)
            kept = batch.schema.field(0).type
        if walk:
            last = [*walk.end()]
            yield made([trip] * len(last), last, kept)

    def made(trips: list, stays: list[tuple], trip_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*stays, strict=True)) if stays else [[]] * len(STAYS)
        return pa.RecordBatch.from_arrays([pa.array(trips, trip_type), *(pa.array(c, f.type) for c, f in zip(columns, STAYS, strict=True))], names=["trip_id", *STAYS.names])

    rows = points.selectExpr("trip_id", "cast(ts as long) ts", "cast(lng as double) lng", "cast(lat as double) lat", "event_id")
    in_order = rows.repartition("trip_id").sortWithinPartitions("trip_id", "ts", "event_id", "lng", "lat").drop("event_id")
    return in_order.mapInArrow(run, f"trip_id {kind}, seq int, lng double, lat double, arrive_ts long, leave_ts long")
