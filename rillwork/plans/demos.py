"""Whole pipelines: a request dashboard, travel premiums and a portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import ordered, relational
from .graph import Cell, Runtime
from .incremental import Source

#: Events in the dashboard's rolling window; a request is slow above so many ms, an error from this status on.
RECENT, SLOW_MS, ERROR_STATUS = 200, 500, 400


def rolling_dashboard(events: DataFrame, order: str, error: Column, value: Column, size: int = RECENT) -> DataFrame:
    """For each event the errors, the count and the sum of values among the last ``size`` events."""
    return ordered.rolling(events, [order], size, {
        "recent_errors": F.sum(F.when(error, 1).otherwise(0)),
        "recent_count": F.count("*"),
        "recent_total": F.sum(value),
    })


def user_health(events: DataFrame) -> DataFrame:
    """A health status for each user from the share of error events and the mean value."""
    by_user = events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("err"),
        F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return by_user.select("user_id", scalar.health(F.col("err"), F.col("total"), F.col("n")).alias("health"))


class Dashboard:
    """Requests as a collection; counts, rates and health as cells that are computed when read."""

    SCHEMA = "id long, ts long, method string, endpoint string, status int, latency int"

    def __init__(self, runtime: Runtime):
        self.runtime = runtime
        self.requests = Source(runtime, self.SCHEMA, ["id"], "requests")
        self.total: Cell = self.requests.count("total")
        self.errors: Cell = self.requests.filter(F.col("status") >= ERROR_STATUS).count("errors")
        self.slow: Cell = self.requests.filter(F.col("latency") > SLOW_MS).count("slow")
        self.latency: Cell = self.requests.sum("latency", "latency")
        self.error_rate = runtime.create_query(lambda rt: 100 * rt.get(self.errors) / max(rt.get(self.total), 1), "error rate")
        self.mean_latency = runtime.create_query(lambda rt: rt.get(self.latency) / max(rt.get(self.total), 1), "mean latency")
        self.health = runtime.create_query(self._health, "health")

    def _health(self, rt: Runtime) -> str:
        rate = rt.get(self.error_rate)
        if rate < 5 and rt.get(self.mean_latency) < 300:
            return "healthy"
        return "degraded" if rate < 15 else "critical"


class TravelDay:
    """A day's visits as a collection, the trips between them by time, and the day's premium up to its cap. A visit is its id: it moves by delete and insert."""

    SCHEMA = "id long, client_name string, address string, time double, duration_mins int, lat double, lng double"

    def __init__(self, runtime: Runtime):
        self.runtime = runtime
        self.visits = Source(runtime, self.SCHEMA, ["id"], "visits")
        pairs = self.visits.sort_by_key("time", "id").pairwise()
        km = scalar.haversine_km(F.col("left.lat"), F.col("left.lng"), F.col("right.lat"), F.col("right.lng"))
        self.trips = pairs.map(F.col("left.id").alias("from_id"), F.col("right.id").alias("to_id"), km.alias("distance_km"), scalar.travel_premium(km).alias("premium"))
        self.km: Cell = self.trips.sum("distance_km", "distance")
        self.uncapped: Cell = self.trips.sum("premium", "premium")
        self.premium = runtime.create_query(lambda rt: min(rt.get(self.uncapped), scalar.DAILY_CAP), "capped premium")

    def move(self, visit: dict, time: float) -> None:
        self.visits.delete(visit)
        self.visits.insert(visit | {"time": time})


def travel_segments(visits: DataFrame, by: list[str]) -> DataFrame:
    """Trips between consecutive visits of a day (``by``), ordered by time then id, with distance and premium.

    ``visits``: id, time, lat, lng."""
    w = Window.partitionBy(*by).orderBy("time", "id")
    nxt = {f"_{c}": F.lead(c).over(w) for c in ("id", "lat", "lng")}
    km = scalar.haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    pairs = visits.withColumns(nxt).where("_id is not null").withColumn("distance_km", km)
    return pairs.select(*by, F.col("id").alias("from_id"), F.col("_id").alias("to_id"), "distance_km", scalar.travel_premium(F.col("distance_km")).alias("premium"))


def daily_premiums(segments: DataFrame, by: list[str]) -> DataFrame:
    return segments.groupBy(*by).agg(scalar.capped_sum(F.col("premium")).alias("premium"))


def best_performer(positions: DataFrame, price: Column, initial: Column, by: list[str] | None = None) -> DataFrame:
    """The greatest change since the start in percent, -Infinity over nothing."""
    change = (price - initial) / initial * 100
    return positions.groupBy(*by or []).agg(F.coalesce(F.max(change), F.lit(float("-inf"))).alias("best"))


class Portfolio:
    """Prices as cells; positions, their totals and the best performer as queries that run again only if a price they read has changed."""

    def __init__(self, runtime: Runtime, stocks: list[tuple[str, float, float, float, str]]):
        """``stocks``: symbol, price, initial price, shares, sector."""
        self.runtime = runtime
        self.prices = {s: runtime.create_input(p, f"{s} price") for s, p, *_ in stocks}
        self.positions = {s: runtime.create_query(lambda rt, s=s, n=n: rt.get(self.prices[s]) * n, f"{s} position") for s, _, _, n, _ in stocks}
        total = lambda names: lambda rt: sum(rt.get(self.positions[s]) for s in names)
        self.total = runtime.create_query(total([s for s, *_ in stocks]), "total")
        self.sectors = {k: runtime.create_query(total([s for s, *_, x in stocks if x == k]), k) for k in dict.fromkeys(x for *_, x in stocks)}
        self.best = runtime.create_query(lambda rt: max(((rt.get(self.prices[s]) - i) / i * 100 for s, _, i, *_ in stocks), default=float("-inf")), "best performer")


def portfolio(positions: DataFrame, value: Column, small: Column) -> DataFrame:
    """The total value, and that of the positions that ``small`` picks, added as decimals."""
    exact = value.cast("decimal(18,2)")
    return relational.reduce(positions, total_value=F.sum(exact).cast("double"), small_value=F.sum(F.when(small, exact).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double"))
