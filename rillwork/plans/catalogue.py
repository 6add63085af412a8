"""The queries of the engine's own operators, built from these operators, and the same in DuckDB SQL."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import formula, scalar
from ..operators import ordered, relational
from ..operators.zset import expand
from ..sources.changelog import effective_deltas
from ..sources.storage import shared_dir
from ..sources.tables import KeyedTable
from ..streaming.runner import EpochRunner, Gauge, read_op_stream
from . import demos
from .graph import QueryFailed, Runtime
from .incremental import Collection, Follower, Source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its SQL."""
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set by event_id, so what keeps that column needs no shuffle to be a set."""
    return table(spark, sf_dir, "events")


def micros(c: str) -> F.Column:
    """Microseconds of a time without a zone, taken as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


NOT_ERROR = "event_type <> 'error'"


# --- sources and change logs


@query("SELECT DISTINCT user_id, event_type FROM events")
def set_source(spark, sf_dir):
    return relational.source(events(spark, sf_dir).select("user_id", "event_type"))


@query("""SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t
WHERE rn = 1 AND event_type <> 'error'""")
def set_state_last_op_wins(spark, sf_dir):
    ops = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return relational.last_op_wins(ops, ["user_id"], "event_id", NOT_ERROR).select("user_id")


@query("""WITH ops AS (SELECT event_id, user_id, CASE WHEN event_type='error' THEN 0 ELSE 1 END AS present FROM events),
lagged AS (SELECT *, COALESCE(lag(present) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS prev FROM ops)
SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS version, user_id, CAST(CASE WHEN present=1 THEN 1 ELSE -1 END AS BIGINT) AS weight
FROM lagged WHERE present <> prev""")
def effective_delta_log(spark, sf_dir):
    ops = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return effective_deltas(ops, ["user_id"], "event_id", NOT_ERROR).select("version", "user_id", F.col("__w").alias("weight"))


# --- filter and map


@query("SELECT DISTINCT event_id, user_id, event_type, value FROM events WHERE event_type='purchase' AND value > 10.0", "filter")
def filter_purchases(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    return relational.filter_set(rows, (F.col("event_type") == "purchase") & (F.col("value") > 10.0), distinct=False)


@query("SELECT DISTINCT event_id, user_id FROM events WHERE user_id % 7 = 3")
def filter_python(spark, sf_dir):
    """A Python predicate, in Arrow batches."""
    return relational.filter_set(events(spark, sf_dir).select("event_id", "user_id"), lambda r: r["user_id"] % 7 == 3, distinct=False)


@query("SELECT event_id, value * 2 AS twice FROM events WHERE user_id % 7 = 3 AND value > 20")
def python_by_series(spark, sf_dir):
    """A Python predicate and a Python image of many rows at once."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "value")
    kept = relational.filter_set(rows, relational.by_series(lambda df: (df["user_id"] % 7 == 3) & (df["value"] > 20)), distinct=False)
    return relational.map_python(kept, relational.by_series(lambda df: df[["event_id"]].assign(twice=df["value"] * 2)), "event_id long, twice double")


def buckets(spark, sf_dir) -> DataFrame:
    return relational.map_bag(events(spark, sf_dir), (F.col("user_id") % 10).alias("bucket"))


QUERIES["map_bag"] = buckets
ORACLE_SQL["map_bag"] = "SELECT user_id % 10 AS bucket FROM events"


@query("SELECT user_id % 10 AS bucket, event_id * 2 AS twice FROM events")
def map_python(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id")
    return relational.map_python(rows, lambda r: (r["user_id"] % 10, r["event_id"] * 2), "bucket long, twice long")


@query("SELECT DISTINCT user_id % 10 AS bucket FROM events")
def map_elements(spark, sf_dir):
    return relational.source(buckets(spark, sf_dir))


@query("SELECT DISTINCT d FROM (SELECT user_id % 10 * 2 AS d, value FROM events WHERE value > 10 AND value < 60) t WHERE d < 9")
def chained_filter_map(spark, sf_dir):
    rows = events(spark, sf_dir).where("value > 10").where("value < 60")
    return relational.filter_set(relational.map_bag(rows, (F.col("user_id") % 10 * 2).alias("d")), "d < 9")


# --- aggregates


@query("SELECT count(*) AS n FROM (SELECT user_id % 10 AS b FROM events) t")
def count_bag(spark, sf_dir):
    return relational.count(buckets(spark, sf_dir))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT b FROM (SELECT user_id % 10 AS b FROM events) t WHERE b < 5) u")
def count_after_map_filter_set(spark, sf_dir):
    return relational.count(relational.filter_set(buckets(spark, sf_dir), "bucket < 5"))


@query("SELECT CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS max_value, min(value) AS min_value, count(*) AS n FROM events")
def reduce_sum_max(spark, sf_dir):
    return relational.reduce(events(spark, sf_dir), total=F.sum(F.col("value").cast("decimal(18,2)")).cast("double"),
                             max_value=F.max("value"), min_value=F.min("value"), n=F.count("*"))


@query("SELECT CAST(0 AS BIGINT) AS total, CAST(NULL AS DOUBLE) AS max_value, count(*) AS n FROM events WHERE value < 0")
def reduce_empty(spark, sf_dir):
    none = events(spark, sf_dir).where("value < 0")
    return relational.reduce(none, total=relational.total("user_id"), max_value=F.max("value"), n=F.count("*"))


@query("""SELECT event_type, least(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), CAST(50 AS DOUBLE)) AS capped,
CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / greatest(count(*), 1) AS mean FROM events GROUP BY event_type""")
def capped_and_mean(spark, sf_dir):
    exact = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    by = events(spark, sf_dir).groupBy("event_type")
    return by.agg(F.least(exact, F.lit(scalar.DAILY_CAP)).alias("capped"), scalar.ratio(exact, F.count("*")).alias("mean"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, least(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), CAST(50 AS DOUBLE)) AS capped,
CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / greatest(count(*), 1) AS mean FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def capped_by_user_and_day(spark, sf_dir):
    exact = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    by = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day"))
    return by.agg(F.least(exact, F.lit(scalar.DAILY_CAP)).alias("capped"), scalar.ratio(exact, F.count("*")).alias("mean"))


# --- order


@query("SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) - 1 AS idx, event_id FROM events")
def sort_entries(spark, sf_dir):
    return ordered.entries(events(spark, sf_dir).select("event_id", "ts"), ["ts", "event_id"]).select("idx", "event_id")


@query("SELECT CAST(row_number() OVER (ORDER BY value DESC, event_id) AS BIGINT) - 1 AS idx, event_id FROM events")
def sort_descending(spark, sf_dir):
    return ordered.entries(events(spark, sf_dir).select("event_id", "value"), [ordered.desc("value"), "event_id"]).select("idx", "event_id")


PAIRS = "SELECT event_id AS left_id, nxt AS right_id FROM (SELECT event_id, lead(event_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) t WHERE nxt IS NOT NULL"


@query(PAIRS)
def pairwise(spark, sf_dir):
    found = ordered.pairwise(events(spark, sf_dir).select("event_id", "ts"), ["ts"], ["event_id"], unique=True)
    return found.select(F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


WINDOWS = """SELECT event_id AS w0, w1, w2 FROM (SELECT event_id, lead(event_id,1) OVER (ORDER BY ts, event_id) AS w1, lead(event_id,2) OVER (ORDER BY ts, event_id) AS w2 FROM events) t
WHERE w2 IS NOT NULL"""


@query(WINDOWS)
def window3(spark, sf_dir):
    found = ordered.window(events(spark, sf_dir).select("event_id", "ts"), ["ts"], 3, ["event_id"], unique=True)
    return found.select(*[F.col("window")[k]["event_id"].alias(f"w{k}") for k in range(3)])


@query("""SELECT event_id, CAST(sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_errors,
count(*) OVER (ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS recent_count FROM events""")
def rolling_200(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    return demos.rolling_dashboard(rows, "event_id", F.col("event_type") == "error", F.col("value")).select("event_id", "recent_errors", "recent_count")


# --- groups


@query("SELECT event_type AS k, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) t GROUP BY event_type")
def group_sizes(spark, sf_dir):
    return relational.group_sizes(events(spark, sf_dir).select("event_id", "event_type"), "event_type", unique=True)


@query("SELECT DISTINCT event_type AS k FROM events")
def group_keys(spark, sf_dir):
    return relational.group_keys(events(spark, sf_dir), "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_type IS NOT DISTINCT FROM 'purchase'")
def get_group(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    return relational.get_group(rows, "event_type", "purchase", unique=True).select("event_id", "user_id")


@query("""SELECT event_type, event_id AS left_id, nxt AS right_id FROM (SELECT event_type, event_id, lead(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM events) t
WHERE nxt IS NOT NULL""")
def group_pairwise(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", "event_id", "ts")
    found = ordered.pairwise(rows, ["ts"], ["event_id"], by=["event_type"], unique=True)
    return found.select("event_type", F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


# --- joins


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def join_pairs(spark, sf_dir):
    left, right = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey")
    return relational.join(left, right, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey")


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON (n_nationkey % 5) IS NOT DISTINCT FROM (r_regionkey % 5)")
def join_computed_key(spark, sf_dir):
    left, right = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey")
    return relational.join(left, right, F.col("n_nationkey") % 5, F.col("r_regionkey") % 5)


@query("""SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey IS NOT DISTINCT FROM n_nationkey
JOIN region ON n_regionkey IS NOT DISTINCT FROM r_regionkey GROUP BY r_name""")
def join_count_by_region(spark, sf_dir):
    places = relational.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey")
    found = relational.join(table(spark, sf_dir, "customer").select("c_nationkey"), places, "c_nationkey", "n_nationkey")
    return found.groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return relational.join(rows.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ka")), rows.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("kb")), "ka", "kb").select("a", "b")


# --- pipelines

GAPS = """SELECT user_id, CAST(sum(gap_us) AS BIGINT) AS total_gap_us FROM
(SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap_us FROM events) t WHERE gap_us IS NOT NULL GROUP BY user_id"""


@query(GAPS)
def pipeline_sort_pairwise_map_reduce(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", micros("ts").alias("us"))
    pairs = ordered.pairwise(rows, ["us"], ["event_id"], by=["user_id"], unique=True)
    gaps = relational.map_bag(pairs, "user_id", (F.col("right.us") - F.col("left.us")).alias("gap"))
    return gaps.groupBy("user_id").agg(F.sum("gap").alias("total_gap_us"))


@query("SELECT concat(CAST(count(*) AS VARCHAR(20)), ' high values') AS label FROM events WHERE value >= 90")
def unified_label(spark, sf_dir):
    """A scalar query that reads a collection's count."""
    rt = Runtime(spark)
    high = rt.create_input(90)
    counted = rt.create_query(lambda r: relational.count(events(spark, sf_dir).where(F.col("value") >= r.get(high))))
    label = rt.create_query(lambda r: r.get(counted).select(F.concat(F.col("n").cast("string"), F.lit(" high values")).alias("label")))
    return rt.get(label)


# --- scalar functions and formulas


@query("""SELECT event_id, CAST(CASE WHEN value <= 5.0 THEN CAST(0 AS DOUBLE) WHEN value <= 20.0 THEN (value - 5) * CAST(0.45 AS DOUBLE)
ELSE CAST(6.75 AS DOUBLE) + (value - 20) * CAST(0.65 AS DOUBLE) END AS DOUBLE) AS premium FROM events""")
def premium_tiers(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", scalar.travel_premium(F.col("value")).alias("premium"))


@query("""SELECT user_id, CASE WHEN err * 100 < 5 * n AND total < 300 * n THEN 'healthy' WHEN err * 100 < 15 * n THEN 'degraded' ELSE 'critical' END AS health
FROM (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS err, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY user_id) t""")
def health_status(spark, sf_dir):
    return demos.user_health(events(spark, sf_dir))


@query("""SELECT CAST(sum(CAST(l_quantity * p_size AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
CAST(sum(CASE WHEN p_size <= 10 THEN CAST(l_quantity * p_size AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS small_value FROM lineitem JOIN part ON l_partkey = p_partkey""")
def portfolio(spark, sf_dir):
    lines, parts = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    held = relational.join(lines, parts, "l_partkey", "p_partkey")
    return demos.portfolio(held, F.col("l_quantity") * F.col("p_size"), F.col("p_size") <= 10)


@query("""SELECT n_nationkey, r_regionkey, CAST(round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 6) AS DOUBLE) AS km FROM (
SELECT n_nationkey, r_regionkey, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2) AS a FROM (
SELECT n_nationkey, r_regionkey, n_nationkey * 3.0 - 30 AS lat1, n_nationkey * 7.0 AS lng1, r_regionkey * 11.0 AS lat2, r_regionkey * -13.0 AS lng2 FROM nation JOIN region ON n_regionkey = r_regionkey) t) u""")
def haversine(spark, sf_dir):
    places = relational.join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey")
    n, r = F.col("n_nationkey").cast("double"), F.col("r_regionkey").cast("double")
    km = scalar.haversine_km(n * 3 - 30, n * 7, r * 11, r * -13)
    return places.select("n_nationkey", "r_regionkey", F.round(km, 6).alias("km"))


@query("""SELECT s_suppkey, CAST(round_even(s_acctbal / 100, 3) AS DOUBLE) AS place FROM supplier""")
def coordinate_rounding(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.bround(F.col("s_acctbal") / 100, 3).alias("place"))


def grid(**columns: str) -> dict[str, str]:
    return columns


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE p_retailprice / (p_size % 10) END AS ratio,
CASE WHEN p_size > 25 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS gt FROM part""")
def formula_div_if(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("digit", F.col("p_size") % 10)
    cells = grid(A1="p_retailprice", B1="digit", C1="p_size")
    return parts.select("p_partkey", formula.compile_formula("=A1 / B1", cells).alias("ratio"), formula.compile_formula("=IF(C1 > 25, 1, 0)", cells).alias("gt"))


@query("""SELECT p_partkey, p_size + p_retailprice + 2.0 AS total, (p_size + p_retailprice + 2.0) / 3 AS mean, least(p_size, p_retailprice, 2.0) AS low, greatest(p_size, p_retailprice, 2.0) AS high,
CAST(CASE WHEN p_size = 7 THEN 1 ELSE 0 END AS DOUBLE) AS is7, CAST(-(p_size * 2.0 - 3) AS DOUBLE) AS neg FROM
(SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) t""")
def formula_ranges(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("two", F.lit(2.0))
    cells = grid(A1="p_size", B1="p_retailprice", A2="two")
    f = lambda text: formula.compile_formula(text, cells)
    return parts.select("p_partkey", f("=SUM(A1:B1, A2)").alias("total"), f("=AVG(A1:B1, A2)").alias("mean"), f("=MIN(A1:B1, A2)").alias("low"),
                        f("=MAX(B1:A1, A2)").alias("high"), f("=A1 = 7").alias("is7"), f("=-(A1 * 2 - 3)").alias("neg"))


@query("SELECT CAST(sum(v) AS DOUBLE) AS total, CAST(avg(v) AS DOUBLE) AS mean, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high FROM (SELECT unnest([p_size, p_size * 2]) AS v FROM part) t")
def grid_aggregates(spark, sf_dir):
    """Range functions over a grid with a row for each cell."""
    sheet = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_size").cast("double").alias("A"), (F.col("p_size") * 2).cast("double").alias("B"))
    cells = sheet.unpivot("row", ["A", "B"], "column", "value")
    return relational.reduce(cells, total=F.sum("value"), mean=F.avg("value"), low=F.min("value"), high=F.max("value"))


# --- the same by deltas: the table comes in several epochs, with rows that go again, and each epoch is read


def replay(spark: SparkSession, rows: DataFrame, key: str, build: Callable[[Source], Collection], epochs: int = 3, each: Callable[[Runtime, Collection], object] | None = None) -> Collection:
    """A source that gets ``rows`` in epochs by their key, too many at first: the next epoch deletes what the last had too early."""
    rt = Runtime(spark)
    source = Source(rt, rows.schema, [key])
    target = build(source)
    read = each or (lambda rt, target: rt.get(target.version_node))
    part = F.pmod(F.xxhash64(key), F.lit(epochs))
    for e in range(epochs):
        early = (part == e + 1) & (F.col(key) % 3 == 0) if e + 1 < epochs else F.lit(False)
        source.load(rows.where((part == e) | early))
        read(rt, target)
        if e + 1 < epochs:
            source.remove(rows.where(early))
            read(rt, target)
    return target


@query(ORACLE_SQL["filter"])
def delta_filter(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    return replay(spark, rows, "event_id", lambda s: s.filter("event_type = 'purchase' and value > 10.0")).elements()


@query(ORACLE_SQL["map_bag"])
def delta_map_bag(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id")
    return replay(spark, rows, "event_id", lambda s: s.map((F.col("user_id") % 10).alias("bucket"))).rows()


@query("SELECT DISTINCT b AS bucket FROM (SELECT user_id % 10 AS b FROM events) t WHERE b < 5")
def delta_filter_over_bag(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id")
    return replay(spark, rows, "event_id", lambda s: s.map((F.col("user_id") % 10).alias("bucket")).filter("bucket < 5")).elements()


@query(ORACLE_SQL["count_bag"])
def delta_count(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id")
    cells: list = []

    def build(s: Source) -> Collection:
        bag = s.map((F.col("user_id") % 10).alias("bucket"))
        cells.append(bag.count())
        return bag

    rt = replay(spark, rows, "event_id", build, each=lambda rt, _: rt.get(cells[0])).runtime
    return spark.createDataFrame([(rt.get(cells[0]),)], "n long")


@query(ORACLE_SQL["reduce_sum_max"])
def delta_reduce(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("value").cast("decimal(18,2)").alias("d"), "value")
    cells: list = []

    def build(s: Source) -> Collection:
        cells.extend([s.sum("d"), s.max("value"), s.min("value"), s.count()])
        return s

    rt = replay(spark, rows, "event_id", build).runtime
    total, high, low, n = (rt.get(c) for c in cells)
    return spark.createDataFrame([(float(total), high, low, n)], "total double, max_value double, min_value double, n long")


@query(ORACLE_SQL["group_sizes"])
def delta_group_sizes(spark, sf_dir):
    return replay(spark, events(spark, sf_dir).select("event_id", "event_type"), "event_id", lambda s: s.group_by("event_type")).sizes()


@query(PAIRS)
def delta_pairwise(spark, sf_dir):
    found = replay(spark, events(spark, sf_dir).select("event_id", "ts"), "event_id", lambda s: s.sort_by_key("ts", "event_id").pairwise()).elements()
    return found.select(F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query(WINDOWS)
def delta_window3(spark, sf_dir):
    found = replay(spark, events(spark, sf_dir).select("event_id", "ts"), "event_id", lambda s: s.sort_by_key("ts", "event_id").window(3)).elements()
    return found.select(*[F.col("window")[k]["event_id"].alias(f"w{k}") for k in range(3)])


@query(ORACLE_SQL["sort_entries"])
def delta_sort_entries(spark, sf_dir):
    target = replay(spark, events(spark, sf_dir).select("event_id", "ts"), "event_id", lambda s: s)
    return target.sort_by_key("ts", "event_id").entries().select("idx", "event_id")


@query(ORACLE_SQL["join_pairs"])
def delta_join(spark, sf_dir):
    right = table(spark, sf_dir, "customer").select("c_custkey")

    def build(s: Source) -> Collection:
        other = Source(s.runtime, right.schema)
        other.load(right.where("c_custkey % 2 = 0"))
        joined = s.join(other, "o_custkey", "c_custkey")
        s.runtime.get(joined.version_node)
        other.load(right)
        return joined

    found = replay(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", build).rows()
    return found.select("left.o_orderkey", "right.c_custkey")


@query(GAPS)
def delta_pipeline(spark, sf_dir):
    """Sort, pairwise, map and group by deltas, then a sum for each user."""
    rows = events(spark, sf_dir).select("event_id", "user_id", micros("ts").alias("us"))

    def build(s: Source) -> Collection:
        pairs = s.group_by("user_id").sort_by_key("us", "event_id").pairwise()
        return pairs.map(F.col("left.user_id").alias("user_id"), (F.col("right.us") - F.col("left.us")).alias("gap"))

    return expand(replay(spark, rows, "event_id", build).state()).groupBy("user_id").agg(F.sum("gap").alias("total_gap_us"))


@query(ORACLE_SQL["filter"])
def delta_retry(spark, sf_dir):
    """Each epoch is lost once after its work is done, as with an executor, and read again."""
    lost: set[int] = set()

    def build(s: Source) -> Collection:
        target = s.filter("event_type = 'purchase' and value > 10.0")
        work = target._change

        def change(d):
            done = work(d)
            if s.version not in lost:
                lost.add(s.version)
                raise OSError("an executor is lost")
            return done

        target._change = change
        return target

    def read(rt: Runtime, target: Collection) -> None:
        try:
            rt.get(target.version_node)
        except QueryFailed:
            rt.get(target.version_node)

    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    return replay(spark, rows, "event_id", build, each=read).elements()


@query("SELECT sum(floor(value * 4) / 4) AS total, sum(floor(value * 4) / 4) / count(*) AS mean, max(floor(value * 4) / 4) AS high FROM events")
def delta_sum_doubles(spark, sf_dir):
    """Doubles that swallow others, infinities and NaN come and go; what stays adds up exactly."""
    rows = events(spark, sf_dir).select("event_id", (F.floor(F.col("value") * 4) / F.lit(4.0)).alias("x"))
    cells: list = []

    def build(s: Source) -> Collection:
        cells.extend([s.sum("x"), s.avg("x"), s.max("x")])
        odd = spark.createDataFrame([(-1, 1e17), (-2, float("inf")), (-3, float("nan")), (-4, -1e300)], "event_id long, x double")
        s.load(odd)
        cells.append(odd)
        return s

    def read(rt: Runtime, target: Collection) -> None:
        for c in cells[:3]:
            rt.get(c)

    target = replay(spark, rows, "event_id", build, each=read)
    target.remove(cells[3])
    return spark.createDataFrame([tuple(target.runtime.get(c) for c in cells[:3])], "total double, mean double, high double")


@query(ORACLE_SQL["sort_entries"])
def delta_sort_feed(spark, sf_dir):
    """A list that only follows the changes by position."""
    feeds, lists = [], []

    def build(s: Source) -> Collection:
        feeds.append(s.sort_by_key("ts", "event_id").feed())
        lists.append(Follower(spark, s.schema))
        return s

    replay(spark, events(spark, sf_dir).select("event_id", "ts"), "event_id", build, each=lambda rt, _: lists[0].take(feeds[0].poll()))
    return lists[0].rows().select("idx", "event_id")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def delta_self_join(spark, sf_dir):
    """A collection joined with itself, while it changes."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    found = replay(spark, rows, "n_nationkey", lambda s: s.join(s, "n_regionkey", "n_regionkey")).rows()
    return found.select(F.col("left.n_nationkey").alias("a"), F.col("right.n_nationkey").alias("b"))


@query("SELECT CAST(sum(n_nationkey * n_regionkey) AS BIGINT) AS folded, count(*) AS n FROM nation WHERE n_nationkey % 3 > 0")
def delta_fold(spark, sf_dir):
    """A Python function of all rows, read after each change."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long"))
    cells: list = []

    def build(s: Source) -> Collection:
        some = s.filter("n_nationkey % 3 > 0")
        cells.append(some.fold(lambda rows: (sum(r["n_nationkey"] * r["n_regionkey"] for r in rows), len(rows))))
        return some

    rt = replay(spark, rows, "n_nationkey", build, each=lambda rt, _: rt.get(cells[0])).runtime
    return spark.createDataFrame([rt.get(cells[0])], "folded long, n long")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey <> 0 AND n_nationkey / n_regionkey > 5")
def failing_predicate(spark, sf_dir):
    """A Python predicate that raises for some rows, which counts as no; without that the query fails."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rt = Runtime(spark)
    s = Source(rt, rows.schema, ["n_nationkey"])
    share = lambda r: int(r["n_nationkey"]) / int(r["n_regionkey"]) > 5
    kept, strict = s.filter(share, errors="false"), s.filter(share)
    s.load(rows)
    try:
        rt.get(strict.version_node)
    except QueryFailed:
        return kept.elements().select("n_nationkey")
    raise AssertionError("a failure was lost")


@query("SELECT p_brand, max((p_retailprice - (p_size + 1000)) / (p_size + 1000) * 100) AS best FROM part GROUP BY p_brand")
def best_performer(spark, sf_dir):
    return demos.best_performer(table(spark, sf_dir, "part"), F.col("p_retailprice"), (F.col("p_size") + 1000).cast("double"), ["p_brand"])


@query("SELECT sum(s_acctbal_2 * (s_suppkey % 7 + 1)) AS total, max((s_acctbal_2 - 100) / 100 * 100) AS best FROM (SELECT s_suppkey, floor(s_acctbal) AS s_acctbal_2 FROM supplier)")
def portfolio_cells(spark, sf_dir):
    """Prices that change one after the other, as cells."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").cast("double").alias("p")).collect()  # a price for each stock: the cells are on the driver
    rt = Runtime(spark)
    held = demos.Portfolio(rt, [(str(r["s_suppkey"]), 50.0, 100.0, r["s_suppkey"] % 7 + 1, "odd" if r["s_suppkey"] % 2 else "even") for r in rows])
    rt.get(held.total)
    for r in rows:
        rt.set(held.prices[str(r["s_suppkey"])], r["p"])
    if rt.get(held.total) != sum(rt.get(c) for c in held.sectors.values()):
        raise AssertionError("the sectors are not the total")
    return spark.createDataFrame([(rt.get(held.total), rt.get(held.best))], "total double, best double")


@query("SELECT count(*) AS changes, count(*) / 1.5 AS rate FROM events")
def throughput(spark, sf_dir):
    """The gauge of a stream's epochs, half a second each."""
    rt = Runtime(spark)
    gauge = Gauge(rt)
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for r in events(spark, sf_dir).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect():
        gauge.add(r["n"], 0.5)
    return spark.createDataFrame([(rt.get(gauge.changes), rt.get(gauge.rate))], "changes long, rate double")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'moved' ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey
FROM customer WHERE c_custkey % 5 <> 0""")
def keyed_table(spark, sf_dir):
    """Loaded, upserted, deleted from, with a batch that comes twice, and compacted."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    held = KeyedTable(spark, shared_dir(spark), "c_custkey long, c_name string, c_nationkey int", ["c_custkey"])
    moved = rows.where("c_custkey % 4 = 0").select("c_custkey", F.lit("moved").alias("c_name"), F.col("c_nationkey") + 100)
    held.upsert(rows.where("c_custkey % 3 > 0"), epoch=0)
    held.upsert(rows.where("c_custkey % 3 = 0"), epoch=1)
    held.upsert(moved.toDF("c_custkey", "c_name", "c_nationkey"), epoch=2)
    held.compact()
    held.upsert(rows.where("c_custkey % 4 = 0"), epoch=2)  # again: nothing happens
    held.delete(rows.where("c_custkey % 5 = 0"), epoch=3)
    return held.rows()


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY user_id""")
def stream_of_ops(spark, sf_dir):
    """Files of ops as a stream, in epochs, with deletes of what came before, and a restart from the log in between."""
    base, rows = shared_dir(spark), events(spark, sf_dir).select("event_id", "user_id")
    inserts = rows.select(F.lit("insert").alias("op"), F.col("event_id").alias("id"), "user_id", F.lit(1).cast("long").alias("seq"))
    schema, out = inserts.schema, None
    for step in range(2):
        some = inserts.where(F.col("id") % 2 == step) if step else inserts.where("id % 2 = 0").unionByName(inserts.where("id % 10 = 1"))
        some.write.mode("append").parquet(f"{base}/ops")
        if step:
            inserts.where("id % 10 = 1").withColumns({"op": F.lit("delete"), "seq": F.lit(0).cast("long")}).write.mode("append").parquet(f"{base}/ops")
        runner = EpochRunner(spark, StructType([f for f in schema.fields if f.name in ("id", "user_id")]), f"{base}/log", lambda rt, s: {"source": s}, lambda e, t: t["source"].state(), key=["id"])
        runner.start(read_op_stream(spark, f"{base}/ops", schema), f"{base}/checkpoint").awaitTermination()
        out = runner.source.rows()
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('source', 3), ('filter', 2), ('map', 3), ('groups', 3), ('sorted', 3), ('pairs', 2)) t(name, version)")
def versions(spark, sf_dir):
    """Version cells after three changes, of which the filter and the neighbours see two, and one that changes nothing."""
    rt = Runtime(spark)
    s = Source(rt, "v long")
    nodes = {"source": s, "filter": s.filter("v > 1"), "map": s.map("v"), "groups": s.group_by("v % 2"), "sorted": s.sort_by_key("v"), "pairs": s.sort_by_key("v").pairwise()}
    for v in (1, 2, 2, 3):
        s.insert(v)
        for node in nodes.values():
            rt.get(node.version_node)
    return spark.createDataFrame([(k, rt.get(n.version_node)) for k, n in nodes.items()], "name string, version int")


@query("""SELECT * FROM (VALUES ('A1', '2.0'), ('B1', 'nan'), ('C1', '0.0'), ('D1', '8.0'), ('E1', 'nan'), ('F1', 'nan'), ('G1', 'inf'), ('H1', 'nan'), ('I1', 'inf'), ('J1', '-inf')) t(cell, value)""")
def sheet_cells(spark, sf_dir):
    """Numbers, text, empty cells, formulas, unknown functions, syntax errors, cycles and ranges of NaN."""
    sheet = formula.Sheet(Runtime(spark), rows=2)
    for cell, text in (("A1", "2"), ("B1", "text"), ("D1", "=A1*(3+1)"), ("E1", "=FROB(A1)"), ("F1", "=1+"), ("G1", "=A1/C1"), ("H1", "=H1+1"), ("I1", "=MIN(B1:B1)"), ("J1", "=MAX(B1, E1)")):
        sheet.set(cell, text)
    return spark.createDataFrame([(c, str(float(sheet.value(c)))) for c in ("A1", "B1", "C1", "D1", "E1", "F1", "G1", "H1", "I1", "J1")], "cell string, value string")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS low,
CASE WHEN p_size % 3 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS high FROM part""")
def formula_over_nan(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("x", F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("double")).otherwise(F.lit(float("nan"))))
    return parts.select("p_partkey", formula.compile_formula("=MIN(A1, Z9)", {"A1": "x"}).alias("low"), formula.compile_formula("=MAX(A1:A1, FROB(1))", {"A1": "x"}).alias("high"))


@query("""SELECT * FROM (VALUES ('diamond', '112 114'), ('equal value', 'False 1'), ('cutoff', '100 100 2'), ('dynamic', '1 2 2'), ('cycle', 'CycleError'), ('failure', 'kept 70'), ('label', 'price'),
('other runtime', 'ValueError'), ('query set', 'TypeError'), ('read while another computes', '99 0 99'), ('removed', 'ValueError')) t(scenario, result)""")
def graph_behaviour(spark, sf_dir):
    """What the graph of cells does, scenario by scenario."""
    out = []

    def fails(f) -> str:
        try:
            f()
        except Exception as e:
            return type(e).__name__
        return "nothing"

    rt = Runtime(spark)
    a = rt.create_input(1)
    b, c = rt.create_query(lambda r: r.get(a) + 1), rt.create_query(lambda r: r.get(a) + 109)
    d = rt.create_query(lambda r: r.get(b) + r.get(c))
    first = rt.get(d)
    rt.set(a, 2)
    out.append(("diamond", f"{first} {rt.get(d)}"))
    before = rt.revision
    out.append(("equal value", f"{rt.set(a, 2)} {rt.revision - before + 1}"))
    runs: list[int] = []
    low = rt.create_query(lambda r: min(r.get(a), 100))
    label = rt.create_query(lambda r: runs.append(1) or r.get(low))
    rt.set(a, 50)
    rt.get(label)
    got = []
    for v in (200, 300):
        rt.set(a, v)
        got.append(rt.get(label))
    out.append(("cutoff", f"{got[0]} {got[1]} {len(runs)}"))
    flag, x, y, seen = rt.create_input(True), rt.create_input(1), rt.create_input(2), []
    pick = rt.create_query(lambda r: seen.append(1) or (r.get(x) if r.get(flag) else r.get(y)))
    one = rt.get(pick)
    rt.set(flag, False)
    two = rt.get(pick)
    rt.set(x, 99)  # read no more
    rt.get(pick)
    out.append(("dynamic", f"{one} {two} {len(seen)}"))
    cells: list = []
    cells.append(rt.create_query(lambda r: r.get(cells[1])))
    cells.append(rt.create_query(lambda r: r.get(cells[0])))
    out.append(("cycle", fails(lambda: rt.get(cells[0]))))
    zero = rt.create_input(0)
    ten = rt.create_query(lambda r: 10 * r.get(zero) if r.get(zero) else [][0])
    kept = fails(lambda: rt.get(ten)) == fails(lambda: rt.get(ten)) == "QueryFailed"
    rt.set(zero, 7)
    out.append(("failure", f"{'kept' if kept else 'lost'} {rt.get(ten)}"))
    rt.set_label(x, "price")
    out.append(("label", rt.graph_snapshot()[x.id]["label"]))
    out.append(("other runtime", fails(lambda: Runtime(spark).get(a))))
    out.append(("query set", fails(lambda: rt.set(d, 1))))
    going, done, late = threading.Event(), threading.Event(), []

    def slow(r):
        going.set()
        done.wait(30)
        return r.get(x)

    job = rt.create_query(slow)
    worker = threading.Thread(target=lambda: late.append(rt.get(job)))
    rt.get(d)
    worker.start()
    going.wait(30)
    meanwhile = f"{rt.get(x)} {len(late)}"
    done.set()
    worker.join()
    out.append(("read while another computes", f"{meanwhile} {late[0]}"))
    rt.remove(pick)
    again = rt.create_input(5)
    out.append(("removed", fails(lambda: rt.get(pick)) if again.id == pick.id else "another place"))
    return spark.createDataFrame(out, "scenario string, result string")


@query("""SELECT 3 AS target, 4 AS total_nodes, 3 AS nodes_recomputed, 1 AS nodes_cutoff, '1:recomputed_changed 2:recomputed_cutoff 3:recomputed_changed' AS steps""")
def graph_trace(spark, sf_dir):
    """The trace of a diamond of cells over a count."""
    rt = Runtime(spark)
    low = rt.create_input(0, "low")
    n = rt.create_query(lambda r: events(spark, sf_dir).where(F.col("value") >= r.get(low)).count(), "n")
    many = rt.create_query(lambda r: r.get(n) > 0, "many")
    text = rt.create_query(lambda r: f"{r.get(many)} from {r.get(low)}", "text")
    rt.get(text)
    rt.set(low, 60)
    steps = F.transform("node_traces", lambda t: F.concat_ws(":", t["id"], t["action"]))
    return rt.trace_frame(rt.get_traced(text)[1]).select("target", "total_nodes", "nodes_recomputed", "nodes_cutoff", F.array_join(steps, " ").alias("steps"))


@query("SELECT * FROM (VALUES (0, 'input', 'a', '', '1,2'), (1, 'compute', 'b', '0', '2'), (2, 'compute', 'c', '0,1', '')) t(id, kind, label, dependencies, dependents)")
def graph_snapshot(spark, sf_dir):
    rt = Runtime(spark)
    a = rt.create_input(1, "a")
    b = rt.create_query(lambda r: r.get(a) + 1, "b")
    rt.get(rt.create_query(lambda r: r.get(a) + r.get(b), "c"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rt.graph_frame().select("id", "kind", "label", text("dependencies"), text("dependents"))
