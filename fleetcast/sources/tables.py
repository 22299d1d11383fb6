"""Driver test tables and the booking-history stand-in.

The reference reads a booking CSV that is not shipped; the driver's TPC-H-like
tables stand in for it. Every frame here is lazy and column-pruned: only the
columns a caller selects reach the Parquet scan.

Join strategy: line items and orders are both fact-sized, so they meet in a
shuffle join on the order key (unique on the orders side). Part, customer and
supplier are left to Catalyst/AQE: broadcast when their measured size is under
``spark.sql.autoBroadcastJoinThreshold``, sort-merge otherwise, with AQE
splitting a hot key. Only nation (25 rows, fixed by definition) is broadcast
by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.functions.coerce import to_day, to_int_default

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]

SEGMENT_COLUMNS = ["from_area_id", "vehicle_model_id", "travel_type_id"]

# Fixed values of the stand-in mapping.
VEHICLE_MODELS = 5          # vehicle_model_id = p_size mod 5
LAT_SCALE, LONG_SCALE = 90.0, 180.0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Line items hash-partitioned on the order key.

    That is the distribution the join with orders needs when both sides are
    large (sort-merge join), so at cluster scale it is the join's own
    exchange, not an extra one. When orders is small enough to broadcast it
    still spreads a file with few row groups over all cores.
    """
    return read_table(spark, sf_dir, "lineitem").select(*cols).repartition("l_orderkey")


def _nation_region(spark, sf_dir) -> DataFrame:
    return F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))


def _customers(spark, sf_dir) -> DataFrame:
    n = _nation_region(spark, sf_dir)
    return (read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("c_regionkey")))


def _suppliers(spark, sf_dir) -> DataFrame:
    n = _nation_region(spark, sf_dir)
    return (read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
            .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("s_regionkey")))


def segment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings with only what demand needs: creation time and segment keys.

    Columns: booking_created (timestamp), from_area_id, vehicle_model_id,
    travel_type_id (raw values, coerced later by ``load_history``).
    """
    li = line_items(spark, sf_dir, "l_orderkey", "l_partkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                   "o_orderpriority")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    c = _customers(spark, sf_dir)
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .join(c, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderdate").cast("timestamp").alias("booking_created"),
                    F.col("c_regionkey").alias("from_area_id"),
                    (F.col("p_size") % VEHICLE_MODELS).alias("vehicle_model_id"),
                    F.substring("o_orderpriority", 1, 1).alias("travel_type_id")))


def load_history(history: DataFrame, created_col: str = "booking_created") -> DataFrame:
    """S2 + C5 + F1 + C2: required columns, booking date, drop undated rows,
    integer segment keys with default 0."""
    required = {created_col, *SEGMENT_COLUMNS}
    missing = sorted(required.difference(history.columns))
    if missing:
        raise ValueError("Historical data is missing required columns: " + ", ".join(missing))
    return (history
            .withColumn("booking_date", to_day(F.col(created_col)))
            .filter(F.col("booking_date").isNotNull())
            .select("booking_date", *[to_int_default(c).alias(c) for c in SEGMENT_COLUMNS]))


BOOKING_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                        "l_returnflag", "l_linestatus", "l_shipdate"]


def booking_history(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """Full booking rows in the reference's CSV layout (FIXTURES 1).

    One row per line item. Coordinates come from the supplier's embedding
    (first four items, scaled to degrees); a supplier without one has null
    coordinates, as the reference allows. ``li`` may be a stream of line
    items (stream-static joins).
    """
    li = (line_items(spark, sf_dir, *BOOKING_LINE_COLUMNS) if li is None
          else li.select(*BOOKING_LINE_COLUMNS))
    # orders meet their customers, and suppliers their coordinates, before line items join:
    # the line items themselves are moved by three keys only
    c = _customers(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).alias("priority"),
        (F.col("o_orderstatus") == "O").alias("online"))
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    e = read_table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.element_at("embedding", 1).cast("double") * LAT_SCALE).alias("from_lat"),
        (F.element_at("embedding", 2).cast("double") * LONG_SCALE).alias("from_long"),
        (F.element_at("embedding", 3).cast("double") * LAT_SCALE).alias("to_lat"),
        (F.element_at("embedding", 4).cast("double") * LONG_SCALE).alias("to_long"))
    s = _suppliers(spark, sf_dir).join(e, F.col("s_suppkey") == F.col("vec_id"), "left")
    ship = F.col("l_shipdate").cast("timestamp")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("l_orderkey").alias("order_key"),
                F.col("l_linenumber").alias("line_number"),
                F.col("l_partkey").alias("part_key"),
                F.col("l_suppkey").alias("supp_key"),
                (F.col("p_size") % VEHICLE_MODELS).alias("vehicle_model_id"),
                F.col("l_linenumber").alias("package_id"),
                F.col("priority").cast("int").alias("travel_type_id"),
                F.col("c_regionkey").alias("from_area_id"),
                F.col("s_regionkey").alias("to_area_id"),
                F.col("c_nationkey").alias("from_city_id"),
                F.col("s_nationkey").alias("to_city_id"),
                F.col("online").cast("int").alias("online_booking"),
                (F.col("l_linestatus") == "O").cast("int").alias("mobile_site_booking"),
                "from_lat", "from_long", "to_lat", "to_long",
                ship.alias("from_date"),
                F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), ship).alias("to_date"),
                F.col("o_orderdate").cast("timestamp").alias("booking_created"),
                (F.col("l_returnflag") == "R").cast("int").alias("Car_Cancellation"),
            ))
