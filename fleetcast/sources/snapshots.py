"""Operational table schemas, defaults and the stand-in snapshots (SURVEY S4,
S5, 7.2).

Snapshots are Parquet folders. A change never overwrites the folder it reads:
each application writes a new folder (see ``operators.tables.write_snapshot``).
The stand-ins derive users, vehicles, bookings and log reports from the
driver tables, so their size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.sources.tables import read_table

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

COMMENT = T.StructType([T.StructField("author", S), T.StructField("message", S),
                        T.StructField("createdAt", S)])

# Table layouts and column defaults of the rental backend.
SCHEMAS = {
    "users": T.StructType([T.StructField(n, t) for n, t in [
        ("id", L), ("email", S), ("username", S), ("password", S), ("first_name", S),
        ("last_name", S), ("middle_name", S), ("sex", S), ("date_of_birth", S), ("role", S),
        ("active", B), ("photo_uri", S), ("created_at", S), ("updated_at", S)]]),
    "vehicles": T.StructType([T.StructField(n, t) for n, t in [
        ("id", L), ("name", S), ("brand", S), ("model", S), ("year", I), ("price_per_day", D),
        ("available", B), ("photo_uri", S), ("type", S), ("transmission", S), ("fuel", S),
        ("seats", I), ("location", S), ("description", S), ("owner_id", S), ("owner_email", S),
        ("owner_name", S), ("approval_status", S), ("status", S), ("created_at", S),
        ("updated_at", S)]]),
    "bookings": T.StructType([T.StructField(n, t) for n, t in [
        ("id", L), ("vehicle", L), ("vehicle_name", S), ("renter", S), ("renter_id", S),
        ("renter_email", S), ("renter_name", S), ("owner_id", S), ("owner_email", S),
        ("owner_name", S), ("start_date", S), ("end_date", S), ("amount", D), ("status", S),
        ("notes", S), ("cancel_reason", S), ("created_at", S), ("updated_at", S)]]),
    "logreports": T.StructType([T.StructField(n, t) for n, t in [
        ("id", L), ("type", S), ("vehicle_id", L), ("vehicle_name", S), ("rental_id", L),
        ("renter_name", S), ("start_date", S), ("end_date", S), ("amount", D), ("issues", S),
        ("notes", S), ("odometer", S), ("fuel_level", S), ("photos", S), ("custom_labels", S),
        ("checkout", S), ("comments", S), ("created_at", S)]]),
}

DEFAULTS = {
    "users": {"first_name": "", "last_name": "", "middle_name": "", "sex": "",
              "date_of_birth": "", "role": "renter", "active": True, "photo_uri": ""},
    "vehicles": {"name": "", "brand": "", "model": "", "price_per_day": 0.0, "available": True,
                 "photo_uri": "", "type": "", "transmission": "", "fuel": "", "location": "",
                 "description": "", "owner_id": "", "owner_email": "", "owner_name": "",
                 "approval_status": "approved", "status": "available"},
    "bookings": {"vehicle_name": "", "renter": "", "renter_id": "", "renter_email": "",
                 "renter_name": "", "owner_id": "", "owner_email": "", "owner_name": "",
                 "start_date": "", "end_date": "", "amount": 0.0, "status": "pending",
                 "notes": "", "cancel_reason": ""},
    "logreports": {"type": "", "vehicle_name": "", "renter_name": "", "start_date": "",
                   "end_date": "", "amount": 0.0, "issues": "[]", "notes": "", "odometer": "",
                   "fuel_level": "", "photos": "[]", "custom_labels": "{}", "checkout": "",
                   "comments": "[]"},
}

ROLES = ["renter", "owner", "admin"]
EMAIL_DOMAIN = "fleet.test"


def empty_snapshot(spark: SparkSession, entity: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[entity])


def read_snapshot(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Read a snapshot folder with its declared schema; an absent
    folder is an empty table (``CREATE TABLE IF NOT EXISTS``)."""
    try:
        return spark.read.schema(SCHEMAS[entity]).parquet(path)
    except Exception as exc:  # path does not exist yet
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return empty_snapshot(spark, entity)
        raise


def conform(frame: DataFrame, entity: str, keep: list[str] | None = None) -> DataFrame:
    """Select the declared columns in order, cast, fill declared defaults;
    ``keep`` passes extra columns (such as the change seq) through."""
    out = [F.col(k) for k in (keep or [])]
    for f in SCHEMAS[entity].fields:
        c = F.col(f.name).cast(f.dataType) if f.name in frame.columns else F.lit(None).cast(f.dataType)
        d = DEFAULTS[entity].get(f.name)
        if d is not None:
            c = F.coalesce(c, F.lit(d))
        out.append(c.alias(f.name))
    return frame.select(*out)


# ---- stand-ins ---------------------------------------------------

def renter_id(custkey) -> F.Column:
    return F.col(custkey) * 2 + 1


def owner_id(suppkey) -> F.Column:
    return F.col(suppkey) * 2 + 2


def _email(name_col) -> F.Column:
    return F.concat(F.lower(F.regexp_replace(name_col, "#", ".")), F.lit("@" + EMAIL_DOMAIN))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers become renters, suppliers owners (odd / even ids)."""
    c = read_table(spark, sf_dir, "customer").select(
        renter_id("c_custkey").alias("id"), _email(F.col("c_name")).alias("email"),
        F.lower(F.regexp_replace("c_name", "#", "")).alias("username"),
        F.md5("c_name").alias("password"),
        F.concat(F.upper(F.substring("c_mktsegment", 1, 1)),
                 F.lower(F.substring("c_mktsegment", 2, 100))).alias("first_name"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("last_name"),
        F.lit("renter").alias("role"), (F.col("c_acctbal") >= 0).alias("active"))
    s = read_table(spark, sf_dir, "supplier").select(
        owner_id("s_suppkey").alias("id"), _email(F.col("s_name")).alias("email"),
        F.lower(F.regexp_replace("s_name", "#", "")).alias("username"),
        F.md5("s_name").alias("password"),
        F.lit("Owner").alias("first_name"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("last_name"),
        F.lit("owner").alias("role"), (F.col("s_acctbal") >= 0).alias("active"))
    return conform(c.unionByName(s), "users")


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts become vehicles; the owner is the lowest supplier key that ships
    the part (an aggregate over line items, so it scales with them)."""
    p = read_table(spark, sf_dir, "part")
    first_supplier = (read_table(spark, sf_dir, "lineitem").groupBy("l_partkey")
                      .agg(F.min("l_suppkey").alias("s_suppkey")))
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    owners = first_supplier.join(sup, "s_suppkey").select(
        "l_partkey", owner_id("s_suppkey").cast("string").alias("owner_id"),
        _email(F.col("s_name")).alias("owner_email"), F.col("s_name").alias("owner_name"))
    v = (p.join(owners, p.p_partkey == owners.l_partkey, "left")
         .select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                 F.col("p_brand").alias("brand"), F.col("p_type").alias("model"),
                 (F.lit(1995) + F.col("p_size") % 30).alias("year"),
                 (F.col("p_retailprice") / 10).alias("price_per_day"),
                 (F.col("p_size") % 2 == 0).alias("available"),
                 F.when(F.col("p_size") % 2 == 0, "available").otherwise("rented").alias("status"),
                 (F.col("p_size") % 4 + 2).alias("seats"),
                 "owner_id", "owner_email", "owner_name"))
    return conform(v, "vehicles")


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders become bookings of their lowest part key."""
    o = read_table(spark, sf_dir, "orders")
    first_part = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
                  .agg(F.min("l_partkey").alias("vehicle")))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    status = (F.when(F.col("o_orderstatus") == "O", "pending")
              .when(F.col("o_orderstatus") == "F", "completed").otherwise("confirmed"))
    day = F.col("o_orderdate").cast("date")
    b = (o.join(first_part, o.o_orderkey == first_part.l_orderkey)
         .join(c, o.o_custkey == c.c_custkey)
         .select(F.col("o_orderkey").alias("id"), "vehicle",
                 renter_id("o_custkey").cast("string").alias("renter"),
                 renter_id("o_custkey").cast("string").alias("renter_id"),
                 _email(F.col("c_name")).alias("renter_email"),
                 F.col("c_name").alias("renter_name"),
                 F.date_format(day, "yyyy-MM-dd").alias("start_date"),
                 F.date_format(F.date_add(day, 3), "yyyy-MM-dd").alias("end_date"),
                 F.col("o_totalprice").alias("amount"), status.alias("status")))
    return conform(b, "bookings")


def logreports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per conversation; its even turns are the stored comments
    (JSON text, as the backend stores them), its odd turns arrive as changes."""
    conv = read_table(spark, sf_dir, "conversations")
    first = conv.filter(F.col("turn") % 2 == 0)
    comments = (first.groupBy("conv_id")
                .agg(F.array_sort(F.collect_list(F.struct(
                    "turn", F.col("role").alias("author"), F.col("text").alias("message"))))
                    .alias("c")))
    ids = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    r = (ids.join(comments, "conv_id", "left")
         .select(F.col("conv_id").alias("id"), F.lit("checkin").alias("type"),
                 F.col("conv_id").alias("vehicle_id"), F.col("conv_id").alias("rental_id"),
                 F.to_json(F.map_from_arrays(F.array(F.lit("turns")),
                                             F.array(F.col("turns").cast("string"))))
                 .alias("custom_labels"),
                 F.to_json(F.transform(F.coalesce(F.col("c"), F.array()),
                                       lambda x: F.struct(x["author"].alias("author"),
                                                          x["message"].alias("message"),
                                                          F.lit("").alias("createdAt"))))
                 .alias("comments")))
    return conform(r, "logreports")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows from ``events``: id = user, seq = event id, action from the
    event type (signup = create, error = delete, else update), payload =
    props plus the event value (absent for views)."""
    ev = read_table(spark, sf_dir, "events")
    action = (F.when(F.col("event_type") == "signup", "create")
              .when(F.col("event_type") == "error", "delete").otherwise("update"))
    k = F.get_json_object("props", "$.k")
    payload = F.to_json(F.struct(
        k.alias("k"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
        F.col("event_type").alias("last_event")))
    return ev.select(F.lit("profile").alias("entity"), action.alias("action"),
                     F.col("user_id").alias("id"), F.col("user_id").alias("actor_id"),
                     F.col("ts").cast("timestamp").alias("ts"),
                     F.col("event_id").alias("seq"), payload.alias("payload"))


def read_jdbc_table(spark: SparkSession, url: str, table: str, entity: str | None = None,
                    partition_column: str = "id", lower: int | None = None,
                    upper: int | None = None, partitions: int = 64,
                    properties: dict | None = None) -> DataFrame:
    """S4 on a relational store: a partitioned JDBC scan (one range of
    ``partition_column`` per task, filters and column pruning pushed to the
    database). Bounds default to the table's own min/max id, fetched with
    one small query. Needs the database's JDBC driver on the classpath;
    this container has none, so tests use Parquet snapshots instead."""
    props = dict(properties or {})
    if lower is None or upper is None:
        bounds = (spark.read.jdbc(url, f"(SELECT min({partition_column}) AS lo, "
                                       f"max({partition_column}) AS hi FROM {table}) b",
                                  properties=props).first())
        lower, upper = int(bounds["lo"] or 0), int(bounds["hi"] or 0)
    df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                         upperBound=upper + 1, numPartitions=partitions, properties=props)
    return conform(df, entity) if entity else df
