"""Table change operators and views (SURVEY M1-M12, P2-P5, F3-F6, O1, J6, J8,
N1-N4, N6, C20-C25).

The reference changes rows one request at a time. Here a whole batch of
changes is applied with joins and aggregates: each operator takes a snapshot
and a change batch and returns frames (new rows, rejects, events). Writing a
result never overwrites the folder it was read from: ``write_snapshot``
writes a new folder per batch id, which also makes a retried batch
idempotent.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.functions.buckets import BUCKETS, quantile_buckets
from fleetcast.functions.coerce import falsy_default, pick, to_bool
from fleetcast.operators import asof, identity
from fleetcast.session import materialize
from fleetcast.sources.snapshots import COMMENT, ROLES, conform


# Reason codes of rejected changes.
NO_ACTIVE_USER, OWNERS_ONLY, ADMINS_ONLY = "no_active_user", "owners_only", "admins_only"
UNKNOWN_ID, UNKNOWN_VEHICLE, UNKNOWN_REPORT, UNKNOWN_ROLE = "unknown_id", "unknown_vehicle", "unknown_report", "unknown_role"
NOT_OWN_VEHICLE, NOT_OWN_BOOKINGS, OWNER_MAY_NOT_BOOK = "not_own_vehicle", "not_own_bookings", "owner_may_not_book"
IDENTITY_MISSING, IDENTITY_TAKEN, SEVERAL_USERS = "identity_missing", "identity_taken", "several_users"
BAD_VALUE = "bad_value"

# Payload names of each column, the first non-null one wins.
ALIASES = {
    "users": {"email": ("email", "username"), "username": ("username", "email"), "password": ("password",),
              "first_name": ("firstName", "first_name"), "last_name": ("lastName", "last_name"),
              "middle_name": ("middleName", "middle_name"), "sex": ("sex",), "date_of_birth": ("dateOfBirth", "date_of_birth"),
              "role": ("role",), "active": ("active",), "photo_uri": ("photoUri", "photo_url")},
    "vehicles": {"name": ("name",), "brand": ("brand",), "model": ("model",), "year": ("year",),
                 "price_per_day": ("pricePerDay", "price", "daily_rate"), "available": ("available",),
                 "photo_uri": ("photoUri", "photo_url", "photo", "image"), "type": ("type",), "transmission": ("transmission",),
                 "fuel": ("fuel",), "seats": ("seats",), "location": ("location",), "description": ("description",),
                 "owner_id": ("ownerId", "owner_id", "owner", "user_id"), "owner_email": ("ownerEmail", "owner_email"),
                 "owner_name": ("ownerName", "owner_name"), "approval_status": ("approvalStatus", "approval_status"),
                 "status": ("status",)},
    "bookings": {"status": ("status",), "notes": ("notes",), "cancel_reason": ("cancelReason", "cancel_reason"),
                 "amount": ("amount", "totalPrice", "total_price"), "start_date": ("startDate", "start_date", "fromDate", "from"),
                 "end_date": ("endDate", "end_date", "toDate", "to"), "renter_name": ("renterName", "renter_name"),
                 "renter_email": ("renterEmail", "renter_email")},
    "logreports": {"type": ("type",), "vehicle_name": ("vehicleName", "vehicle_name"), "renter_name": ("renterName", "renter_name"),
                   "start_date": ("startDate", "start_date"), "end_date": ("endDate", "end_date"), "amount": ("amount",),
                   "issues": ("issues",), "notes": ("notes",), "odometer": ("odometer",), "fuel_level": ("fuelLevel", "fuel_level"),
                   "photos": ("photos",), "custom_labels": ("customLabels", "custom_labels"), "checkout": ("checkout",)},
}


def norm_identity(c) -> Column:
    """C20: trim + lower."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def payload_map(c="payload") -> Column:
    """N1 for change payloads: JSON object -> map<string,string>. Explicit JSON
    nulls stay as keys with null values (M4 needs them); malformed -> null."""
    return F.from_json(F.nullif(F.col(c), F.lit("")), "map<string,string>")


# ---- views (P2-P5) -------------------------------------------------------------

def user_view(users: DataFrame) -> DataFrame:
    """P2 + C21 + C23: public user fields; the password never leaves."""
    first, last = F.col("first_name"), F.col("last_name")
    return users.select(
        "id", "email", "username",
        F.coalesce(first, F.lit("")).alias("firstName"),
        F.coalesce(last, F.lit("")).alias("lastName"),
        F.coalesce(F.col("middle_name"), F.lit("")).alias("middleName"),
        F.coalesce(F.col("sex"), F.lit("")).alias("sex"),
        F.col("date_of_birth").alias("dateOfBirth"),
        falsy_default("role", "renter").alias("role"),
        F.col("active"),
        F.trim(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))))
        .alias("fullName"))


def vehicle_view(v: DataFrame) -> DataFrame:
    """Name falls back to model, price shown twice, status from
    availability."""
    price = F.coalesce(F.col("price_per_day"), F.lit(0.0))
    return v.select(
        "id",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("model"), F.lit("")),
                   F.lit("")).alias("name"),
        falsy_default("brand", "").alias("brand"), falsy_default("model", "").alias("model"),
        "year", price.alias("pricePerDay"), price.alias("price"),
        F.coalesce(F.col("available"), F.lit(False)).alias("available"),
        F.when(F.col("available"), "available").otherwise("rented").alias("status"),
        falsy_default("photo_uri", "").alias("image"),
        falsy_default("type", "").alias("type"),
        falsy_default("transmission", "").alias("transmission"),
        falsy_default("fuel", "").alias("fuel"), "seats",
        falsy_default("location", "").alias("location"),
        falsy_default("description", "").alias("description"),
        F.col("owner_id").alias("ownerId"), falsy_default("owner_email", "").alias("ownerEmail"))


def booking_view(b: DataFrame) -> DataFrame:
    """Vehicle shown twice, amount and status defaults."""
    return b.select(
        "id", "vehicle", F.col("vehicle").alias("vehicleId"), "renter",
        F.col("renter").alias("renterId"), F.col("start_date").alias("startDate"),
        F.col("end_date").alias("endDate"),
        F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount"),
        falsy_default("status", "pending").alias("status"))


def booking_record(b: DataFrame) -> DataFrame:
    """P4, stored form: every column under its public name, as stored."""
    names = {"vehicle_name": "vehicleName", "renter_email": "renterEmail", "renter_name": "renterName", "owner_id": "ownerId",
             "owner_email": "ownerEmail", "owner_name": "ownerName", "start_date": "startDate", "end_date": "endDate",
             "cancel_reason": "cancelReason", "created_at": "createdAt"}
    shown = ["id", "vehicle", *names, "renter", "amount", "status", "notes"]
    return b.select(*[F.col(c).alias(names.get(c, c)) for c in shown],
                    F.col("vehicle").alias("vehicleId"), F.col("renter_id").alias("renterId"))


def report_view(r: DataFrame) -> DataFrame:
    """P5 + N1: nested fields parsed from JSON text; empty or malformed text
    gives the default (empty list / empty map)."""
    def parse(c, schema, default):
        return F.coalesce(F.from_json(F.nullif(F.col(c), F.lit("")), schema), default)
    return r.select(
        "id", "type", F.col("vehicle_id").alias("vehicleId"),
        falsy_default("vehicle_name", "").alias("vehicleName"),
        F.col("rental_id").alias("rentalId"),
        falsy_default("renter_name", "").alias("renterName"),
        F.col("start_date").alias("startDate"), F.col("end_date").alias("endDate"),
        F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount"),
        parse("issues", "array<string>", F.array().cast("array<string>")).alias("issues"),
        falsy_default("notes", "").alias("notes"),
        falsy_default("odometer", "").alias("odometer"),
        falsy_default("fuel_level", "").alias("fuelLevel"),
        parse("photos", "array<string>", F.array().cast("array<string>")).alias("photos"),
        parse("custom_labels", "map<string,string>",
              F.create_map().cast("map<string,string>")).alias("customLabels"),
        F.col("checkout"),
        parse("comments", COMMENT.simpleString().replace("struct", "array<struct", 1) + ">",
              F.array().cast(f"array<{COMMENT.simpleString()}>")).alias("comments"),
        F.col("created_at").alias("createdAt"))


# ---- listing (F3-F6, O1, O3) -----------------------------------------------------

def filter_bookings(b: DataFrame, renter_email: str | None = None,
                    owner_email: str | None = None) -> DataFrame:
    """F3 + F4: optional conjunctive, case-insensitive e-mail filters."""
    cond = F.lit(True)
    if renter_email:
        cond = cond & (F.lower(F.col("renter_email")) == renter_email.strip().lower())
    if owner_email:
        cond = cond & (F.lower(F.col("owner_email")) == owner_email.strip().lower())
    return b.filter(cond)


def filter_vehicles(v: DataFrame, owner_email: str | None = None) -> DataFrame:
    """F4 for vehicles: one owner's, e-mail matched without case or blanks."""
    return v if not owner_email else v.filter(F.lower(F.col("owner_email")) == owner_email.strip().lower())


def newest(frame: DataFrame, n: int | None = None) -> DataFrame:
    """O1 + O3: id descending; with n, a top-n (limit is the feature here)."""
    out = frame.orderBy(F.desc("id"))
    return out.limit(n) if n else out


# ---- distributed dense numbering -------------------------------------------------

def ordered_index(frame: DataFrame, order_col: str, name: str = "idx",
                  buckets: int = BUCKETS) -> DataFrame:
    """1..N in ``order_col`` order (ties broken arbitrarily), without pulling
    all rows into one partition: range buckets from approximate quantiles,
    per-bucket counts, a prefix sum over the (tiny) bucket table and a
    row_number inside each bucket. The input is read three times (count,
    edges, numbering), so it is written once first."""
    frame = materialize(frame, "index-input")
    b = quantile_buckets(frame, order_col, "_b", buckets)
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(order_col))
    return (b.withColumn("_r", within).join(F.broadcast(offsets), "_b")
            .withColumn(name, F.col("_off") + F.col("_r"))
            .drop("_b", "_r", "_off"))


def next_ids(snapshot: DataFrame, batch: DataFrame, order_col: str = "seq") -> DataFrame:
    """M5: new ids = max(existing id) + dense index of the new rows."""
    base = F.coalesce(snapshot.agg(F.max("id")).scalar(), F.lit(0))
    return ordered_index(batch, order_col, "_idx").withColumn(
        "id", (base + F.col("_idx")).cast("long")).drop("_idx")


# ---- change application ----------------------------------------------------------

def latest_values(changes: DataFrame, key: str, seq: str, fields: dict[str, tuple[str, ...]],
                  keep_nulls: bool = False) -> DataFrame:
    """M7 core: per key and field, the value of the latest change. ``fields``
    maps a field to its payload names (P1).

    ``keep_nulls`` False (M3): latest non-null value. True (M4): latest change
    whose payload contains a name, even with a null value. Changes arrive as
    a map column ``m``.
    """
    aggs = []
    for f, names in fields.items():
        value = pick(F.col("m"), *names)
        present = value.isNotNull()
        if keep_nulls:
            present = F.coalesce(functools.reduce(lambda x, y: x | y, [F.map_contains_key("m", n) for n in names]), F.lit(False))
        aggs.append(F.max_by(F.struct(F.lit(True).alias("set"), value.alias("v")), F.when(present, F.col(seq))).alias(f"_{f}"))
    return changes.groupBy(key).agg(*aggs, F.max(seq).alias("last_seq"))


def apply_patches(snapshot: DataFrame, patches: DataFrame, key: str, fields: dict[str, tuple[str, ...]],
                  keep_nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """M3 / M4 + M12: patch rows by id. ``fields`` maps a column to its payload
    names (ALIASES). Several patches of one id are folded in sequence order.

    Returns (patched rows, rejects with id, seq and reason). A patch is
    rejected as a whole when one of its values doesn't fit the column's type;
    a patch of an unknown id has its own reject row too. Columns that no patch
    names keep their value; ``updated_at`` (if the patches carry ``ts``) takes
    the time of the last patch.
    """
    p = patches.withColumn("m", payload_map("payload"))
    types = {c: snapshot.schema[c].dataType.simpleString() for c in fields}
    bad = F.lit(False)
    for c, names in fields.items():
        value = pick(F.col("m"), *names)
        if types[c] != "string":
            bad = bad | (value.isNotNull() & _typed(value, types[c]).isNull())
    p = p.withColumn("_bad", bad)
    good = p.filter(~F.col("_bad"))
    known = snapshot.select(F.col(key).alias("_sid"))
    unknown = good.join(known, good["id"] == known["_sid"], "left_anti")
    rejects = (p.filter("_bad").select("id", "seq", F.lit(BAD_VALUE).alias("reason"))
               .unionByName(unknown.select("id", "seq", F.lit(UNKNOWN_ID).alias("reason"))))
    folded = latest_values(good, "id", "seq", fields, keep_nulls)
    if "ts" in patches.columns:
        folded = folded.join(good.groupBy(F.col("id").alias("_tid")).agg(F.max_by("ts", "seq").alias("_ts")),
                             F.col("id") == F.col("_tid")).drop("_tid")
    j = snapshot.join(folded.withColumnRenamed("id", "_pid"), snapshot[key] == F.col("_pid"), "left")
    cols = []
    for c in snapshot.columns:
        if c in fields:
            s = F.col(f"_{c}")
            cols.append(F.when(s["set"].isNotNull(), _typed(s["v"], types[c])).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and "ts" in patches.columns:
            stamp = F.date_format(F.col("_ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            cols.append(F.coalesce(stamp, F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols), rejects


def _typed(value: Column, kind: str) -> Column:
    """Payload text as a column's type; null where it doesn't fit. Whole
    numbers may be written with a fraction of 0, and never pass through a
    double unless they are."""
    if kind in ("int", "bigint"):
        plain, real = value.try_cast("bigint"), value.try_cast("double")
        whole = F.coalesce(plain, F.when(real == F.floor(real), real.try_cast("bigint")))
        return whole if kind == "bigint" else whole.try_cast("int")
    if kind == "boolean":
        return to_bool(value)
    return value.try_cast(kind)


def delete_rows(snapshot: DataFrame, deletes: DataFrame, key: str = "id"
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M6: (remaining rows, removed rows, rejects for ids not found)."""
    d = deletes.select(F.col("id").alias("_did"), "seq")
    remaining = snapshot.join(d, snapshot[key] == d["_did"], "left_anti")
    removed = snapshot.join(d, snapshot[key] == d["_did"], "left_semi")
    rejects = (d.join(snapshot, d["_did"] == snapshot[key], "left_anti")
               .select(F.col("_did").alias("id"), "seq", F.lit(UNKNOWN_ID).alias("reason")))
    return remaining, removed, rejects


SALTS = 16      # tasks that the changes of one id may be spread over


def _per_id(changes: DataFrame, known: DataFrame, keep: Column, *aggs) -> DataFrame:
    """Aggregates over the changes of each id that ``keep`` lets through, given
    one ``known`` row per id. The join is on (id, salt): a hot id's changes are
    spread over SALTS tasks and reduced there before they meet."""
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = (changes.select("id", "seq", "action", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int").alias("_salt"))
            .join(salted, ["id", "_salt"]).filter(keep))
    part = rows.groupBy("id", "_salt").agg(*[f(F.expr(x)).alias(n) for n, f, x, _ in aggs])
    return part.groupBy("id").agg(*[g(n).alias(n) for n, _, _, g in aggs])


def fold_change_log(changes: DataFrame, fields: list[str]) -> DataFrame:
    """M7: the state each id ends in after a log of create / update / delete
    changes applied in ``seq`` order, starting from no row.

    A delete is a barrier: only changes after the last delete count, and the
    row exists from the first create after it (updates before that find no
    row and are rejected by the reference). Each field then takes its latest
    non-null value.

    One aggregate per id (map-side combined) has the last delete and each
    field's latest value with its seq. Two more passes over (id, seq, action)
    find the birth and count what was applied; their joins are salted, so the
    changes of a hot id never meet in one task before they are reduced. A field
    whose latest value is older than the birth is null.
    """
    m = payload_map("payload")
    latest = changes.withColumn("m", m).groupBy("id").agg(
        F.max(F.when(F.col("action") == "delete", F.col("seq"))).alias("_del"), F.max("seq").alias("last_seq"),
        *[F.max(F.when(F.col("m")[f].isNotNull(), F.struct("seq", F.col("m")[f].alias("v")))).alias(f"_{f}") for f in fields])
    barrier = latest.select("id", F.coalesce("_del", F.lit(-(1 << 62))).alias("_del"))
    born = _per_id(changes.filter("action = 'create'"), barrier, F.col("seq") > F.col("_del"),
                   ("_born", F.min, "seq", F.min))
    applied = _per_id(changes, born, F.col("seq") >= F.col("_born"), ("changes_applied", F.count, "seq", F.sum))
    return latest.join(born, "id").join(applied, "id").select(
        "id", *[F.when(F.col(f"_{f}.seq") >= F.col("_born"), F.col(f"_{f}.v")).alias(f) for f in fields],
        "changes_applied", "last_seq")


# ---- users: upsert and register (M1, M2, J8, M10) --------------------------------

USER_FIELDS = {
    "first_name": ("firstName", "first_name"),
    "last_name": ("lastName", "last_name"),
    "middle_name": ("middleName", "middle_name"),
    "sex": ("sex",),
    "date_of_birth": ("dateOfBirth", "date_of_birth"),
    "photo_uri": ("photoUri", "photo_url"),
}


def user_payload(batch: DataFrame) -> DataFrame:
    m = payload_map("payload")
    b = batch.withColumn("m", m)
    mm = F.col("m")
    return b.select(
        "seq",
        norm_identity(pick(mm, "email", "username", default="")).alias("email"),
        norm_identity(pick(mm, "username", "email", default="")).alias("username"),
        pick(mm, "password", default="").alias("password"),
        *[pick(mm, *keys, default="").alias(col) for col, keys in USER_FIELDS.items()],
        pick(mm, "role", default="renter").alias("role"),
        F.coalesce(to_bool(mm["active"]), F.lit(True)).alias("active"),
        (F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if "ts" in batch.columns else F.lit(None).cast("string")).alias("made_at"))


def _match_users(users: DataFrame, p: DataFrame) -> DataFrame:
    """Ids of users whose e-mail or username equals the change's, as the
    union of two equi joins (no OR join); per change: lowest id and the
    number of distinct matches."""
    u = users.select(F.col("id").alias("uid"), norm_identity("email").alias("ue"),
                     norm_identity("username").alias("un"))
    by_email = p.join(u, p["email"] == u["ue"]).select("seq", "uid")
    by_name = p.join(u, p["username"] == u["un"]).select("seq", "uid")
    return (by_email.unionByName(by_name).groupBy("seq")
            .agg(F.min("uid").alias("match_id"), F.countDistinct("uid").alias("matches")))


def upsert_users(users: DataFrame, batch: DataFrame, at_once: int = identity.AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """M1: the changes of a batch applied one after the other, by seq. Returns
    the rows of all users they touched (``seq``: the last change) and one
    outcome per change: seq, outcome (inserted, updated or rejected), id, reason.

    A change updates the user who holds its e-mail or its user name at that
    point, and inserts one if nobody does; ids are given in the order of the
    insertions. An update overwrites every field with the payload's value or
    its default, not with the current one. Rejected: a missing e-mail, user
    name or password, and a change that meets two users, since they can't both
    hold one identity. See ``operators.identity`` for how groups of tied changes
    are found and replayed.
    """
    p = materialize(user_payload(batch), "user-changes")
    missing = (F.col("email") == "") | (F.col("username") == "") | (F.col("password") == "")
    valid = p.filter(~missing)
    stored = users.select(F.col("id").alias("uid"), norm_identity("email").alias("email"), norm_identity("username").alias("username"))
    met = materialize(identity.replay(stored, valid.select("seq", "email", "username"), at_once), "user-outcomes")
    new = next_ids(users, met.filter("born = seq").select("seq")).select(F.col("seq").alias("born"), F.col("id").alias("new_id"))
    met = materialize(met.join(new, "born", "left").select("seq", "matches", "born", F.coalesce("uid", "new_id").alias("id")), "user-ids")
    outcomes = (met.select("seq", F.when(F.col("matches") > 1, "rejected").when(F.col("born") == F.col("seq"), "inserted")
                           .otherwise("updated").alias("outcome"), "id", F.when(F.col("matches") > 1, SEVERAL_USERS).alias("reason"))
                .unionByName(p.filter(missing).select("seq", F.lit("rejected").alias("outcome"), F.lit(None).cast("long").alias("id"),
                                                      F.lit(IDENTITY_MISSING).alias("reason"))))
    # the last change of each user, and the time of the one that made it: partial aggregates, safe for a hot user
    applied = valid.join(met.filter("matches < 2").select("seq", "id", "born"), "seq")
    fields = [c for c in valid.columns if c != "made_at"]
    last = (applied.groupBy("id").agg(F.max_by(F.struct(*fields), "seq").alias("_s"), F.max(F.when(F.col("born") == F.col("seq"), F.col("made_at"))).alias("_made"))
            .join(users.select("id", F.col("created_at").alias("_created")), "id", "left")
            .select("id", "_s.*", F.coalesce("_created", "_made").alias("created_at")))
    return conform(last, "users", keep=["seq"]), outcomes


def register_users(users: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2 + M10: insert only when neither e-mail nor username exists yet and
    the role is valid and neither is empty; within a batch, the result is that
    of the changes applied one by one in seq order. Returns (inserted rows, rejects)."""
    p = user_payload(batch)
    m = _match_users(users, p)
    j = p.join(m, "seq", "left").withColumn(
        "reason", F.when((F.col("email") == "") | (F.col("username") == ""), IDENTITY_MISSING)
        .when(~F.col("role").isin(*ROLES), UNKNOWN_ROLE)
        .when(F.col("matches").isNotNull(), IDENTITY_TAKEN))
    j = materialize(j, "register-candidates")
    # a change that may itself be refused for a clash must not block a third one: settle the clashes by
    # rounds, in each of which a change that is the first of its e-mail and of its username is accepted
    open_ = j.filter("reason is null").select("seq", "email", "username")
    accepted = None
    while True:
        fe = open_.groupBy("email").agg(F.min("seq").alias("_fe"))
        fu = open_.groupBy("username").agg(F.min("seq").alias("_fu"))
        won = materialize(open_.join(fe, "email").join(fu, "username").filter("seq = _fe and seq = _fu").select("seq", "email", "username"),
                          "register-won")
        accepted = won if accepted is None else accepted.unionByName(won)
        open_ = materialize(open_.join(won.select("email"), "email", "left_anti").join(won.select("username"), "username", "left_anti"),
                            "register-open")
        if open_.isEmpty():
            break
    ok = j.join(accepted.select("seq"), "seq", "left_semi")
    rejects = (j.filter("reason is not null").select("seq", "reason")
               .unionByName(j.filter("reason is null").join(accepted.select("seq"), "seq", "left_anti")
                            .select("seq", F.lit(IDENTITY_TAKEN).alias("reason"))))
    inserted = conform(next_ids(users, ok.drop("reason").withColumnRenamed("made_at", "created_at")), "users", keep=["seq"])
    return inserted, rejects


# ---- bookings: enrichment on insert (J6, M5, M11, P1, C23-C25) --------------------

def create_bookings(vehicles: DataFrame, bookings: DataFrame, batch: DataFrame
                    ) -> tuple[DataFrame, DataFrame]:
    """J6 + M5 + M11: new bookings enriched from the vehicle; unknown vehicle
    -> reject. Amount defaults to the vehicle's day price."""
    mm = F.col("m")
    p = batch.withColumn("m", payload_map("payload")).select(
        "seq",
        F.coalesce(_typed(pick(mm, "vehicle", "vehicleId", "vehicle_id", "car", "carId"), "bigint"), F.lit(0)).alias("vehicle"),
        norm_identity(pick(mm, "renterEmail", "renter_email", default="")).alias("renter_email"),
        pick(mm, "renterName", "renter_name", default="").alias("renter_name"),
        pick(mm, "renterId", "renter_id", "renter", default="").alias("renter_id"),
        pick(mm, "startDate", "start_date", "fromDate", "from", default="").alias("start_date"),
        pick(mm, "endDate", "end_date", "toDate", "to", default="").alias("end_date"),
        pick(mm, "amount", "totalPrice", "total_price").try_cast("double").alias("_amount"),
        pick(mm, "status", default="pending").alias("status"),
        pick(mm, "notes", default="").alias("notes"))
    v = vehicles.select(F.col("id").alias("vehicle"), F.col("name").alias("vehicle_name"),
                        "owner_id", "owner_email", "owner_name", "price_per_day")
    rejects = p.join(v, "vehicle", "left_anti").select(
        "seq", F.lit(UNKNOWN_VEHICLE).alias("reason"))
    ok = p.join(v, "vehicle")
    ok = ok.select(
        "*",
        F.coalesce(F.nullif(F.col("renter_id"), F.lit("")), F.col("renter_email")).alias("renter"),
        # an explicit amount wins even when 0; absent -> the day price
        F.coalesce(F.col("_amount"), F.col("price_per_day"), F.lit(0.0)).alias("amount"))
    return conform(next_ids(bookings, ok), "bookings", keep=["seq"]), rejects


# ---- permissions and events (M8, F9, N6) -------------------------------------------

def vehicle_change_permissions(changes: DataFrame, users: DataFrame,
                               vehicles: DataFrame) -> DataFrame:
    """M8 + F9: may the actor apply this vehicle change? Actor must exist and
    be active; role must be owner or admin; owners only on their own
    vehicles. Adds ``accepted`` and ``reason``."""
    a = users.select(F.col("id").alias("actor_id"), F.col("role").alias("actor_role"),
                     F.col("active").alias("actor_active"))
    v = vehicles.select(F.col("id").alias("target_id"), F.col("owner_id").alias("target_owner"), F.lit(True).alias("_known"))
    j = changes.join(a, "actor_id", "left").join(v, "target_id", "left")
    reason = (F.when(F.col("actor_role").isNull() | ~F.col("actor_active"), NO_ACTIVE_USER)
              .when(~F.col("actor_role").isin("owner", "admin"), OWNERS_ONLY)
              .when((F.col("action") != "create") & F.col("_known").isNull(), UNKNOWN_VEHICLE)
              .when((F.col("actor_role") == "owner") & (F.col("action") != "create")
                    & (F.col("target_owner") != F.col("actor_id").cast("string")),
                    NOT_OWN_VEHICLE))
    return j.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_known")


def user_change_permissions(changes: DataFrame, users: DataFrame) -> DataFrame:
    """M8 for users: only an active admin may list, patch or delete users, and
    the target must exist (a list has none). ``changes`` has seq, actor_id,
    action in {'list', 'patch', 'delete'}, target_id."""
    a = users.select(F.col("id").alias("actor_id"), F.col("role").alias("actor_role"), F.col("active").alias("actor_active"))
    t = users.select(F.col("id").alias("target_id"), F.lit(True).alias("_known"))
    j = changes.join(a, "actor_id", "left").join(t, "target_id", "left")
    return j.withColumn("reason", _user_change_reason(F.coalesce("_known", F.lit(False)))).withColumn("accepted", F.col("reason").isNull()).drop("_known")


def _user_change_reason(known: Column) -> Column:
    return (F.when(F.col("actor_role").isNull() | ~F.col("actor_active"), NO_ACTIVE_USER)
            .when(F.col("actor_role") != "admin", ADMINS_ONLY)
            .when((F.col("action") != "list") & ~known, UNKNOWN_ID))


def user_changes_as_of(changes: DataFrame, users: DataFrame, states: DataFrame) -> DataFrame:
    """M8 as of each change: as ``user_change_permissions``, but the actor and
    the target are as ``states`` (id, seq, role, active, gone) left them."""
    return asof.permitted_users(changes, users, states, _user_change_reason(F.col("known")))


def user_changes_in_order(changes: DataFrame, users: DataFrame) -> DataFrame:
    """M8 with changes judged one by one: an admin who is deactivated, demoted
    or deleted by an accepted change is refused from then on. ``changes`` has
    seq, actor_id, action, target_id, role and active (null: not changed)."""
    return asof.changes_in_order(changes, users, _user_change_reason(F.col("known")))


def event_envelopes(rows: DataFrame, type_: Column, action: Column, id_: Column,
                    payload: Column) -> DataFrame:
    """{type, action, id, payload JSON} per accepted change."""
    return rows.select(type_.alias("type"), action.alias("action"), id_.cast("long").alias("id"),
                       F.to_json(payload).alias("payload"))


# ---- nested fields (N2-N4) and backfill (M9) ----------------------------------------

def unknown_reports(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """M12 for N3 and N4: comments and checkouts of reports that don't exist."""
    ids = reports.select(F.col("id").alias("_rid"))
    return (changes.join(ids, changes["report_id"] == ids["_rid"], "left_anti")
            .select(F.col("report_id").alias("id"), "seq", F.lit(UNKNOWN_REPORT).alias("reason")))


def append_comments(reports: DataFrame, new_comments: DataFrame) -> DataFrame:
    """N3 + N2 (``unknown_reports`` has the rejects): append a batch of comments (report_id, seq, author, message,
    createdAt, optional ts) to the stored JSON arrays, in seq order; author
    defaults to 'Anonymous', createdAt to the change's timestamp. Comments are grouped per report (a report row holds all of
    its comments by design)."""
    # time default: the change's own timestamp when the batch carries one
    stamp = (F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
             if "ts" in new_comments.columns else F.lit(""))
    created = (F.coalesce(F.nullif(F.col("createdAt"), F.lit("")), stamp)
               if "createdAt" in new_comments.columns else stamp)
    c = new_comments.select(
        "report_id", "seq",
        F.struct(falsy_default("author", "Anonymous").alias("author"),
                 F.coalesce(F.col("message"), F.lit("")).alias("message"),
                 F.coalesce(created, F.lit("")).alias("createdAt")).alias("c"))
    grouped = c.groupBy("report_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda x: x["c"])
        .alias("added"))
    arr_t = f"array<{COMMENT.simpleString()}>"
    old = F.coalesce(F.from_json(F.nullif(F.col("comments"), F.lit("")), arr_t),
                     F.array().cast(arr_t))
    j = reports.join(grouped, reports["id"] == grouped["report_id"], "left")
    merged = F.when(F.col("added").isNull(), old).otherwise(F.concat(old, F.col("added")))
    return j.select(*[F.coalesce(F.to_json(merged), F.lit("[]")).alias(c) if c == "comments"
                      else F.col(c) for c in reports.columns])


def set_checkout(reports: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Replace the checkout object (JSON text) with the latest one per
    report in the batch. ``unknown_reports`` has the rejects."""
    last = checkouts.groupBy("report_id").agg(F.max_by("checkout", "seq").alias("_co"))
    j = reports.join(last, reports["id"] == last["report_id"], "left")
    return j.select(*[F.coalesce(F.col("_co"), F.col(c)).alias(c) if c == "checkout"
                      else F.col(c) for c in reports.columns])


def backfill(snapshot: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """M9: keyed column backfill from a correction table. A key that is
    corrected more than once takes the correction with the highest ``seq`` (or,
    without that column, the largest value); rows are never multiplied."""
    order = F.col("seq") if "seq" in corrections.columns else F.col(column)
    c = (corrections.filter(F.col(column).isNotNull()).groupBy(F.col(key).alias("_k"))
         .agg(F.max_by(F.col(column), order).alias("_v")))
    j = snapshot.join(c, snapshot[key] == c["_k"], "left")
    return j.select(*[F.coalesce(F.col("_v"), F.col(x)).alias(x) if x == column else F.col(x)
                      for x in snapshot.columns])


def write_snapshot(frame: DataFrame, base_path: str, batch_id: int) -> str:
    """Write a new snapshot folder for this batch (never the folder read).
    Re-running a batch rewrites the same folder: idempotent."""
    path = f"{base_path}/batch={batch_id:012d}"
    frame.write.mode("overwrite").parquet(path)
    return path


# ---- vehicles: insert with defaults (M5, C23, C24, C25, P1) -------------------------

def create_vehicles(vehicles: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5 for vehicles (new rows, rejects of payloads with a bad number): aliases (P1), falsy defaults (C23), availability from
    status when absent (C24, truthiness by boolean parse, C25). The default
    year is the year of the change's own timestamp (the reference takes the
    clock at insert time)."""
    mm, of = F.col("m"), ALIASES["vehicles"]
    p = batch.withColumn("m", payload_map("payload"))
    bad = functools.reduce(lambda x, y: x | y, [
        pick(mm, *of[c]).isNotNull() & _typed(pick(mm, *of[c]), t).isNull()
        for c, t in (("year", "int"), ("price_per_day", "double"), ("seats", "int"))])
    p = p.withColumn("_bad", bad)
    rejects = p.filter("_bad").select("seq", F.lit(BAD_VALUE).alias("reason"))
    name = pick(mm, "name", default=pick(mm, "model", default=""))
    model = pick(mm, "model", default=pick(mm, "name", default=""))
    status = pick(mm, "status", default="available")
    text = ["brand", "photo_uri", "type", "transmission", "fuel", "location", "description", "owner_id", "owner_email", "owner_name"]
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = p.filter(~F.col("_bad")).select(
        "seq", name.alias("name"), model.alias("model"),
        *[pick(mm, *of[c], default="").alias(c) for c in text],
        F.coalesce(F.nullif(_typed(pick(mm, "year"), "int"), F.lit(0)), F.year("ts")).alias("year"),
        F.coalesce(_typed(pick(mm, *of["price_per_day"]), "double"), F.lit(0.0)).alias("price_per_day"),
        F.coalesce(to_bool(mm["available"]), status == "available").alias("available"),
        F.coalesce(_typed(pick(mm, "seats"), "int"), F.lit(0)).alias("seats"),
        pick(mm, *of["approval_status"], default="approved").alias("approval_status"),
        status.alias("status"), stamp.alias("created_at"), stamp.alias("updated_at"))
    return conform(next_ids(vehicles, rows), "vehicles", keep=["seq"]), rejects


# ---- bookings: permissions and bulk clear (M8, M6) ------------------------------------

def booking_change_permissions(changes: DataFrame, users: DataFrame) -> DataFrame:
    """M8 for bookings: the actor must exist and be active; owners cannot
    book; only admins may clear another renter's bookings. ``changes`` has
    (seq, actor_id, action in {'create','clear'}, target_user)."""
    a = users.select(F.col("id").alias("actor_id"), F.col("role").alias("actor_role"),
                     F.col("active").alias("actor_active"))
    j = changes.join(a, "actor_id", "left")
    reason = (F.when(F.col("actor_role").isNull() | ~F.col("actor_active"), NO_ACTIVE_USER)
              .when((F.col("action") == "create") & (F.col("actor_role") == "owner"),
                    OWNER_MAY_NOT_BOOK)
              .when((F.col("action") == "clear") & (F.col("actor_role") != "admin")
                    & (F.col("actor_id") != F.col("target_user")),
                    NOT_OWN_BOOKINGS))
    return j.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def clear_user_bookings(bookings: DataFrame, users_to_clear: DataFrame
                        ) -> tuple[DataFrame, DataFrame]:
    """M6 bulk: remove all bookings of the given renters (column ``user_id``).
    Returns (remaining, removed); the removed rows feed one 'deleted' event
    each."""
    ids = users_to_clear.select(F.col("user_id").cast("string").alias("_uid")).distinct()
    remaining = bookings.join(ids, bookings["renter_id"] == ids["_uid"], "left_anti")
    removed = bookings.join(ids, bookings["renter_id"] == ids["_uid"], "left_semi")
    return remaining, removed


# ---- point lookup and nested answers (F5, N5) -----------------------------------------

def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """F5 for many ids at once: a semi join (Parquet min/max statistics and
    dynamic partition pruning skip files without the ids)."""
    return table.join(ids.select(F.col(key).alias("_k")).distinct(),
                      table[key] == F.col("_k"), "left_semi")


def nested_answer(rows: DataFrame, request_col: str = "request_id") -> DataFrame:
    """N5 nested form: one row per request with its ordered day list. A
    request covers a bounded date range, so its list is small."""
    return rows.groupBy(request_col).agg(
        F.array_sort(F.collect_list(F.struct("date", "predicted_bookings"))).alias("predictions"),
        F.sum("predicted_bookings").cast("long").alias("total_predicted_bookings"),
        F.count(F.lit(1)).alias("number_of_days"))


# ---- log reports: insert with defaults (M5, N1, N2) ---------------------------------

def create_reports(reports: DataFrame, batch: DataFrame) -> DataFrame:
    """M5 for log reports: aliases, numeric defaults 0, nested fields kept
    as normalized JSON text (N2: absent lists -> '[]', labels -> '{}')."""
    mm = F.col("m")
    arr_t = "array<string>"

    def json_list(*keys):
        parsed = F.from_json(pick(mm, *keys), arr_t)
        return F.coalesce(F.to_json(parsed), F.lit("[]"))

    p = batch.withColumn("m", payload_map("payload"))
    num = lambda *k: F.coalesce(pick(mm, *k).try_cast("double"), F.lit(0.0))
    rows = p.select(
        "seq", pick(mm, "type", default="").alias("type"),
        num("vehicleId", "vehicle_id").cast("long").alias("vehicle_id"),
        pick(mm, "vehicleName", "vehicle_name", default="").alias("vehicle_name"),
        num("rentalId", "rental_id").cast("long").alias("rental_id"),
        pick(mm, "renterName", "renter_name", default="").alias("renter_name"),
        pick(mm, "startDate", "start_date", default="").alias("start_date"),
        pick(mm, "endDate", "end_date", default="").alias("end_date"),
        num("amount").alias("amount"),
        json_list("issues").alias("issues"),
        pick(mm, "notes", default="").alias("notes"),
        pick(mm, "odometer", default="").alias("odometer"),
        pick(mm, "fuelLevel", "fuel_level", default="").alias("fuel_level"),
        json_list("photos").alias("photos"),
        F.coalesce(F.to_json(F.from_json(pick(mm, "customLabels", "custom_labels"),
                                         "map<string,string>")), F.lit("{}")).alias("custom_labels"),
        pick(mm, "checkout", default="").alias("checkout"),
        F.coalesce(F.to_json(F.from_json(pick(mm, "comments"),
                                         f"array<{COMMENT.simpleString()}>")),
                   F.lit("[]")).alias("comments"))
    return conform(next_ids(reports, rows), "logreports", keep=["seq"])
