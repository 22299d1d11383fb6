"""Table change operators: edge cases from the fixture list."""

import json

import pytest

from pyspark.sql import functions as F

from fleetcast.operators import tables as TB
from fleetcast.sources import snapshots as SN


def users_df(spark, rows):
    base = [dict(id=i, email=e, username=u, password="p") for i, e, u in rows]
    return SN.conform(spark.createDataFrame(base, "id long, email string, username string, "
                                                  "password string"), "users")


def batch(spark, payloads):
    return spark.createDataFrame([(i + 1, json.dumps(p) if isinstance(p, dict) else p)
                                  for i, p in enumerate(payloads)], "seq long, payload string")


def upserted(spark, users, payloads, **how):
    rows, outcomes = TB.upsert_users(users, batch(spark, payloads), **how)
    return ({r.id: (r.email, r.username, r.first_name, r.seq) for r in rows.collect()},
            {r.seq: (r.outcome, r.id, r.reason) for r in outcomes.collect()})


def test_upsert_matches_case_insensitively_and_rejects(spark):
    users = users_df(spark, [(1, "a@x.t", "alice"), (2, "b@x.t", "bob")])
    rows, outcomes = upserted(spark, users, [
        {"email": "b@x.t", "username": "alice", "password": "p"},            # two users
        {"email": "  A@X.T ", "username": "alice2", "password": "p", "firstName": "Al"},
        {"email": "c@x.t", "username": "carol"},                              # no password
        {"email": "d@x.t", "username": "dan", "password": "p"}])              # new
    assert rows == {1: ("a@x.t", "alice2", "Al", 2), 3: ("d@x.t", "dan", "", 4)}
    assert outcomes == {1: ("rejected", None, TB.SEVERAL_USERS), 2: ("updated", 1, None), 3: ("rejected", None, TB.IDENTITY_MISSING),
                        4: ("inserted", 3, None)}


def test_upsert_frees_and_passes_on_identities(spark):
    users = users_df(spark, [(1, "a@x", "u1")])
    rows, outcomes = upserted(spark, users, [{"email": "a@x", "username": "u9", "password": "p"},
                                             {"email": "z@x", "username": "u1", "password": "p"}])
    assert rows == {1: ("a@x", "u9", "", 1), 2: ("z@x", "u1", "", 2)}
    assert outcomes == {1: ("updated", 1, None), 2: ("inserted", 2, None)}


def one_by_one(stored, payloads):
    """The rule, one change after the other."""
    rows, outcomes, last = dict(stored), {}, max(stored, default=0)
    for seq, p in enumerate(payloads, 1):
        email, name = (p.get("email") or p.get("username") or "").strip().lower(), (p.get("username") or p.get("email") or "").strip().lower()
        if not (email and name and p.get("password")):
            outcomes[seq] = ("rejected", None, TB.IDENTITY_MISSING)
            continue
        found = [i for i, r in rows.items() if r[0] == email or r[1] == name]
        if len(found) > 1:
            outcomes[seq] = ("rejected", None, TB.SEVERAL_USERS)
            continue
        last += not found
        who = found[0] if found else last
        rows[who] = (email, name, p.get("firstName", ""), seq)
        outcomes[seq] = ("updated" if found else "inserted", who, None)
    return {i: r for i, r in rows.items() if len(r) == 4}, outcomes


@pytest.mark.parametrize("seed, names, at_once", [(1, 4, 100), (2, 12, 100), (3, 60, 100), (4, 6, 7), (5, 25, 3)])
def test_upsert_equals_one_by_one(spark, seed, names, at_once):
    import random
    rng = random.Random(seed)
    stored = {i: (f"e{i}@x", f"n{i}") for i in range(1, names // 2 + 1)}
    payloads = [{k: v for k, v in {"email": f"E{rng.randint(1, names)}@x ", "username": f"n{rng.randint(1, names)}", "password": rng.choice(["p", "p", "p", ""]),
                                   "firstName": str(i)}.items() if k != "username" or rng.random() > 0.1} for i in range(60)]
    users = users_df(spark, [(i, *r) for i, r in stored.items()])
    assert upserted(spark, users, payloads, at_once=at_once) == one_by_one(stored, payloads)


def test_upsert_of_nothing(spark):
    users = users_df(spark, [(1, "a@x", "u1")])
    none = batch(spark, [{"email": "a@x"}]).limit(0)
    rows, outcomes = TB.upsert_users(users, none)
    assert rows.count() == 0 and outcomes.count() == 0


def test_groups_of_paths_stars_and_rings(spark):
    from fleetcast.operators.identity import groups
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(500, 500)]
    found = {}
    for r in groups(spark.createDataFrame(edges, "a long, b long")).collect():
        found.setdefault(r.group, set()).add(r.node)
    assert sorted(map(len, found.values())) == [1, 9, 30, 61]


def test_register_rejects_duplicates_and_roles(spark):
    users = users_df(spark, [(1, "a@x.t", "alice")])
    b = batch(spark, [
        {"email": "a@x.t", "username": "z", "password": "p"},                 # exists
        {"email": "n@x.t", "username": "n", "password": "p", "role": "pilot"},
        {"email": "m@x.t", "username": "m", "password": "p"},
        {"email": "m@x.t", "username": "m2", "password": "p"},                # in-batch dup
    ])
    ins, rej = TB.register_users(users, b)
    assert [r.email for r in ins.collect()] == ["m@x.t"]
    reasons = {r.seq: r.reason for r in rej.collect()}
    assert reasons == {1: TB.IDENTITY_TAKEN, 2: TB.UNKNOWN_ROLE, 4: TB.IDENTITY_TAKEN}


def vehicles_df(spark):
    return SN.conform(spark.createDataFrame(
        [(1, "car", 10.0, 4, "here"), (2, "van", 20.0, 7, "there")],
        "id long, name string, price_per_day double, seats int, location string"), "vehicles")


FIELDS = {c: TB.ALIASES["vehicles"][c] for c in ("price_per_day", "seats", "location")}


def test_patch_null_keeps_vs_present_null_wins(spark):
    v = vehicles_df(spark)
    p = spark.createDataFrame([
        (1, 1, '{"pricePerDay": 11.0, "location": null}'),
        (1, 2, '{"seats": 5}'),
        (9, 3, '{"seats": 1}')], "id long, seq long, payload string")
    m3, rej = TB.apply_patches(v, p, "id", FIELDS)
    r = {x.id: x for x in m3.collect()}
    assert (r[1].price_per_day, r[1].seats, r[1].location) == (11.0, 5, "here")
    assert [x.id for x in rej.collect()] == [9]
    m4, _ = TB.apply_patches(v, p, "id", FIELDS, keep_nulls=True)
    r4 = {x.id: x for x in m4.collect()}
    assert r4[1].location is None and r4[1].seats == 5 and r4[2].seats == 7


def test_fold_counts_only_what_follows_the_birth(spark):
    rows = [(1, 1, "create", '{"k":"a","value":"1"}'), (1, 2, "update", '{"k":"b"}'),
            (2, 3, "create", '{"k":"x"}'), (1, 4, "delete", None),
            (1, 5, "update", '{"k":"lost"}'), (1, 6, "create", '{"k":"c"}'),
            (2, 7, "update", '{"value":"9"}'), (3, 8, "update", '{"k":"orphan"}')]
    ch = spark.createDataFrame(rows, "id long, seq long, action string, payload string")
    got = {r.id: (r.k, r.value, r.changes_applied, r.last_seq) for r in TB.fold_change_log(ch, ["k", "value"]).collect()}
    assert got == {1: ("c", None, 1, 6), 2: ("x", "9", 2, 7)}


def test_delete_and_enrichment_rejects(spark):
    b = SN.conform(spark.createDataFrame([(1, 1), (2, 2)], "id long, vehicle long"), "bookings")
    d = spark.createDataFrame([(2, 10), (5, 11)], "id long, seq long")
    rem, removed, rej = TB.delete_rows(b, d)
    assert [r.id for r in rem.collect()] == [1]
    assert [r.id for r in rej.collect()] == [5]
    pay = batch(spark, [{"vehicleId": 1, "renterEmail": " R@X.T "},
                        {"car": 99}, {"vehicle": "2", "amount": 0}])
    new, rj = TB.create_bookings(vehicles_df(spark), b, pay)
    got = sorted((r.id, r.vehicle, r.renter, r.amount) for r in new.collect())
    assert got == [(3, 1, "r@x.t", 10.0), (4, 2, "", 0.0)]
    assert [r.seq for r in rj.collect()] == [2]


def test_append_comments_in_order_with_default_author(spark):
    r = SN.conform(spark.createDataFrame([(1, '[{"author":"a","message":"m0","createdAt":""}]'),
                                          (2, "")], "id long, comments string"), "logreports")
    c = spark.createDataFrame([(1, 3, None, "m2", None), (1, 2, "b", "m1", "t")],
                              "report_id long, seq long, author string, message string, "
                              "createdAt string")
    out = {x.id: json.loads(x.comments) for x in TB.append_comments(r, c).collect()}
    assert [m["message"] for m in out[1]] == ["m0", "m1", "m2"]
    assert out[1][2]["author"] == "Anonymous"
    assert out[2] == []


def test_report_view_malformed_json_defaults(spark):
    r = SN.conform(spark.createDataFrame([(1, "not json", "{bad")],
                                         "id long, issues string, custom_labels string"),
                   "logreports")
    v = TB.report_view(r).first()
    assert v.issues == [] and v.customLabels == {}


def test_ordered_index_is_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("seq"))
    got = TB.ordered_index(df, "seq", "i", buckets=16).select("seq", "i").collect()
    assert sorted(r.i for r in got) == list(range(1, 5001))
    assert all(r.i == r.seq + 1 for r in got)


def test_lookup_clear_and_nested_answer(spark):
    import datetime as dt
    b = SN.conform(spark.createDataFrame([(1, "3"), (2, "5"), (3, "3")],
                                         "id long, renter_id string"), "bookings")
    ids = spark.createDataFrame([(3,), (3,), (9,)], "id long")
    assert sorted(r.id for r in TB.lookup(b, ids).collect()) == [3]
    rem, removed = TB.clear_user_bookings(b, spark.createDataFrame([(3,)], "user_id long"))
    assert sorted(r.id for r in rem.collect()) == [2]
    assert sorted(r.id for r in removed.collect()) == [1, 3]
    rows = spark.createDataFrame([("r", "2020-01-02", 3), ("r", "2020-01-01", 2)],
                                 "request_id string, date string, predicted_bookings int")
    n = TB.nested_answer(rows).first()
    assert [p.date for p in n.predictions] == ["2020-01-01", "2020-01-02"]
    assert (n.total_predicted_bookings, n.number_of_days) == (5, 2)


def test_vehicle_create_defaults(spark):
    import datetime as dt
    v = SN.conform(spark.createDataFrame([(5, "x")], "id long, name string"), "vehicles")
    b = spark.createDataFrame([
        (1, dt.datetime(2021, 3, 1), '{"model": "Corolla", "price": "12.5", "status": "rented"}'),
        (2, dt.datetime(2021, 3, 1), '{"name": "Van", "available": "false", "year": 2019}')],
        "seq long, ts timestamp, payload string")
    out = {r.seq: r for r in TB.create_vehicles(v, b)[0].collect()}
    a, c = out[1], out[2]
    assert (a.id, a.name, a.model, a.year, a.price_per_day, a.available) == \
        (6, "Corolla", "Corolla", 2021, 12.5, False)
    assert (c.id, c.name, c.model, c.year, c.available, c.status) == \
        (7, "Van", "Van", 2019, False, "available")


def test_register_follows_the_order_of_changes(spark):
    users = users_df(spark, [(1, "a@x.t", "alice")])
    b = batch(spark, [
        {"email": "b@x.t", "username": "b", "password": "p", "role": "pilot"},   # refused: does not block the next
        {"email": "b@x.t", "username": "b", "password": "p"},
        {"email": "b@x.t", "username": "c", "password": "p"},                    # refused: does not block the next
        {"email": "c@x.t", "username": "c", "password": "p"},
        {"password": "p"}])
    ins, rej = TB.register_users(users, b)
    assert [(r.seq, r.id) for r in ins.orderBy("seq").collect()] == [(2, 2), (4, 3)]
    assert {r.seq: r.reason for r in rej.collect()} == {1: TB.UNKNOWN_ROLE, 3: TB.IDENTITY_TAKEN, 5: TB.IDENTITY_MISSING}


def test_patch_aliases_bad_values_and_time(spark):
    import datetime as dt
    t = dt.datetime(2024, 5, 6, 7, 8, 9)
    p = spark.createDataFrame([(1, 1, '{"daily_rate": 12.5}', t), (1, 2, '{"pricePerDay": "abc", "seats": 9}', t),
                               (2, 3, '{"price": "7", "seats": "4.0"}', t)], "id long, seq long, payload string, ts timestamp")
    got, rej = TB.apply_patches(vehicles_df(spark), p, "id", FIELDS)
    rows = {r.id: r for r in got.collect()}
    assert (rows[1].price_per_day, rows[1].seats) == (12.5, 4) and (rows[2].price_per_day, rows[2].seats) == (7.0, 4)
    assert rows[1].updated_at == "2024-05-06T07:08:09.000000"
    assert [(r.id, r.seq, r.reason) for r in rej.collect()] == [(1, 2, TB.BAD_VALUE)]


def test_patches_of_users_and_reports(spark):
    users = users_df(spark, [(1, "a@x.t", "alice")])
    p = spark.createDataFrame([(1, 1, '{"firstName": "Al", "active": "false", "photo_url": "/p"}')], "id long, seq long, payload string")
    names = TB.ALIASES["users"]
    u = TB.apply_patches(users, p, "id", {c: names[c] for c in ("first_name", "active", "photo_uri")})[0].first()
    assert (u.first_name, u.active, u.photo_uri) == ("Al", False, "/p")
    reports = SN.conform(spark.createDataFrame([(4, "[]")], "id long, comments string"), "logreports")
    p = spark.createDataFrame([(4, 1, '{"fuelLevel": "half", "issues": ["dent"], "amount": 3}')], "id long, seq long, payload string")
    names = TB.ALIASES["logreports"]
    r = TB.apply_patches(reports, p, "id", {c: names[c] for c in ("fuel_level", "issues", "amount")})[0].first()
    assert (r.fuel_level, json.loads(r.issues), r.amount) == ("half", ["dent"], 3.0)


def test_vehicle_insert_keeps_all_fields_and_refuses_bad_numbers(spark):
    import datetime as dt
    v = SN.conform(spark.createDataFrame([(5, "x")], "id long, name string"), "vehicles")
    fields = {"type": "suv", "transmission": "auto", "fuel": "gas", "location": "L", "description": "D", "ownerName": "O"}
    b = spark.createDataFrame([(1, dt.datetime(2021, 3, 1), json.dumps({"name": "A", **fields})),
                               (2, dt.datetime(2021, 3, 1), '{"name": "B", "seats": "many"}')], "seq long, ts timestamp, payload string")
    new, rej = TB.create_vehicles(v, b)
    r = new.first()
    assert (r.type, r.transmission, r.fuel, r.location, r.description, r.owner_name) == ("suv", "auto", "gas", "L", "D", "O")
    assert r.created_at == "2021-03-01T00:00:00.000000" and [(x.seq, x.reason) for x in rej.collect()] == [(2, TB.BAD_VALUE)]


def test_ids_above_two_to_the_53rd_survive(spark):
    big = 2**53 + 1
    v = SN.conform(spark.createDataFrame([(big, "car")], "id long, name string"), "vehicles")
    b = SN.conform(spark.createDataFrame([(1, 1)], "id long, vehicle long"), "bookings")
    new, rej = TB.create_bookings(v, b, batch(spark, [{"vehicleId": big}]))
    assert new.first().vehicle == big and rej.count() == 0


def test_backfill_never_multiplies_rows(spark):
    v = vehicles_df(spark)
    c = spark.createDataFrame([(1, "/a", 1), (1, "/b", 2), (2, None, 1)], "id long, photo_uri string, seq long")
    assert {r.id: r.photo_uri for r in TB.backfill(v, c, "id", "photo_uri").collect()} == {1: "/b", 2: ""}


def test_comments_and_checkouts_of_unknown_reports_are_rejected(spark):
    r = SN.conform(spark.createDataFrame([(1, "[]")], "id long, comments string"), "logreports")
    c = spark.createDataFrame([(1, 1, "a", "m"), (99, 2, "b", "n")], "report_id long, seq long, author string, message string")
    assert [(x.id, x.seq, x.reason) for x in TB.unknown_reports(r, c).collect()] == [(99, 2, TB.UNKNOWN_REPORT)]
    assert TB.append_comments(r, c).count() == 1


def test_comment_time_defaults_to_change_timestamp(spark):
    import datetime as dt
    r = SN.conform(spark.createDataFrame([(1, "[]")], "id long, comments string"), "logreports")
    c = spark.createDataFrame([(1, 1, "a", "m", None, dt.datetime(2024, 1, 2, 3, 4, 5)),
                               (1, 2, "b", "n", "given", dt.datetime(2024, 1, 2, 3, 4, 6))],
                              "report_id long, seq long, author string, message string, "
                              "createdAt string, ts timestamp")
    out = json.loads(TB.append_comments(r, c).first().comments)
    assert [x["createdAt"] for x in out] == ["2024-01-02T03:04:05.000000", "given"]


def test_create_reports_defaults_and_nested_fields(spark):
    r = SN.conform(spark.createDataFrame([(4, "[]")], "id long, comments string"), "logreports")
    b = batch(spark, [
        {"type": "checkin", "vehicleId": 7, "issues": ["scratch", "dent"],
         "customLabels": {"zone": "A"}, "checkout": {"km": 10}},
        {"vehicle_id": "3", "amount": "12.5"},
    ])
    out = {x.seq: x for x in TB.create_reports(r, b).collect()}
    a, c = out[1], out[2]
    assert (a.id, a.type, a.vehicle_id, a.amount) == (5, "checkin", 7, 0.0)
    assert json.loads(a.issues) == ["scratch", "dent"] and json.loads(a.custom_labels) == {"zone": "A"}
    assert json.loads(a.checkout) == {"km": 10}
    assert (c.id, c.type, c.vehicle_id, c.amount, c.issues, c.comments) == (6, "", 3, 12.5, "[]", "[]")
