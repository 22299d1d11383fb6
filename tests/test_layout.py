"""Tables laid out by id: lookups and patches touch only the folders of their ids."""

import glob
import json
import os

from conftest import SMALL
from fleetcast.operators import tables as TB
from fleetcast.sources import layout as L
from fleetcast.sources import snapshots as SN


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}


def test_lookup_reads_the_folders_of_its_ids(spark, tmp_dir):
    users, path = SN.users(spark, SMALL), f"{tmp_dir}/users"
    L.write_by_id(users, path, span=6)
    assert len(files(path)) >= 50
    ids = spark.createDataFrame([(3,), (3,), (13,), (99999,), (None,)], "id long")
    got = L.lookup_by_id(spark, path, SN.SCHEMAS["users"], ids, span=6)
    assert got.schema.fieldNames() == users.schema.fieldNames()
    assert sorted(r.id for r in got.collect()) == [3, 13]
    read = L.read_by_id(spark, path, SN.SCHEMAS["users"], ids, span=6)
    want = users.filter("cast(floor(id / 6) as long) in (0, 2)").count()
    assert read.count() == want < users.count() / 10
    assert "PartitionFilters: [part" in read._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "").replace("#", " ")
    assert L.read_by_id(spark, path, SN.SCHEMAS["users"], ids.limit(0), span=6).count() == 0
    assert L.read_by_id(spark, path, SN.SCHEMAS["users"]).exceptAll(users).count() == 0


def test_more_ranges_than_named_are_all_read(spark, tmp_dir, monkeypatch):
    users, path = SN.users(spark, SMALL), f"{tmp_dir}/users"
    L.write_by_id(users, path, span=6)
    monkeypatch.setattr(L, "MOST_PARTS", 3)
    ids = users.select("id")
    assert L.lookup_by_id(spark, path, SN.SCHEMAS["users"], ids, span=6).count() == users.count()


def test_patch_writes_the_folders_of_its_ids(spark, tmp_dir):
    users, path = SN.users(spark, SMALL), f"{tmp_dir}/users"
    L.write_by_id(users, path, span=6)
    before = files(path)
    patches = spark.createDataFrame([(3, 1, json.dumps({"firstName": "A"})), (3, 2, json.dumps({"firstName": "B"})),
                                     (13, 3, json.dumps({"firstName": "C"})), (99999, 4, json.dumps({"firstName": "D"}))],
                                    "id long, seq long, payload string")
    fields = {"first_name": TB.ALIASES["users"]["first_name"]}
    want, rejected = TB.apply_patches(users, patches, "id", fields)
    for _ in range(2):                                     # a retried batch
        rejects = L.patch_by_id(spark, path, SN.SCHEMAS["users"], patches, fields, span=6)
    got = L.read_by_id(spark, path, SN.SCHEMAS["users"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, rejects.collect())) == sorted(map(str, rejected.collect()))
    kept = {f for f, t in files(path).items() if before.get(f) == t}
    assert len(before) - len(kept) == 2
