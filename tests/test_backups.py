"""Backups: verification of restored tables, and differences located by descending the digest tree."""

from datetime import datetime

import pytest

from tessera.sources import backups

SCHEMA = "id long, name string, at timestamp, tags array<string>, extra map<string,int>"


def rows_of(n):
    return [(i, f"n{i}" if i % 3 else None, datetime(2024, 1, 1 + i % 9), ["a", str(i)], {"x": i, "y": 1}) for i in range(n)]


def test_restore_is_verified_and_changes_are_located(spark, tmp_path):
    path, good = f"{tmp_path}/b", spark.createDataFrame(rows_of(500), SCHEMA)
    backups.backup(spark, {"t": (good, ["id"]), "u": (good.limit(0), ["id", "name"])}, path)
    back = {n: backups.restored(spark, path, n) for n in "tu"}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # the digest of an instant doesn't depend on it
    try:
        assert backups.verified(spark, path, back) == [("t", "intact"), ("u", "intact")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    changed = rows_of(500)
    changed[7] = (7, "other", *changed[7][2:])
    changed[9] = (*changed[9][:4], {"x": 9, "y": 2})
    del changed[20]
    changed += [(None, None, None, None, None), (600, "new", None, [], {}), changed[30]]
    bad = spark.createDataFrame(changed, SCHEMA)
    assert backups.verified(spark, path, {"t": bad, "v": bad}) == [("t", "differs"), ("u", "missing"), ("v", "unexpected")]
    assert backups.verified(spark, path, {"t": good.drop("extra"), "u": back["u"]})[0] == ("t", "schema")
    leaves = backups.differing_leaves(backups.tree_of(spark, path, "t"), backups.digest_tree(bad, ["id"]))
    assert leaves.count() == 6
    got = {(r["id"], r["change"]) for r in backups.differences(spark, path, "t", bad, ["id"]).collect()}
    assert got == {(7, "changed"), (9, "changed"), (20, "missing"), (31, "changed"), (600, "unexpected"), (None, "unexpected")}
    assert backups.differences(spark, path, "u", bad.limit(0), ["id", "name"]).count() == 0


def test_half_written_backups_are_refused(spark, tmp_path):
    rows = spark.createDataFrame(rows_of(3), SCHEMA)
    with pytest.raises(ValueError, match="no whole backup"):
        backups.manifest(spark, f"{tmp_path}/none")
    backups.backup(spark, {"t": (rows, ["id"])}, f"{tmp_path}/b")
    with pytest.raises(ValueError, match="there is a backup"):
        backups.backup(spark, {"t": (rows, ["id"])}, f"{tmp_path}/b")
