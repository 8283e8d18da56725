"""Continuous apply and versioned tables: any order, any repeats, and a death between any two steps."""

import os
import random
import tempfile

import pytest

from cloakwork.sources import versions
from cloakwork.sources.versions import Lost, Versions
from cloakwork.streaming import changes as chg
from cloakwork.streaming.live import LiveTable

SCHEMA = "id long, table_name string, op string, pk map<string,string>, values map<string,string>, captured_at timestamp_ntz"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def feed_rows(draw, n=300, keys=25):
    rows = []
    for i in range(n):
        op = draw.choice("IUUUUD")
        values = {} if op == "D" else {c: draw.choice([None, str(draw.randrange(99))]) for c in draw.sample(["amount", "k", "other"], 2)}
        pk = {"user": str(draw.randrange(keys)), "at": draw.choice("ab")} if i % 40 else draw.choice([None, {}, {"user": "x", "at": "a"}])
        rows.append((i, draw.choice(["users", "USERS", "else"]), op, pk, values, None))
    return rows


def base(spark):
    return spark.createDataFrame([(u, a, u * 10, "k0") for u in range(15) for a in "ab"], "user int, at string, amount int, k string")


def as_set(frame):
    return sorted(map(str, frame.select("user", "at", "amount", "k").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_and_number(spark, seed):
    draw = random.Random(seed)
    rows = feed_rows(draw)
    feed = spark.createDataFrame(rows, SCHEMA)
    keyed = feed.where("size(pk) = 2 AND pk['user'] <> 'x'")
    want = as_set(chg.replay(base(spark), keyed, "users", ["user", "at"]))
    table = LiveTable(spark, folder(), "users", ["user", "at"], buckets=4, deltas=3)
    table.create(base(spark))
    assert as_set(table.read()) == as_set(base(spark))
    draw.shuffle(rows)
    batches = [rows[i::5] for i in range(5)]
    for number, batch in enumerate([*batches, batches[1]]):
        table.apply(spark.createDataFrame(batch, SCHEMA), number)
        assert number or int(table.versions.latest()["note"].get("skipped", 1))
        pending = [n.split("/")[1] for n in table.versions.parts() if n.startswith("delta/")]
        assert all(pending.count(b) < 3 for b in pending)
    assert as_set(table.read()) == want
    table.compact()
    assert as_set(table.read()) == want and not any(n.startswith("delta/") for n in table.versions.parts())
    assert table.apply(spark.createDataFrame([], SCHEMA), 9) is None


def test_only_changed_buckets_are_rewritten(spark):
    table = LiveTable(spark, folder(), "users", ["user", "at"], buckets=8, deltas=1)
    table.create(base(spark))
    before = table.versions.parts()
    table.apply(spark.createDataFrame([(1, "users", "U", {"user": "3", "at": "a"}, {"k": "new"}, None)], SCHEMA))
    after = table.versions.parts()
    assert len({n for n in before if before[n] != after.get(n)}) == 1 and set(after) == set(before)
    assert table.read().where("k = 'new'").collect()[0]["amount"] == 30


def test_nothing_comes_back_from_before_a_delete(spark):
    table = LiveTable(spark, folder(), "users", ["user", "at"], buckets=1, deltas=2)
    table.create(base(spark))
    pk = {"user": "3", "at": "a"}
    for change in [(9, "users", "D", pk, {}, None), (5, "users", "U", pk, {"k": "old"}, None), (12, "users", "U", pk, {"amount": "7"}, None), (10, "users", "I", pk, {"k": "new", "amount": "1"}, None)]:
        table.apply(spark.createDataFrame([change], SCHEMA))
    assert [tuple(r) for r in table.read().where("user = 3 AND at = 'a'").select("amount", "k").collect()] == [(7, "new")]


@pytest.mark.parametrize("death", ["commit", "write"])
def test_a_death_leaves_the_table_before(spark, monkeypatch, death):
    table = LiveTable(spark, folder(), "users", ["user", "at"], buckets=2, deltas=2)
    table.create(base(spark))
    batch = spark.createDataFrame([(1, "users", "U", {"user": "3", "at": "a"}, {"k": "new"}, None)], SCHEMA)

    def die(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(Versions if death == "commit" else LiveTable, "commit" if death == "commit" else "_write", die)
        with pytest.raises(RuntimeError):
            table.apply(batch)
        with pytest.raises(RuntimeError):
            table.compact()
    assert as_set(table.read()) == as_set(base(spark))
    table.apply(batch)
    table.apply(batch)  # the second delta compacts its bucket
    assert table.read().where("k = 'new'").count() == 1
    live = {p.split("/data/")[1].split("/")[0] for p in table.versions.parts().values()}
    assert live <= set(os.listdir(os.path.join(table.versions.root, "data")))


def test_rewrite_survives_a_death_between_its_steps(spark, monkeypatch):
    root = folder()
    versions.store(spark, root, spark.range(10).repartition(5))
    for step in ("attempt", "folder", "commit"):
        with monkeypatch.context() as patched:
            def die(*_, **__):
                raise RuntimeError(step)

            patched.setattr(Versions, step, die)
            with pytest.raises(RuntimeError):
                versions.rewrite(spark, root, lambda rows: rows.where("id < 5"))
        assert versions.read(spark, root).count() == 10
    with monkeypatch.context() as patched:  # dead before cleaning: the new table is in force already
        patched.setattr(Versions, "clean", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            versions.rewrite(spark, root, lambda rows: rows.where("id < 5").coalesce(1))
    assert sorted(r["id"] for r in versions.read(spark, root).collect()) == [0, 1, 2, 3, 4]
    versions.rewrite(spark, root, lambda rows: rows.where("id < 3"), keep=1)
    assert versions.read(spark, root).count() == 3 and len(os.listdir(os.path.join(root, "data"))) == 1


def test_of_two_writers_one_is_told(spark):
    root = folder()
    versions.store(spark, root, spark.range(3))
    one, two = Versions(spark, root), Versions(spark, root)
    a, b = one.attempt(), two.attempt()
    for v, name, rows in ((one, a, 4), (two, b, 5)):
        spark.range(rows).write.parquet(v.folder(name))
    one.commit(a, {"table": a})
    with pytest.raises(Lost):
        two.commit(b, {"table": b})
    assert versions.read(spark, root).count() == 4
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder())
