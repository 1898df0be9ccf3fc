"""Alert tables and snapshots across calls, broken writes and races."""

import pytest
from pyspark.sql import functions as F

from flowsentry.sources import alert_table as AT
from flowsentry.sources import sinks
from flowsentry.sources.alert_table import AlertTable


def alerts(make, *rows):
    return make([(f"2024-01-01 00:00:{s:02d}", kind) for s, kind in rows], "ts string, type string")


def state(table, version=None):
    return [(r.id, r.type, r.acknowledged) for r in table.read(version).orderBy("id").collect()]


def test_ids_go_on_and_acknowledgements_stay(spark, make, tmp_path):
    table = AlertTable(spark, str(tmp_path))
    assert table.append(alerts(make, (5, "b"), (1, "a"))) == (1, 3)
    table.acknowledge(spark.createDataFrame([(2,), (2,), (9,)], "id long"))
    again = AlertTable(spark, str(tmp_path))  # another process
    assert again.append(alerts(make, (0, "c"))) == (3, 4)
    assert state(again) == [(1, "a", False), (2, "b", True), (3, "c", False)]
    assert state(again, 1) == [(1, "a", False), (2, "b", False)]
    again.compact()
    again.acknowledge(spark.createDataFrame([(3,)], "id long"))
    assert again.append(alerts(make)) == (4, 4) and again.append(alerts(make, (7, "d"))) == (4, 5)
    assert state(again) == [(1, "a", False), (2, "b", True), (3, "c", True), (4, "d", False)]
    assert len(again.manifest()["alerts"]) == 3 and state(again, 3)[0] == (1, "a", False)


def test_a_broken_write_is_not_seen(spark, make, tmp_path, monkeypatch):
    table = AlertTable(spark, str(tmp_path))
    table.append(alerts(make, (1, "a")))
    monkeypatch.setattr(AT, "put_once", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.append(alerts(make, (2, "b")))
    monkeypatch.undo()
    assert state(table) == [(1, "a", False)] and table.append(alerts(make, (3, "c"))) == (2, 3)


def test_of_two_writers_both_are_kept(spark, make, tmp_path, monkeypatch):
    one, other = AlertTable(spark, str(tmp_path)), AlertTable(spark, str(tmp_path))
    one.append(alerts(make, (1, "a")))
    put, raced = AT.put_once, []

    def late(*args):
        if not raced:
            raced.append(True)
            other.append(alerts(make, (2, "b")))
        return put(*args)

    monkeypatch.setattr(AT, "put_once", late)
    assert one.append(alerts(make, (3, "c"))) == (3, 4)
    assert state(one) == [(1, "a", False), (2, "b", False), (3, "c", False)]
    with pytest.raises(ValueError):
        AlertTable(spark, str(tmp_path / "none")).read()


def test_snapshots_are_whole(spark, tmp_path, monkeypatch):
    schema = spark.range(1).schema
    tables = {"a": spark.range(3), "b": spark.range(5)}
    assert sinks.save_snapshot(tables, str(tmp_path)) == 1
    monkeypatch.setattr(sinks, "put_once", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.save_snapshot({"a": spark.range(30), "b": spark.range(50)}, str(tmp_path))
    monkeypatch.undo()
    loaded = sinks.load_snapshot(spark, str(tmp_path), {"a": schema, "b": schema})
    assert (loaded["a"].count(), loaded["b"].count()) == (3, 5)
    assert sinks.save_snapshot({**tables, "a": spark.range(7)}, str(tmp_path)) == 2
    assert sinks.load_snapshot(spark, str(tmp_path), {"a": schema})["a"].agg(F.count("*")).first()[0] == 7
    assert sinks.load_snapshot(spark, str(tmp_path), {"a": schema}, number=1)["a"].count() == 3
