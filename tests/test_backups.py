"""Backups: of one moment, only whole ones count, checked before anything is put back."""

import shutil

import pytest
from notelake.sources import index as indexes
from notelake.sources.backups import Backups, Damaged, digest
from notelake.sources.storage import VersionedTable
from test_index import chunks


@pytest.fixture
def tables(spark, tmp_path):
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=8)
    index.ensure()
    index.upsert(chunks(spark, range(30)))
    state = VersionedTable(spark, f"{tmp_path}/s", "relative_path string, content_hash string")
    state.overwrite(spark.createDataFrame([(f"{i}.md", f"n{i}") for i in range(30)], state.schema))
    return {"index": index.table, "state": state}


def contents(tables):
    return {k: sorted(map(str, t.read().collect())) for k, t in tables.items()}


def test_restore(spark, tmp_path, tables):
    backups, before = Backups(spark, f"{tmp_path}/b"), contents(tables)
    with pytest.raises(FileNotFoundError):
        backups.restore(tables)
    notes = spark.createDataFrame([("a.md", "text", None), ("b.md", None, {"x": "y"})], "relative_path string, raw string, fm map<string,string>")
    first = backups.make(tables, {"notes": notes})
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=8)
    index.upsert(chunks(spark, range(20, 40), "changed"))
    index.delete_notes(spark.createDataFrame([("n3",)], "note_id string"))
    tables["state"].overwrite(spark.createDataFrame([("x.md", "n")], tables["state"].schema))
    after = contents(tables)
    second = backups.make(tables)
    assert backups.complete() == [first, second] and before != after
    assert backups.restore(tables, first) == first and contents(tables) == before
    assert index.table.holding("note_title", ["changed 25"]) == set() and len(index.table.holding("note_title", ["t 25"])) == 1
    assert sorted(map(str, backups.read(first, "notes").collect())) == sorted(map(str, notes.collect()))
    assert backups.restore(tables) == second and contents(tables) == after
    with pytest.raises(KeyError):
        backups.restore({**tables, "notes": tables["state"]}, second)
    assert backups.prune(0) == [] and backups.prune(1) == [first] and backups.complete() == [second]


def test_empty_tables(spark, tmp_path):
    index, state = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=2), VersionedTable(spark, f"{tmp_path}/s", "a int")
    backups, tables = Backups(spark, f"{tmp_path}/b"), {"index": index.table, "state": state}
    name = backups.make(tables)
    index.ensure()
    index.upsert(chunks(spark, range(3)))
    state.overwrite(spark.createDataFrame([(1,)], "a int"))
    backups.restore(tables, name)
    assert index.count() == 0 and state.read().count() == 0


def test_killed_backup(spark, tmp_path, tables, monkeypatch):
    """A backup that is killed after the first table has no manifest: the one before is restored."""
    backups, before = Backups(spark, f"{tmp_path}/b"), contents(tables)
    whole = backups.make(tables)
    tables["state"].overwrite(tables["state"].read().limit(1))
    plain = backups._copied

    def killed(name, table, rows):
        if table == "state":
            raise KeyboardInterrupt
        return plain(name, table, rows)

    monkeypatch.setattr(backups, "_copied", killed)
    with pytest.raises(KeyboardInterrupt):
        backups.make(tables)
    monkeypatch.undo()
    broken = sorted(p.name for p in (tmp_path / "b").iterdir())[-1]
    assert broken != whole and backups.complete() == [whole]
    with pytest.raises(KeyError):
        backups.restore(tables, broken)
    assert backups.restore(tables) == whole and contents(tables) == before
    later = backups.make(tables)
    assert backups.prune(1) == [whole, broken] and backups.complete() == [later]


def test_damaged_backup(spark, tmp_path, tables):
    """Nothing is touched by a restore of a backup that lost a file or has other rows."""
    backups = Backups(spark, f"{tmp_path}/b")
    name = backups.make(tables)
    tables["state"].overwrite(tables["state"].read().limit(2))
    now = contents(tables)
    part = next((tmp_path / "b" / name / "state").glob("part-*.parquet"))
    kept = part.read_bytes()
    part.unlink()
    with pytest.raises(Damaged):
        backups.restore(tables)
    part.write_bytes(kept[:-9])
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Damaged):
        backups.restore(tables)
    shutil.rmtree(part.parent)
    with pytest.raises(Damaged):
        backups.restore(tables)
    assert contents(tables) == now


def test_one_moment(spark, tmp_path, tables, monkeypatch):
    """A version that is removed while it is copied begins the backup anew; pointers that move are read again."""
    backups, state = Backups(spark, f"{tmp_path}/b"), tables["state"]
    plain, moves = backups._copied, []

    def meanwhile(name, table, rows):
        if table == "state" and not moves:
            for i in range(4):  # more than stay for readers
                moves.append(state.overwrite(spark.createDataFrame([(f"{i}.md", "new")], state.schema)))
        return plain(name, table, rows)

    monkeypatch.setattr(backups, "_copied", meanwhile)
    name = backups.make(tables)
    assert [r["content_hash"] for r in backups.read(name, "state").collect()] == ["new"] and backups._names() == [name]
    assert backups.manifest(name)["tables"]["state"]["version"] == state.version == moves[-1]
    pin, seen = state.pin, []

    def moving():
        seen.append(1)
        return "other" if len(seen) == 2 else pin()

    monkeypatch.setattr(state, "pin", moving)
    assert backups._pins(tables)["state"] == pin() and len(seen) == 4


def test_digest(spark):
    """Neither order nor files tell, values, nulls and repeated rows do."""
    df = spark.createDataFrame([(1, None, [1.0]), (2, "b", None), (2, "b", None)], "a int, b string, `c d` array<double>")
    assert digest(df) == digest(df.repartition(3).orderBy("b")) and digest(df)["rows"] == "3"
    others = [df.distinct(), df.fillna("x"), df.selectExpr("a + 1 as a", "b", "`c d`")]
    assert len({str(digest(x)) for x in [df, *others]}) == 4
