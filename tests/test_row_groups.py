"""Row groups of damaged files, and a study's ledger."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.plans import models
from tidemark.plans.ledger import Ledger, digest_of
from tidemark.sources import files, row_groups


def damage(path, group):
    """Overwrite a row group's pages."""
    meta = pq.ParquetFile(path).metadata.row_group(group).column(0)
    begin = min(x for x in (meta.data_page_offset, meta.dictionary_page_offset) if x is not None)
    data = bytearray(path.read_bytes())
    data[begin : begin + meta.total_compressed_size] = b"\xff" * meta.total_compressed_size
    path.write_bytes(data)


@pytest.fixture
def folder(tmp_path):
    for f in range(3):
        t = pa.table({"message_id": pa.array(range(100 * f, 100 * f + 100), pa.int64()), "v": [str(i % 7) for i in range(100)], "other": [1.5] * 100})
        pq.write_table(t if f else t.drop_columns(["v"]), tmp_path / f"part{f}.parquet", row_group_size=25)
    return tmp_path


def test_damaged_group(spark, folder):
    damage(folder / "part1.parquet", 2)
    (folder / "part3.parquet").write_bytes(b"no parquet")
    (folder / "_SUCCESS").write_bytes(b"")
    found = row_groups.scan(spark, f"file://{folder}", "v string, message_id long")
    assert found.rdd.getNumPartitions() == 13
    assert sorted(r["message_id"] for r in row_groups.rows(found).collect()) == [i for i in range(300) if not 150 <= i < 175]
    assert {r["v"] for r in row_groups.rows(found).where("message_id < 100").collect()} == {None}
    bad = sorted((r["file"].rsplit("/", 1)[1], r["row_group"]) for r in row_groups.quarantined(found).collect())
    assert bad == [("part1.parquet", 2), ("part3.parquet", -1)]
    one = row_groups.scan(spark, str(folder / "part2.parquet"), "message_id long")
    assert row_groups.rows(one).agg(F.sum("message_id")).first()[0] == sum(range(200, 300)) and row_groups.quarantined(one).count() == 0


def test_no_files(spark, tmp_path):
    found = row_groups.scan(spark, str(tmp_path), "message_id long")
    assert row_groups.rows(found).count() == 0 and row_groups.quarantined(found).count() == 0


def test_ledger(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "a int, b int")
    assert digest_of(df) == digest_of(df.repartition(5)) != digest_of(df.where("a > 0"))
    built = []

    def part(n):
        built.append(n)
        return df.where(f"b = {n}")

    for _ in range(2):
        ledger = Ledger(spark, str(tmp_path), digest_of(df))
        for n in (0, 1):
            assert ledger.table(f"part-{n}", {"n": n}, lambda n=n: part(n)).count() == 10
    assert built == [0, 1] and ledger.reused == ["part-0", "part-1"]
    ledger.table("part-0", {"n": 0, "more": True}, lambda: part(0))
    Ledger(spark, str(tmp_path), "other data").table("part-0", {"n": 0}, lambda: part(0))
    assert built == [0, 1, 0, 0]
    (tmp_path / "half-written").mkdir()

    def stops():
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        ledger.table("part-9", {}, stops)
    assert ledger.table("part-9", {}, lambda: part(2)).count() == 10


def test_saved_models(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, float(i % 2) + i % 5 / 10, "test") for i in range(60)], "message_id long, label int, a double, split string")
    fits = []

    def fit():
        fits.append(1)
        return models.classifier("rf", ["a"], numTrees=3, maxDepth=2).fit(models.weighted(df))

    found = []
    for _ in range(2):
        ledger = Ledger(spark, str(tmp_path), "x")
        found.append(models.scored(ledger.model("fold-0", {"k": 1}, fit), df).orderBy("message_id").collect())
    assert found[0] == found[1] and len(fits) == 1 and ledger.reused == ["fold-0"]
    assert not [p for p in tmp_path.iterdir() if p.name.count("-") > 2]


def test_files_without_rows_are_not_corrupt(spark, tmp_path):
    """A writer's first task leaves a file of no rows where the first split of its input has none."""
    whole = pa.table({"message_id": ["1", "2"]})
    for name, t in (("a", whole), ("b [1]", whole.slice(0, 0))):
        pq.write_table(t, tmp_path / f"{name}.parquet")
    (tmp_path / "c.parquet").write_bytes(b"PAR1 but no footer")
    (tmp_path / "d.txt").write_bytes(b"no parquet")
    bad = files.corrupt_parts(spark, f"{tmp_path}/*", "message_id string")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in bad.collect()) == ["c.parquet", "d.txt"]
    (tmp_path / "c.parquet").unlink()
    (tmp_path / "d.txt").unlink()
    assert files.corrupt_parts(spark, f"{tmp_path}/*", "message_id string").count() == 0


def test_many_groups_share_tasks(spark, tmp_path):
    """Thousands of small groups aren't a task each, nor a footer read each; a damaged one is still set aside by itself."""
    for f in range(2):
        pq.write_table(pa.table({"message_id": pa.array(range(3000 * f, 3000 * f + 3000), pa.int64())}), tmp_path / f"part{f}.parquet", row_group_size=2)
    damage(tmp_path / "part1.parquet", 700)
    found = row_groups.scan(spark, str(tmp_path), "message_id long")
    assert found.rdd.getNumPartitions() <= 2 * row_groups.SINGLE
    assert sorted(r["message_id"] for r in row_groups.rows(found).collect()) == [i for i in range(6000) if i not in (4400, 4401)]
    assert [(r["file"].rsplit("/", 1)[1], r["row_group"]) for r in row_groups.quarantined(found).collect()] == [("part1.parquet", 700)]


def test_runs():
    assert list(row_groups.runs([], 5)) == [] and list(row_groups.runs([1, 1], 0)) == [(0, 0), (1, 1)]
    assert list(row_groups.runs([3, 2, 9, 1, 1, 4], 5)) == [(0, 1), (2, 2), (3, 4), (5, 5)]
