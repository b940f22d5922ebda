import csv
import io

import numpy as np
import pytest

from kinfold.sources import tables
from kinfold.sources.files import list_files
from kinfold.sources.records import csv_records, open_after


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that quoted cells go over their borders."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def set_to(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "64")

    yield set_to
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def rows_of(text):
    """With Python's reader; line breaks inside of cells as single line feeds, empty lines left out."""
    found = csv.reader(io.StringIO(text.replace("\r\n", "\n"), newline=""))
    return [r for r in found if r]


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('"a,b', True, False), ('a"b,c', False, False), ('"a""b"', False, False), ('x,"y', True, False), ('"",""', False, True),
    ('a,"b""', True, False), ("", False, True), ('"', True, False), ('""', False, True), (',"a",b"c,"d', True, True),
])
def test_state_of_a_line(line, outside, inside):
    assert open_after(line, False) is outside
    if line not in ('a"b,c', '"a""b"', '"",""', ',"a",b"c,"d'):  # inside, these are no well-formed ends of a cell
        assert open_after(line, True) is inside


@pytest.mark.parametrize(("seed", "block"), [(0, 7), (1, 23), (2, 100), (3, 7), (0, 1 << 20)])
def test_records_equal_a_sequential_reader(spark, tmp_path, small_blocks, seed, block):
    rng = np.random.default_rng(seed)
    cells = ["a", "", "x y", 'q"q', "l\nf", "two\n\nlines", "c,d", '"', "é", "long " * 9, "\n", 'e""']
    sep = "\r\n" if seed == 3 else "\n"
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=sep)
    writer.writerow(["image_path", "species\nand more", "z"])
    for _ in range(60):
        row = [str(rng.choice(cells)) for _ in range(3)]
        writer.writerow(["p" + row[0], *row[1:]])
        if rng.random() < 0.1:
            out.write(sep)
    (tmp_path / "m.csv").write_bytes(out.getvalue().encode())
    small_blocks(block)
    raw, _ = tables.read_manifest_csv(spark, str(tmp_path / "m.csv"))
    header, *want = rows_of(out.getvalue())
    assert len(raw.columns) == 3 and raw.columns[0] == header[0]
    assert sorted(tuple(r) for r in raw.collect()) == sorted(map(tuple, want))
    if block == 7:
        assert csv_records(spark, str(tmp_path / "m.csv")).rdd.getNumPartitions() > 8


def test_a_cell_over_many_blocks_and_files(spark, tmp_path, small_blocks):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f'k,v\n{name}1,"' + "line\n" * 200 + f'"\n{name}2,"x\ny"\n')
    small_blocks(16)
    raw, _ = tables.read_manifest_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in raw.collect()) == sorted((f"{n}{i}", v) for n in "ab" for i, v in ((1, "line\n" * 200), (2, "x\ny")))


def test_large_files_are_read_by_many_tasks(spark, tmp_path, small_blocks):
    (tmp_path / "m.csv").write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(20_000)))
    small_blocks(20_000)
    raw, _ = tables.read_manifest_csv(spark, str(tmp_path / "m.csv"))
    plain = spark.read.option("header", True).csv(str(tmp_path / "m.csv")).rdd.getNumPartitions()
    assert csv_records(spark, str(tmp_path / "m.csv")).rdd.getNumPartitions() >= plain > 8
    assert raw.count() == 20_000 and raw.where("b <> concat('x\n', a)").count() == 0


def test_folders_are_listed_by_tasks(spark, tmp_path):
    for d in range(100):
        folder = tmp_path / f"d{d:02d}" / "deep"
        folder.mkdir(parents=True)
        for i in range(100):
            (folder / f"{i}.png").touch()
    (tmp_path / "top.png").write_text("1234")
    found = list_files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 25 and found.count() == 10_001
    assert found.where("size = 4").first()["path"] == f"{tmp_path}/top.png"
    assert found.select("path").distinct().count() == 10_001
    assert {r[0] for r in tables.listing(spark, str(tmp_path / "d07"), "1?.png").collect()} == {f"{tmp_path}/d07/deep/1{i}.png" for i in range(10)}


def test_empty_folder(spark, tmp_path):
    assert list_files(spark, str(tmp_path)).collect() == []


def test_files_that_one_task_reads_are_kept_apart(spark, tmp_path):
    """Blocks of several files that begin at the same byte: each file has a header and quoted cells of its own."""
    folder = tmp_path / "parts"
    folder.mkdir()
    want = []
    for i in range(4):
        rows = [[f"p{i}{j}", "two\nlines" if (i + j) % 2 else "plain", ""] for j in range(3)]
        want += rows
        with (folder / f"part-{i}.csv").open("w", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows([["image_path", "species", "z"], *rows])
    name = "spark.sql.files.minPartitionNum"
    spark.conf.set(name, "1")
    try:
        records = csv_records(spark, str(folder))
        assert records.where("first").count() == 4
        raw, _ = tables.read_manifest_csv(spark, str(folder))
        assert sorted(list(r) for r in raw.collect()) == want
    finally:
        spark.conf.unset(name)
