"""Planned scan: odd names, line ends, files in several ranges; what an ingest opens."""

import random

import pytest
from pyspark.sql import functions as F

from assayloom.operators import catalog
from assayloom.plans.ingest import CATALOG, ingest
from assayloom.sources import files, registry, scan, text

NAMES = ["plain.txt", "with space.txt", "a [1] {b}*.txt", "ü%20 #?+.txt", "back\\slash.txt"]


@pytest.fixture()
def narrow(spark):
    """Files are cut into ranges of 2,000 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_equal_whole_texts(narrow, tmp_path):
    r = random.Random(1)
    for k, name in enumerate(NAMES):
        ends = ["\n", "\r\n", "\n", "\r\n", "\n"][k]
        (tmp_path / name).write_bytes(ends.join("é" * r.randrange(60) + "z" * (k % 2) for _ in range(300)).encode() + (b"" if k % 2 else ends.encode()))
    listed = files.list_files(narrow, str(tmp_path))
    assert sorted(p.path.rsplit("/", 1)[1] for p in listed.collect()) == sorted(NAMES)
    lines = scan.staged_lines(text.readable(listed), str(tmp_path / "staged"))
    raw = narrow.read.parquet(str(tmp_path / "staged"))
    assert raw.select("source_file", "part").distinct().count() > 2 * len(NAMES)
    want = text.lines_of(text.read_texts(narrow, str(tmp_path)))
    order = lambda df: sorted(tuple(x) for x in df.select("source_file", "line_no", "line").collect())
    assert order(lines) == order(want) and lines.count() == 300 * len(NAMES)


def test_waves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "WAVE", 3)
    for k in range(8):
        (tmp_path / f"{k}.txt").write_text(f"a{k}\nb{k}\n")
    got = scan.staged_lines(files.list_files(spark, str(tmp_path)), str(tmp_path / "staged"))
    assert sorted((r["line_no"], r["line"]) for r in got.collect()) == sorted((i, f"{c}{k}") for k in range(8) for i, c in enumerate("ab"))
    assert scan.staged_lines(files.list_files(spark, str(tmp_path)).limit(0), str(tmp_path / "none")).count() == 0


def test_readers_on_files_in_ranges(narrow, tmp_path):
    """A reader's rows of a file that several tasks read equal those of the whole text."""
    body = "".join(f" {k} {k}.0 {20 + k % 7}.0 {k}.5\n\n" for k in range(600))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "run 1.txt").write_text("x\n Index t Tr Value\n [s] [°C] [mW]\n" + body + "Results\n 1 2 3 4\n")
    (tmp_path / "raw" / "bad.txt").write_text("Index t Tr Value\n [s] [°C] [mW]\n" + body + " 1 2\n")
    (tmp_path / "raw" / "table.csv").write_text("\n\nq,I\n" + "".join(f"{k},{k}.5\n" for k in range(900)))
    lines = scan.staged_lines(files.list_files(narrow, str(tmp_path / "raw")), str(tmp_path / "staged"))
    whole = text.read_lines(narrow, str(tmp_path / "raw"))
    for kind in (("dsc", "prior"), ("saxs", "anton_paar"), ("dsc", "default")):
        (a, x), (b, y) = text.parsed(lines, *kind), text.parsed(whole, *kind)
        rows = lambda df: sorted(map(str, df.select("source_file", "row_idx", "raw").collect()))
        assert rows(a) == rows(b) and sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert text.parsed(lines, "dsc", "prior")[0].count() == 600


def bytes_read(spark):
    jvm = spark.sparkContext._jvm
    return sum(s.getBytesRead() for s in jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file")


def test_only_wanted_files_are_opened(spark, tmp_path, monkeypatch):
    """One new experiment, and a refresh of 10, among 300: the others' 30 MB stay closed."""
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    for k in range(300):
        (raw / "box" / f"r{k}").mkdir(parents=True)
        body = "skip\ncm-1,%T\n" + f"{k},1.5\n"
        (raw / "box" / f"r{k}" / "scan 1.csv").write_text(body if k < 12 else body + f"{k},2.5,{'#' * 100_000}\n")
    ins = spark.createDataFrame([("f", "ftir", "bruker", "box"), ("g", "ftir", "bruker", "gone")], "name string, type string, model string, folder_name string")
    reg = registry.experiments(spark.createDataFrame([(f"e{k}", "f", f"r{k}") for k in range(300)] + [("other", "g", "r1")], "name string, instrument_name string, raw_data_filename string"))
    opened = []
    real = scan.raw_lines
    monkeypatch.setattr(scan, "raw_lines", lambda s, paths: opened.extend(paths) or real(s, paths))
    before = bytes_read(spark)
    got = ingest(spark, reg.filter("name in ('e0', 'other')"), ins, str(raw), store).collect()
    assert {r["name"]: (r["status"], r["reason"]) for r in got} == {"e0": ("persisted", None), "other": ("failed", "raw file not found")}
    assert [p.rsplit("/", 2)[1] for p in opened] == ["r0"]
    ingest(spark, reg.filter("name = 'e0'"), ins, str(raw), store)
    assert len(opened) == 1  # registered: nothing is read
    ten = [f"e{k}" for k in range(1, 11)]
    ingest(spark, reg.filter(F.col("name").isin(ten)), ins, str(raw), store, refresh=True)
    assert sorted(p.rsplit("/", 2)[1] for p in opened[1:]) == sorted(f"r{k}" for k in range(1, 11))
    assert bytes_read(spark) - before < 8_000_000  # tables and catalogue, not the 29 MB of the others
    assert catalog.Table(spark, f"{store}/catalog", CATALOG).read().count() == 11
    assert {r["transmittance_pct"] for r in spark.read.parquet(f"{store}/data/ftir").collect()} == {1.5} or spark.read.parquet(f"{store}/data/ftir").count() == 11
