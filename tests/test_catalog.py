"""Ingest end to end, catalogue, comparison, series, registry rules and the stream."""

import pytest
from pyspark.sql import functions as F

from assayloom.operators import catalog, compare, features, series, validate
from assayloom.plans import datasets
from assayloom.plans.ingest import BAD_FILES, CATALOG, ingest
from assayloom.sources import registry
from assayloom.plans import ingest as plan
from assayloom.streaming.ingest import ingest_new, run_incremental

INSTRUMENTS = '[{"type": "dsc", "model": "prior", "name": "DSC", "characterizer": {"type": "dsc_profiling", "sensitivity": 0.1}}, {"type": "tga", "model": "tgaX", "name": "tga", "characterizer": {"type": "tga"}}]'


@pytest.fixture()
def lab(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "DSC").mkdir(parents=True)
    (raw / "TGA").mkdir()
    body = "".join(f" {k} {k}.0 {20 + abs(5 - k)}.0 {k}.5\n" for k in range(10))
    (raw / "DSC" / "one").mkdir()
    (raw / "DSC" / "one" / "run.txt").write_text("x\n Index t Tr Value\n [s] [°C] [mW]\n" + body + "Results\n")
    (raw / "TGA" / "two.txt").write_text("Index t Tr Mass\n[#] [s] [°C] [mg]\n0 1.0 20.0 10.0\n1 2.0 30.0 5.0\n")
    (tmp_path / "ins.json").write_text(INSTRUMENTS)
    (tmp_path / "reg.csv").write_text("name,instrument_name,raw_data_filename,sample_id\nexp one,dsc,one,S001\nexp two,tga,two,S002\nlost,dsc,nowhere,S001\nplain,,x,\n")
    exps = registry.experiments(registry.read_registry(spark, str(tmp_path / "reg.csv")))
    return exps, registry.read_instruments(spark, str(tmp_path / "ins.json")), str(raw), str(tmp_path / "store")


def test_ingest_and_compare(spark, lab):
    exps, ins, raw, store = lab
    got = {r["name"]: (r["status"], r["reason"]) for r in ingest(spark, exps, ins, raw, store).collect()}
    assert got == {"exp one": ("persisted", None), "exp two": ("persisted", None), "lost": ("failed", "raw file not found"), "plain": ("skipped", "no instrument")}
    table = catalog.Table(spark, f"{store}/catalog", CATALOG)
    now = table.read()
    assert {r["experiment_name"]: r["rows"] for r in now.collect()} == {"exp one": 10, "exp two": 2}
    again = {r["name"]: r["status"] for r in ingest(spark, exps, ins, raw, store).collect()}
    assert again["exp one"] == "registered" and again["exp two"] == "registered"
    data, missing = compare.load_experiments(spark, now, f"{store}/data/dsc", ["exp one", "no such"])
    assert data.count() == 10 and missing == ["no such"] and data.select("comparison_label").distinct().count() == 1
    assert data.filter("profile is null").count() == 0
    with pytest.raises(ValueError):
        compare.load_experiments(spark, now, f"{store}/data/dsc", [])
    both, _ = datasets.load_samples(spark, exps, now, f"{store}/data/dsc", ["S001"])
    assert both.count() == 10 and datasets.list_datasets(now, limit=5).count() == 2 and datasets.get_dataset(now, "exp one").count() == 1
    with pytest.raises(KeyError):
        datasets.get_dataset(now, "nothing")
    views = catalog.register_views(spark, now)
    assert len(views) == 2 and catalog.query(spark, f"select count(*) as n from {views[0]}").first()["n"] in (2, 10)
    assert catalog.remove(spark, now, now.first()["table_name"]).count() == 1
    with pytest.raises(KeyError):
        catalog.remove(spark, now, "nothing")
    tga = spark.read.parquet(f"{store}/data/tga").orderBy("row_idx").collect()
    assert [r["mass_pct"] for r in tga] == [100.0, 0.0]


def test_ingest_of_many_instruments(spark, tmp_path):
    """Steps of single instruments reach the store, broken files are named, the raw folder is staged once, a second store gets a copy."""
    raw, store, second = tmp_path / "raw", str(tmp_path / "store"), tmp_path / "second"
    for name, body in {
        "m/Scan.bsc": "11,4\n10.5,3\n10.5,9\nPeak\n11,4\nEnd\n",
        "u/run_012.txt": "title\nWavelength nm.\tAbs.\n200\t0.5\n",
        "f/ok.csv": "skip\ncm-1,%T\n400,1.5\n", "f/broken.csv": "skip\ncm-1,%T\n400,oops\n",
        "g/broken.csv": "skip\ncm-1,%T\n400,oops\n",
    }.items():
        (raw / name).parent.mkdir(parents=True, exist_ok=True)
        (raw / name).write_text(body)
    kinds = [("ms", "bruker"), ("uv_vis", "Shimadzu"), ("ftir", "bruker")]
    ins = spark.createDataFrame([(k, k, m) for k, m in kinds], "name string, type string, model string")
    reg = spark.createDataFrame([("spectrum", "ms", "m"), ("titration", "uv_vis", "u"), ("half", "ftir", "f"), ("none", "ftir", "g")], "name string, instrument_name string, raw_data_filename string")
    got = {r["name"]: (r["status"], r["reason"]) for r in ingest(spark, registry.experiments(reg), ins, str(raw), store, second=str(second)).collect()}
    assert got == {"spectrum": ("persisted", None), "titration": ("persisted", None), "half": ("persisted", "some files left out: a value is no number"), "none": ("failed", "no file could be read: a value is no number")}
    ms = spark.read.parquet(f"{store}/data/ms").orderBy("row_idx").collect()
    assert [(r["mz"], r["intensity_a_u"], r["peaks"], r["name"]) for r in ms] == [(10.5, 3.0, False, "scan"), (11.0, 4.0, True, "scan")]
    uv = spark.read.parquet(f"{store}/data/uv_vis").first()
    assert (uv["titrant"], uv["name"], uv["wavelength_nm"]) == ("12", "u", 200.0)
    assert spark.read.parquet(f"{second}/data/ftir").count() == 1 and not list((tmp_path / "store" / "staging").iterdir())
    bad = catalog.Table(spark, f"{store}/bad_files", BAD_FILES).read()
    assert {r["source_file"].rsplit("/", 2)[1] for r in bad.collect()} == {"f", "g"}


def test_dual_write_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("i", "e", 1.0)], "instrument_name string, experiment_id string, v double")
    assert catalog.write_twice(df, str(tmp_path / "a"), str(tmp_path / "b")) is None
    (tmp_path / "file").write_text("x")
    assert catalog.write_twice(df, str(tmp_path / "a"), str(tmp_path / "file" / "c"))
    other = spark.createDataFrame([("i", "f", 2.0)], df.schema)
    catalog.write_measurements(other, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    path = catalog.snapshot(spark.createDataFrame([("x",), ("y",)], ["name"]), ["y"], str(tmp_path / "runs"), "r1")
    assert [r["name"] for r in spark.read.parquet(path).collect()] == ["y"]


def test_validate_registry(spark):
    reg = spark.createDataFrame([("a", "DSC", "a", "S001", None), ("b", "nope", "b c", "X1", None), (None, "dsc", "d", None, None), ("a", None, "e", None, None), ("f", "dma", "f", "S002", "flow-curve"), ("g", "dma", "g", "S002", "Frequency Sweep")], "name string, instrument_name string, raw_data_filename string, sample_id string, measurement_profile string")
    ins = spark.createDataFrame([("dsc", "dsc", "prior"), ("dma", "dma", "ta_q800")], "name string, type string, model string")
    rows, problems, total = validate.validate_registry(reg.coalesce(1), ins, spark.createDataFrame([("dsc", "prior"), ("dma", "ta_q800")], "type string, model string"))
    got = {(r["name"], r["instrument_name"]): r for r in rows.collect()}
    assert got[("a", "DSC")]["valid"] and not got[("b", "nope")]["valid"] and {e["field"] for e in got[("b", "nope")]["errors"]} == {"instrument_name", "sample_id"}
    assert got[(None, "dsc")]["errors"][0]["field"] == "name" and got[("a", None)]["valid"] and got[("a", None)]["warnings"]
    assert got[("f", "dma")]["warnings"] and got[("g", "dma")]["measurement_profile"] == "oscillatory_frequency_sweep"
    assert {r["message"] for r in problems.collect()} == {"duplicate name 'a'", "unsafe file name 'b c'"}
    assert tuple(total.first()) == (6, 4, 2)
    marked, _, _ = validate.validate_registry(reg.coalesce(1), ins, spark.createDataFrame([("dsc", "prior"), ("dma", "ta_q800")], "type string, model string"), mark_first=True)
    assert {r["row_number"]: len(r["errors"]) for r in marked.collect()}[1] == 2


def test_profiles_match(spark):
    known = spark.createDataFrame([(p,) for p in ("oscillatory_frequency_sweep", "oscillatory_temperature_sweep", "flow_curve")], "canonical string")
    asked = ["Frequency Sweep", "temperature", "sweep", "flow-curve", "oscillatory_freq_sweep", "FLOW_CURVE"]
    got = {r["profile"]: r["canonical"] for r in validate.match_profiles(spark.createDataFrame([(a,) for a in asked], "profile string"), known).collect()}
    assert got == {"Frequency Sweep": "oscillatory_frequency_sweep", "temperature": "oscillatory_temperature_sweep", "sweep": "oscillatory_frequency_sweep", "flow-curve": "flow_curve", "oscillatory_freq_sweep": None, "FLOW_CURVE": "flow_curve"}


def test_profiles_match_by_an_inverted_index(spark):
    """Random token sets, one token in all of them, against the rules one by one; no join without a key."""
    import random
    import re

    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    names = sorted({"_".join(["sweep", *r.sample(words, r.randrange(1, 5))]) for _ in range(1500)} | {"Sweep-One", "sweep_one"})
    asked = sorted({r.choice(["-", " ", "_"]).join(r.sample([*words, "sweep", "SWEEP"], r.randrange(1, 4))) for _ in range(1500)} | {*names[:40], *(n.upper() for n in names[40:80]), *(n.replace("_", " ").title() for n in names[80:120]), "", "nothing here", "sweep one"})

    def told(text):
        tokens = lambda x: set(re.findall("[a-z0-9]+", x.lower()))
        rules = [[n for n in names if n == text], [n for n in names if n.lower() == text.lower()], [n for n in names if n.lower() == text.lower().replace(" ", "_").replace("-", "_")]]
        for found in rules:
            if found:
                return min(found)
        found = [n for n in names if tokens(text) and tokens(text) <= tokens(n)]
        return min(found, key=lambda n: (len(tokens(n)), n.lower(), n), default=None)

    out = validate.match_profiles(spark.createDataFrame([(a,) for a in [*asked, None]], "profile string"), spark.createDataFrame([(n,) for n in names], "canonical string"))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["profile"]: r["canonical"] for r in out.collect()} == {a: told(a) for a in asked} | {None: None}


def test_grouping(spark):
    rows = [(w, 1.0, t, s) for t in ("t1", "t2") for w, s in ((200, "a"), (250, "b"), (300, "c"))]
    df = spark.createDataFrame(rows, "wavelength_nm int, absorbance_a_u double, timestamp string, other string")
    assert features.infer_group(df, "wavelength_nm", ["absorbance_a_u"]) == ("timestamp", [])
    out, told = series.series(df, "uv_vis")
    assert told["group"] == "timestamp" and out.select("group").distinct().count() == 2
    assert features.infer_group(df, "wavelength_nm", ["absorbance_a_u"], "other")[0] == "other"
    out, told = series.series(df, "uv_vis", group_by="other", max_groups=2)
    assert out.count() == 0 and told["warnings"]
    twin = df.withColumn("copy", F.col("timestamp"))
    assert features.infer_group(twin, "wavelength_nm", ["absorbance_a_u"])[0] == "timestamp" and features.infer_group(twin, "wavelength_nm", ["absorbance_a_u"])[1]
    with pytest.raises(ValueError):
        features.infer_group(df, "wavelength_nm", [], max_groups=1)
    with pytest.raises(ValueError):
        features.infer_group(df, "wavelength_nm", [], "nothing")
    assert features.infer_group(df.filter("timestamp = 't1'"), "wavelength_nm", ["absorbance_a_u"]) == (None, [])


def test_modes():
    assert compare.resolved_mode("auto", ["x", "x"]) == "overlay" and compare.resolved_mode("auto", ["x", "y"]) == "facet"
    for bad in (("overlay", ["x", "y"], None), ("stacked", ["x", "x"], 0), ("pie", ["x"], None)):
        with pytest.raises(ValueError):
            compare.resolved_mode(*bad)


def test_kinds():
    assert series.kind_of(["mz", "intensity_a_u"]) == "ms"
    assert series.axes_of(["temperature_C", "frequency_hz", "storage_modulus_mpa"], "dma", "oscillatory_temperature_sweep")[0] == "temperature_C"
    assert series.axes_of(["shear_rate_s_inv", "shear_stress_pa", "viscosity_pa_s"], "rheometer", "flow_curve")[1] == ["shear_stress_pa", "viscosity_pa_s"]
    with pytest.raises(ValueError):
        series.axes_of(["temperature_C"], "dsc")


def test_union_of_unlike_types(spark):
    a, b = spark.createDataFrame([(1,)], ["x"]), spark.createDataFrame([("t", 2.0)], ["x", "y"])
    assert sorted((r["x"], r["y"]) for r in compare.union_all([a, b]).collect()) == [("1", None), ("t", 2.0)]
    assert dict(compare.union_all([a, b]).dtypes) == {"x": "string", "y": "double"}


def test_stream_gives_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("1")
    (src / "b.txt").write_text("2")
    got = []
    take = lambda df, k: got.extend(r["value"] for r in df.collect())
    assert run_incremental(spark, str(src), str(tmp_path / "cp"), take) == 1 and sorted(got) == ["1", "2"]
    (src / "c.txt").write_text("3")
    run_incremental(spark, str(src), str(tmp_path / "cp"), take)
    assert sorted(got) == ["1", "2", "3"]


def store_of(spark, store):
    """What a store holds, without times and paths."""
    known = catalog.Table(spark, f"{store}/catalog", CATALOG).read()
    data = [sorted(map(str, spark.read.parquet(f"{store}/data/{k}").select("experiment_id", "row_idx", "temperature_C", *([c] if (c := {"dsc": "profile", "tga": "mass_pct"}[k]) else [])).collect())) for k in ("dsc", "tga")]
    runs = catalog.Table(spark, f"{store}/runs", plan.RUNS).read()
    bad = catalog.Table(spark, f"{store}/bad_files", BAD_FILES).read()
    plain = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    return plain(known, "experiment_id", "experiment_name", "table_name", "rows"), data, plain(runs, "experiment_id", "name", "status", "reason"), plain(bad, "experiment_id", "reason")


WHOLE = []


@pytest.mark.parametrize("dies", [None, ("update", "catalog"), ("append", "runs")])
def test_stream_to_the_catalogue(spark, lab, tmp_path, monkeypatch, dies):
    """A batch that dies between store and catalogue, or between two tables, is run again and nothing is doubled."""
    exps, ins, raw, store = lab
    (tmp_path / "raw" / "DSC" / "one" / "bad.txt").write_text("no data")
    stream = lambda: ingest_new(spark, exps, ins, raw, store, str(tmp_path / "checkpoint"))
    if dies:
        real = getattr(catalog.Table, dies[0])

        def die(self, *args, **kw):
            if self.root.endswith(dies[1]):
                raise RuntimeError("killed here")
            return real(self, *args, **kw)

        with monkeypatch.context() as m:
            m.setattr(catalog.Table, dies[0], die)
            with pytest.raises(Exception, match="killed here"):
                stream()
    assert stream() == 1 and stream() == 0
    if not WHOLE:
        ingest(spark, exps.filter("name in ('exp one', 'exp two')"), ins, raw, str(tmp_path / "whole"))
        WHOLE.append(store_of(spark, str(tmp_path / "whole")))
    assert store_of(spark, store) == WHOLE[0]
    if not dies:
        body = (tmp_path / "raw" / "DSC" / "one" / "run.txt").read_text()
        (tmp_path / "raw" / "DSC" / "one" / "run 2.txt").write_text(body)  # one more file of a known run: it is read anew as a whole
        assert stream() == 1
        now = catalog.Table(spark, f"{store}/catalog", CATALOG).read()
        assert {r["experiment_name"]: r["rows"] for r in now.collect()} == {"exp one": 20, "exp two": 2}


def test_many_views_are_read_in_batches(spark, tmp_path):
    """all views are read, in the plan of a batch each; of one name the last row's table stays; many tables are removed by one join."""
    for k in range(7):
        spark.range(k + 1).withColumn("y", F.lit(float(k))).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    rows = [(f"batched {k}", f"{tmp_path}/{k}", "id long, y double" if k % 2 else None) for k in (0, 1, 2, 3, 4, 5, 6, 99)]
    known = spark.createDataFrame(rows, "table_name string, storage_path string, columns string")
    left = catalog.remove_all(spark, known, known.filter("table_name in ('batched 2', 'batched 4')"))
    made = catalog.register_views(spark, left)
    assert sorted(made) == [f"batched_{k}" for k in (0, 1, 3, 5, 6)]
    got = catalog.query_views(spark, made, "y", "select dataset, count(*) as n, sum(y) as total from {views} group by dataset", size=2)
    assert sorted(map(tuple, got.collect())) == [(f"batched_{k}", k + 1, float(k * (k + 1))) for k in (0, 1, 3, 5, 6)]
    with pytest.raises(KeyError):
        catalog.remove_all(spark, known, spark.createDataFrame([("batched 1",), ("none",)], "table_name string"))
    again = spark.createDataFrame([("batched x", f"{tmp_path}/{k}", None) for k in (0, 5, 3)], known.schema).coalesce(1)
    assert spark.table(catalog.register_views(spark, again)[0]).count() == 4


def test_views_of_the_same_columns_are_one_scan(spark, tmp_path):
    """F2 of round 4: views and queries over them cost a scan for each set of columns, not for each table; a view has its own files only."""
    def write(name, n, **more):
        spark.range(n).withColumns({"y": F.lit(float(n)), **more}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    for k in range(1, 25):
        write(f"t {k}+%é", k, **({"z": F.lit(1)} if k % 2 else {}))
    write("t 1+%é/below", 100, z=F.lit(1))  # a folder within a table's
    write("t 11", 50)  # its name begins as that of the others'
    write("mixed", 3), write("mixed", 4, z=F.lit(1))  # files of unlike columns
    (tmp_path / "empty").mkdir()
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.parquet").write_text("none")
    paths = [*[f"t {k}+%é" for k in range(1, 25)], "t 1+%é/below", "t 11", "mixed", "empty", "text", "gone", "t 2*", "t 3+%é"]
    known = spark.createDataFrame([(f"one scan {i}", f"{tmp_path}/{p}", "id long, y double" if i % 5 == 0 or p == "empty" else None) for i, p in enumerate(paths)], "table_name string, storage_path string, columns string")
    made = catalog.register_views(spark, known)
    rows = {p: k for k, p in ((k, f"t {k}+%é") for k in range(1, 25))} | {"t 1+%é": 101, "t 1+%é/below": 100, "t 11": 50, "mixed": 7, "empty": 0, "t 2*": sum((2, 20, 21, 22, 23, 24))}
    want = {f"one_scan_{i}": rows[p] for i, p in enumerate(paths) if p in rows}
    assert sorted(made) == sorted(want) and len(made.scans) <= 4
    assert {v: spark.table(v).count() for v in made} == want
    assert "z" in spark.table("one_scan_26").columns and spark.table("one_scan_1").columns == ["id", "y"]
    got = catalog.query_views(spark, made, "y", "select dataset, count(*) as n, sum(y) as total from {views} group by dataset", size=2)
    assert {r["dataset"]: r["n"] for r in got.collect()} == {v: n for v, n in want.items() if n}


def test_many_new_files_are_one_batch(spark, tmp_path):
    """1,200 files are one ingest, not one for every thousand."""
    (tmp_path / "raw" / "box").mkdir(parents=True)
    for k in range(1200):
        (tmp_path / "raw" / "box" / f"r{k}.csv").write_text(f"skip\ncm-1,%T\n{k},1.5\n")
    ins = spark.createDataFrame([("f", "ftir", "bruker", "box")], "name string, type string, model string, folder_name string")
    reg = registry.experiments(spark.createDataFrame([("e", "f", "box")], "name string, instrument_name string, raw_data_filename string"))
    assert ingest_new(spark, reg, ins, str(tmp_path / "raw"), str(tmp_path / "store"), str(tmp_path / "cp")) == 1
    assert spark.read.parquet(str(tmp_path / "store" / "data" / "ftir")).count() == 1200


def test_owners_of_new_files_are_found_once(spark, tmp_path, monkeypatch):
    """F3 of round 4: the ingest of a batch doesn't list the new files' folders again each time it asks for its experiments."""
    from assayloom.streaming import ingest as stream

    for k in range(3):
        (tmp_path / "raw" / f"r{k}").mkdir(parents=True)
        (tmp_path / "raw" / f"r{k}" / "a.csv").write_text(f"skip\ncm-1,%T\n{k},1.5\n")
    ins = spark.createDataFrame([("f", "ftir", "bruker")], "name string, type string, model string")
    reg = registry.experiments(spark.createDataFrame([(f"e{k}", "f", f"r{k}") for k in range(4)], "name string, instrument_name string, raw_data_filename string"))
    seen = []
    monkeypatch.setattr(stream, "ingest", lambda spark, experiments, *args, **kw: seen.append((experiments._jdf.queryExecution().executedPlan().toString(), sorted(r["name"] for r in experiments.collect()))))
    assert stream.ingest_new(spark, reg, ins, str(tmp_path / "raw"), str(tmp_path / "store"), str(tmp_path / "cp")) == 1
    (plan, names), = seen
    assert names == ["e0", "e1", "e2"] and "binaryFile" not in plan
