"""Raw readers on generated exports, each with a malformed twin."""

import pytest
from pyspark.sql import functions as F

from assayloom.sources import files, registry, text


def write(folder, **named):
    for name, body in named.items():
        p = folder / name.replace("__", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body, encoding="utf-8")


def read(spark, folder, kind, model):
    rows, bad = text.parsed(text.read_lines(spark, str(folder)), kind, model)
    got = {}
    for r in rows.orderBy("source_file", "row_idx").collect():
        got.setdefault(r["source_file"].rsplit("/", 1)[1], []).append(r["raw"])
    return got, {r["source_file"].rsplit("/", 1)[1] for r in bad.collect()}


def test_dsc_prior(spark, tmp_path):
    write(tmp_path, good__txt="pre\n Index t Tr Value\n [s] [°C] [mW]\n 1 0.0 25.0 1.5\n 2 1.0 26.0 1.6\nResults:\n 9 9 9 9\n", bad__txt="Index t Tr Value\n [s] [°C] [mW]\n1 2\n", skip__pdf="x")
    got, bad = read(spark, tmp_path, "dsc", "prior")
    assert got == {"good.txt": [{"Index": "1", "t [s]": "0.0", "Tr [°C]": "25.0", "Value [mW]": "1.5"}, {"Index": "2", "t [s]": "1.0", "Tr [°C]": "26.0", "Value [mW]": "1.6"}]}
    assert bad == {"bad.txt"}


def test_dsc_others(spark, tmp_path):
    write(tmp_path / "p", a__txt="x\n\tTime\tProgram Temperature\n\t(s)\t(C)\n1\t2\t3\n", b__txt="no marker\n")
    got, bad = read(spark, tmp_path / "p", "dsc", "perkin_elmer")
    assert len(got["a.txt"]) == 1 and bad == {"b.txt"}
    write(tmp_path / "m", a__txt="x\n   Index  t  Tr\n  [#]  [s]  [°C]\n  0  1.0  25\n  1  2.0  26\n")
    got, _ = read(spark, tmp_path / "m", "dsc", "mettler_toledo")
    assert got["a.txt"][1] == {"Index [#]": "1", "t [s]": "2.0", "Tr [°C]": "26"}


def test_dma_ftir_ms_sec_saxs(spark, tmp_path):
    write(tmp_path / "dma", a__txt="h\nSig1\tTime (min)\nSig2\tTemperature (C)\nStartOfData\n1.0\t30\n2.0\t31\n")
    assert read(spark, tmp_path / "dma", "dma", "ta_q800")[0]["a.txt"] == [{"time (min)": "1.0", "temperature (c)": "30"}, {"time (min)": "2.0", "temperature (c)": "31"}]
    write(tmp_path / "ftir", a__csv="skip me\ncm-1,%T\n400,1.5\n401,1.6\n", b__csv="skip\ncm-1,%T\n400,oops\n")
    got, bad = read(spark, tmp_path / "ftir", "ftir", "bruker")
    assert list(got) == ["a.csv"] and bad == {"b.csv"}
    write(tmp_path / "ms", A__bsc="11,4\n10.5,3\n12,1\n10.5,9\nPeak list\n11,4\n7\nEnd\n13,1\nPeak\n12,1\nEnd\n")
    lines = text.read_lines(spark, str(tmp_path / "ms"))
    rows, _ = text.parsed(lines, "ms", "bruker")
    got = rows.orderBy("row_idx").collect()
    assert [(r["raw"]["m/z"], r["raw"]["intensity"], r["peaks"], r["name"]) for r in got] == [("10.5", "3", False, "a"), ("11", "4", True, "a"), ("12", "1", True, "a"), ("13", "1", False, "a")]
    assert sorted(r["mz"] for r in text.peak_list(lines).collect()) == [11.0, 12.0]
    write(tmp_path / "sec", run_RID1A__csv="0.1,5\n0.2,x\n0.3,6\n")
    got, _ = read(spark, tmp_path / "sec", "sec", "agilent")
    assert [r["detector_name"] for r in got["run_RID1A.csv"]] == ["ri", "ri"]
    write(tmp_path / "saxs", a__csv="q,I,dI\n1,2,3\n4,,6\n")
    assert read(spark, tmp_path / "saxs", "saxs", "anton_paar")[0]["a.csv"] == [{"q": "1", "I": "2", "dI": "3"}]


def test_rheometer_and_spectra(spark, tmp_path):
    head = "".join(f"line{k}\n\n" for k in range(4))
    write(tmp_path / "r", x__csv=head + "Interval data:\tPoint No.\tTime\tG'\nignored\n\t\t[s]\t[Pa]\n\t1\t0.5\t10\n\t2\t1.0\n\t3\t2\t3\t4\t5\n")
    got, _ = read(spark, tmp_path / "r", "rheometer", "anton_paar")
    assert got["x.csv"] == [{"Time [s]": "0.5", "G' [Pa]": "10"}, {"Time [s]": "1.0"}]
    write(tmp_path / "f", **{"s_1-250__txt": "Date: Fri Jan 05 10:00:00 CET 2024\nNumber of Pixels in Spectrum: 3\n>>>>>\n100\t1\n300\t2\n400\t3\n"})
    rows, _ = text.parsed(text.read_lines(spark, str(tmp_path / "f")), "uv_vis", "flame")
    got = rows.orderBy("row_idx").collect()
    assert [r["raw"]["wavelength (nm)"] for r in got] == ["300", "400"] and str(got[0]["timestamp"]) == "2024-01-05 09:00:00.250000"
    write(tmp_path / "u", t_007__txt="title\nWavelength nm.\tAbs.\n200\t0.5\n")
    assert read(spark, tmp_path / "u", "uv_vis", "Shimadzu")[0]["t_007.txt"] == [{"Wavelength nm.": "200", "Abs.": "0.5"}]


def test_csv_branch_titrant_and_decoded_spectra(spark, tmp_path):
    write(tmp_path / "t", a__csv="Temperature,Weight [mg],note\n20,10.0,x\n30,,y\n", b__txt="Index t Tr Mass\n[#] [s] [°C] [mg]\n0 1.0 20.0 10.0\n")
    got, bad = read(spark, tmp_path / "t", "tga", "tgaX")
    assert [r["Weight [mg]"] for r in got["a.csv"]] == ["10.0", None] and got["b.txt"][0]["Mass [mg]"] == "10.0" and not bad
    write(tmp_path / "p", a__csv="Time,Program Temperature\n1,2\n")
    assert read(spark, tmp_path / "p", "dsc", "default")[0]["a.csv"] == [{"Time": "1", "Program Temperature": "2"}]
    write(tmp_path / "u", dna_007__txt="title\nWavelength nm.\tAbs.\n200\t0.5\n")
    row = text.parsed(text.read_lines(spark, str(tmp_path / "u")), "uv_vis", "Shimadzu")[0].first()
    assert (row["titrant"], row["name"]) == ("7", "u")
    write(tmp_path / "n", a__jsonl='{"ppm": [1.5, 2.5, null], "intensity": [3.0, null, null]}\n', b__jsonl='{"ppm": [1], "intensity": [1, 2]}', c__jsonl="{oops", d__jsonl="\n")
    got, bad = read(spark, tmp_path / "n", "nmr", "bruker_nmr")
    assert got == {"a.jsonl": [{"ppm": "1.5", "intensity": "3.0"}, {"ppm": "2.5"}]} and bad == {"b.jsonl", "c.jsonl", "d.jsonl"}


def test_spectrum_arrays(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], [3.0, 4.0]), ("b", [1.0], [1.0, 2.0]), ("c", None, [1.0])], "source_folder string, ppm array<double>, i array<double>")
    rows, bad = text.explode_spectrum(df, "ppm", "i", ["source_folder"])
    assert rows.count() == 2 and {r["source_folder"] for r in bad.collect()} == {"b", "c"}


def test_plug_in(spark, tmp_path):
    @text.parser("own", "x")
    def mine(lines):
        return lines.select("source_file", F.col("line_no").alias("row_idx"), F.create_map(F.lit("v"), F.col("line")).alias("raw"))

    write(tmp_path, a__txt="1\n2\n")
    assert read(spark, tmp_path, "own", "x")[0] == {"a.txt": [{"v": "1"}, {"v": "2"}]}
    with pytest.raises(KeyError):
        text.parsed(text.read_lines(spark, str(tmp_path)), "no", "such")


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,instrument_name,sample_id,description,operator\na,DSC ,S001,frequency sweep,me\nb,,S002,,\n")
    reg = registry.experiments(registry.read_registry(spark, str(tmp_path / "r.csv"))).orderBy("name").collect()
    assert reg[0]["instrument_name"] == "dsc" and reg[0]["run_id"] == "R001" and reg[0]["raw_data_filename"] == "a"
    assert reg[0]["measurement_profile"] == "oscillatory_frequency_sweep" and reg[0]["metadata"] == {"description": "frequency sweep", "operator": "me"}
    (tmp_path / "bad.csv").write_text("name\na\n")
    with pytest.raises(ValueError):
        registry.read_registry(spark, str(tmp_path / "bad.csv"))


def test_discovery(spark):
    paths = ["/d/x/a.txt", "/d/x/b.txt", "/d/run1/p.txt", "/d/run1/q.txt", "/d/y/c.txt", "/d/z/c.txt"]
    reg = spark.createDataFrame([("a",), ("run1",), ("c",), ("none",)], ["raw_data_filename"])
    found, status = files.files_of(reg, spark.createDataFrame([(p,) for p in paths], ["path"]))
    got = {}
    for r in found.collect():
        got.setdefault(r["raw_data_filename"], set()).add(r["path"])
    assert got["a"] == {"/d/x/a.txt", "/d/x/b.txt"} and got["run1"] == {"/d/run1/p.txt", "/d/run1/q.txt"}
    assert {r["raw_data_filename"]: (r["matches"], r["ambiguous"]) for r in status.collect()} == {"a": (2, False), "run1": (2, False), "c": (2, True), "none": (0, False)}


def test_sidecars(spark, tmp_path):
    (tmp_path / "e1").mkdir()
    (tmp_path / "e1" / "d.json").write_text('{"metadata": {"k": "v"}}')
    (tmp_path / "e1" / "broken.json").write_text("{oops")
    got = registry.read_sidecars(spark, str(tmp_path)).collect()
    assert [(r["experiment_id"], r["dataset_name"], r["metadata"]) for r in got] == [("e1", "d", {"k": "v"})]


@pytest.mark.parametrize("kind, model, head, line", [
    ("dsc", "prior", "Index   Tr\n      [s]\n", "{0}   {0}"), ("dma", "ta_q800", "Sig1\tCount\nSig2\tq\nStartOfData\n", "{0}\t{0}"), ("ftir", "bruker", "x\nn,q\n", "{0},{0}"), ("sec", "agilent", "", "{0},{0}"),
    ("saxs", "anton_paar", "n,q\n", "{0},{0}"), ("rheometer", "anton_paar", "a\nb\nc\nd\nn\tw\nx\n\t[s]\n", "{0}\t{0}"), ("uv_vis", "flame", "Number of Pixels\na\nb\n", "30{0}\t{0}"), ("uv_vis", "Shimadzu", "t\nn\tq\n", "{0}\t{0}"),
])
def test_lines_are_parsed_where_they_lie(spark, tmp_path, kind, model, head, line):
    """Facts about files meet their lines without a shuffle of the lines, and the text is scanned once for the rows."""
    for f in range(3):
        (tmp_path / f"{f}.txt").write_text(head + "\n".join(line.format(k) for k in range(1, 6)) + "\n")
    rows, _ = text.parsed(text.read_lines(spark, str(tmp_path)), kind, model)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange hashpartitioning" not in plan
    assert rows.count() == 15


NINE = ("sectioned", "signals", "strict", "headerless", "mass_spectrum", "header_csv", "two_row_header", "spectrum", "plug_in")


@pytest.mark.parametrize("name", NINE)
def test_export_has_its_join(name):
    """A run is what a nation's suppliers delivered."""
    from assayloom.plans import exports, queries  # noqa: F401

    assert "from lineitem join supplier on l_suppkey = s_suppkey" in queries.ORACLE_SQL[f"export_{name}"]


def test_exported_files_and_large_ones(spark, tmp_path, monkeypatch):
    """A run is written line by line and never one value; a large file is read in ranges beside small ones."""
    from assayloom.plans import exports

    rows = spark.createDataFrame([(r, k, f"{k},{r}.5") for r in (1, 2) for k in reversed(range(r * 3))] + [(2, 9, None)], "run int, idx long, line string")
    folder = exports.exported(spark, rows, F.col("line"), "skip\r\nn,q\r\n", "\r\nend", "\r\n", str(tmp_path / "raw"))
    got = {p.parent.name: p.read_bytes().decode() for p in (tmp_path / "raw").rglob("*.txt")}
    assert got == {f"run={r}": "skip\r\nn,q\r\n" + "".join(f"{k},{r}.5\r\n" for k in range(r * 3)) + "end\r\n" for r in (1, 2)}
    whole = sorted(map(tuple, text.read_lines(spark, folder).collect()))
    monkeypatch.setattr(text, "WHOLE", len(got["run=1"]))
    real, staged = text.staged_lines, []
    monkeypatch.setattr(text, "staged_lines", lambda paths, at: staged.extend(r["path"] for r in paths.collect()) or real(paths, at))
    assert sorted(map(tuple, text.read_lines(spark, folder).collect())) == whole and ["run=2" in p for p in staged] == [True]


def test_odd_rows_are_parsed_as_before(spark):
    """Rows that aren't plain numbers, short and long rows, names that are null or come twice."""
    df = spark.createDataFrame([("f", 0, ["a", "b"], ["1", "2.5e3"]), ("f", 1, ["a", "b"], ["1"]), ("f", 2, ["a", "b"], [" 1 ", "2"]), ("f", 3, ["a", "a"], ["1", "2"]), ("f", 4, ["a", None], ["1", "2"]), ("f", 5, ["a", "b"], ["nan", "2"]), ("f", 6, ["a", "b"], ["1", "inf"]), ("f", 7, ["a", "b"], ["1", "2", "3"])], "source_file string, line_no int, header array<string>, tokens array<string>")
    rows = {d: {r["row_idx"]: r["raw"] for r in text._finish(df, df, strict_width=False, drop=d)[0].collect()} for d in ("any", "all")}
    assert rows["any"] == {0: {"a": "1", "b": "2.5e3"}, 2: {"a": "1", "b": "2"}, 3: {"a": "1"}, 4: {"a": "1"}, 6: {"a": "1", "b": "inf"}, 7: {"a": "1", "b": "2"}}
    assert rows["all"] == rows["any"] | {1: {"a": "1", "b": None}, 5: {"a": None, "b": "2"}}


def test_plain_rows_of_any_width(spark):
    """the pattern of plain rows doesn't recurse, and takes what a plain number is."""
    wide = [str(k) for k in range(60_000)]
    df = spark.createDataFrame([(wide,), (wide + ["x"],), (["+1.", ".5", "-2e-7"],), (["1", ""],), (["1", None],), (["1e"],), (["."],), ([" 1"],)], "tokens array<string>")
    assert [r["p"] for r in df.select(text._plain_tokens().alias("p")).collect()] == [True, False, True, False, False, False, False, False]


@pytest.mark.parametrize("kind, model, head, line", [
    ("dsc", "prior", "Index   Tr\n      [s]\n", "{0}   {0}"), ("dma", "ta_q800", "Sig1\tCount\nSig2\tq\nStartOfData\n", "{0}\t{0}"), ("rheometer", "anton_paar", "a\nb\nc\nd\nn\tw\nx\n\t[s]\n", "{0}\t{0}"),
    ("ftir", "bruker", "x\nn,q\n", "{0},{0}"), ("saxs", "anton_paar", "n,q\n", "{0},{0}"), ("uv_vis", "Shimadzu", "t\nn\tq\n", "{0}\t{0}"),
])
def test_headers_are_judged_by_file(spark, tmp_path, kind, model, head, line):
    """Whether a header's names are its own is found once a file, not once a row."""
    (tmp_path / "a.txt").write_text(head + line.format(1) + "\n" + line.format(2) + "\n")
    rows, _ = text.parsed(text.read_lines(spark, str(tmp_path)), kind, model)
    assert "array_distinct" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 2


def test_strict_files_take_one_pass_for_bad_numbers(spark, tmp_path):
    """bad files are told from facts already written; no second search for rows of another width."""
    bodies = {"good": "x\nn,q\n1,2\n\ninf, 3\n", "word": "x\nn,q\n1,2\n1,n/a\n", "wide": "x\nn,q\n1,2,3\n", "none": "x\nn,q\n\n", "short": "x\n"}
    for name, body in bodies.items():
        (tmp_path / f"{name}.txt").write_text(body)
    rows, bad = text.parsed(text.read_lines(spark, str(tmp_path)), "ftir", "bruker")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(rows).count("LeftAnti") == 1 and "FileScan text" not in plan(bad)
    assert [r["raw"] for r in rows.orderBy("row_idx").collect()] == [{"n": "1", "q": "2"}, {"n": "inf", "q": "3"}]
    got = {r["source_file"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}
    assert got == {"word.txt": "a value is no number", "wide.txt": "a value is no number", "none.txt": "no data rows", "short.txt": "no data rows"}


def test_rows_with_gaps_need_no_function_of_each_value(spark):
    """plain numbers beside empty values, as every row of a two-row header has them, are told by one pattern, and give what they gave."""
    df = spark.createDataFrame([("f", k, ["a", "b", "c"], t) for k, t in enumerate((["1", "", "2"], ["", "", ""], ["", None, "3"], [" ", "1", ""], ["1", "2", "3"]))], "source_file string, line_no int, header array<string>, tokens array<string>")
    rows = {d: {r["row_idx"]: r["raw"] for r in text._finish(df, df, strict_width=False, drop=d)[0].collect()} for d in ("any", "all", "none")}
    full, none = {"a": "1", "b": "2", "c": "3"}, dict.fromkeys("abc")
    assert rows["any"] == {4: full}
    assert rows["all"] == {0: none | {"a": "1", "c": "2"}, 2: none | {"c": "3"}, 3: none | {"b": "1"}, 4: full}
    assert rows["none"] == rows["all"] | {1: none}
    told = df.select(text._plain_tokens(text.GAPS).alias("g")).collect()
    assert [r["g"] for r in told] == [True, False, True, False, True]


def test_bad_files_are_told_from_written_rows(spark):
    """F4 of round 4: files that gave rows aren't parsed again to tell the bad ones; a user's parser keeps its own word."""
    texts = spark.createDataFrame([("a/ok.csv", "skip\ncm-1,%T\n400,1.5\n"), ("a/broken.csv", "skip\ncm-1,%T\n400,oops\n"), ("a/none.csv", "skip\ncm-1,%T\n")], "source_file string, value string")
    lines = text.lines_of(texts)
    rows, bad = text.parsed(lines, "ftir", "bruker")
    want = sorted(map(tuple, bad.collect()))
    assert want == [("a/broken.csv", "a value is no number"), ("a/none.csv", "no data rows")]
    assert sorted(map(tuple, text.bad_files(lines, rows, None, "ftir", "bruker").collect())) == want
    fine = lines.filter("source_file = 'a/ok.csv'")
    assert text.bad_files(fine, text.parsed(fine, "ftir", "bruker")[0], None, "ftir", "bruker").isEmpty()

    @text.parser("example", "half")
    def half(lines):
        return lines.selectExpr("source_file", "line_no as row_idx", "map('v', line) as raw"), lines.selectExpr("source_file", "'half of it' as reason").distinct()

    rows, bad = text.parsed(lines, "example", "half")
    assert text.bad_files(lines, rows, bad, "example", "half").count() == 3
    del text.PARSERS[("example", "half")]
