import pytest

from assayloom.operators import characterize as C


def brute(xs, s):
    """Labels by a plain loop."""
    base, d, before = [], [], None
    for i, x in enumerate(xs):
        d.append(None if i == 0 else x - xs[i - 1])
        d2 = None if i < 2 else d[i] - d[i - 1]
        moving = d[i] is not None and d[i] != 0
        if d2 is not None and d2 < -s:
            b = "Cooling_start" if moving else "Heating_end"
        elif d2 is not None and d2 > s:
            b = "Heating_start" if moving else "Cooling_end"
        else:
            b = "Heating" if (d[i] or 0) > 0 else "Cooling" if (d[i] or 0) < 0 else "Isothermal"
        base.append(b)
    heat = cool = 0
    iso, out = -1, []
    for i, b in enumerate(base):
        heat += b == "Heating_end"
        cool += b == "Cooling_end"
        iso += b == "Isothermal" and (i == 0 or base[i - 1] != "Isothermal")
        out.append(b if b.endswith("_end") else f"{b}_{heat if b.startswith('Heating') else cool if b.startswith('Cooling') else iso}")
    return out


RUNS = {
    "up": [20, 25, 30, 35, 35, 35, 30, 25, 20, 20, 25, 30],
    "flat": [5, 5, 5, 5],
    "short": [1, 2],
    None: [1, 2, 3, 3, 3, 1],
}


def test_segment_labels(spark):
    rows = [(n, i, float(x)) for n, xs in RUNS.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "name string, row_idx int, temperature_C double")
    got = {}
    for r in C.segment_labels(df).orderBy("row_idx").collect():
        got.setdefault(r["name"], []).append(r["profile"])
    assert got == {n: brute(xs, 0.1) for n, xs in RUNS.items()}
    assert C.segment_labels(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.segment_labels(df.drop("temperature_C"))


def test_mass_percent(spark):
    df = spark.createDataFrame([("a", 10.0, None), ("a", 5.0, None), ("b", 3.0, None), ("b", 3.0, None), ("c", 1.0, 7.0), ("c", 2.0, 8.0)], "experiment_id string, mass_mg double, mass_pct double")
    got = sorted((r["experiment_id"], r["mass_pct"]) for r in C.mass_percent(df).collect())
    assert got == [("a", 0.0), ("a", 100.0), ("b", 0.0), ("b", 0.0), ("c", 7.0), ("c", 8.0)]
    assert C.mass_percent(df.drop("mass_mg")).columns == ["experiment_id", "mass_pct"]


def test_hook(spark):
    @C.characteriser("twice")
    def make(column="x"):
        return lambda df: df.withColumn("twice", df[column] * 2)

    out, told = C.characterize(spark.createDataFrame([(2,)], ["x"]), "twice")
    assert out.first()["twice"] == 4 and told == {"applied": True, "name": "twice"}
    assert C.characterize(out, None)[1]["applied"] is False


def test_first_and_latest(spark):
    df = spark.createDataFrame([("f", "1.0", 0), ("f", "1.0", 1), ("f", "2.0", 2)], "source_file string, mz string, row_idx int")
    assert [r["row_idx"] for r in C.first_wins(df, ["source_file", "mz"], ["row_idx"]).orderBy("row_idx").collect()] == [0, 2]


def test_quantiles_of_odd_groups(spark):
    from assayloom.operators import features

    rows = [(None, 1.0), (None, 4.0), ("a", None), ("b", 7.0), ("c", 1.0), ("c", 1.0), ("c", 2.0), ("c", 10.0)]
    got = {r.g: (r["count"], r.q25, r.q50, r.q75) for r in features.describe(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {None: (2, 1.75, 2.5, 3.25), "a": (0, None, None, None), "b": (1, 7.0, 7.0, 7.0), "c": (4, 1.0, 1.5, 4.0)}


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_scanned_labels_equal_windows(spark, chunk):
    """Chunks of every size, single rows, runs that end in a chunk, missing values, a run without a name."""
    import random

    r = random.Random(chunk)
    runs = dict(RUNS) | {f"r{k}": [r.choice([1, 2, 2, 2, 3, 5, 8]) for _ in range(r.randrange(1, 40))] for k in range(6)} | {"gaps": [1, None, 2, 2, None, None, 3, 3, 3, 1]}
    rows = [(n, i, None if x is None else float(x), "kept") for n, xs in runs.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "name string, row_idx int, temperature_C double, other string").repartition(5)
    order = lambda out: sorted(map(str, out.select("name", "row_idx", "other", "profile").collect()))
    assert order(C.scanned_labels(df, chunk=C.row_chunks(chunk))) == order(C.segment_labels(df))
    assert C.scanned_labels(df.limit(0)).count() == 0
    whole = df.filter("name = 'r1'").drop("name")
    assert [r.profile for r in C.scanned_labels(whole, chunk=C.row_chunks(chunk)).orderBy("row_idx").collect()] == [r.profile for r in C.segment_labels(whole).orderBy("row_idx").collect()]


def test_large_mass_percent_equals_windows(spark):
    df = spark.createDataFrame([("a", 1, 10.0, None), ("a", 2, 5.0, None), (None, 1, 3.0, None), (None, 2, 4.0, None), ("c", 1, 1.0, 7.0), ("c", 2, 2.0, 8.0)], "experiment_id string, row_idx int, mass_mg double, mass_pct double")
    for mode in ("minmax", "initial"):
        order = lambda out: sorted(map(str, out.collect()))
        assert order(C.mass_percent(df, mode=mode, large=True)) == order(C.mass_percent(df, mode=mode))


def test_one_large_run_is_spread(spark):
    """A run of 600,000 rows in chunks of 50,000: no task of the last stage takes more than a few chunks."""
    df = spark.range(600_000).selectExpr("'one' as name", "id as row_idx", "floor(id / 1000) % 7 * 1.0D as temperature_C").repartition(8)
    out = C.scanned_labels(df, chunk=C.row_chunks(50_000))
    want = C.segment_labels(df)
    mark = lambda d: d.selectExpr("sum(cast(xxhash64(row_idx, profile) as decimal(38, 0)))").first()[0]
    assert mark(out) == mark(want)
    sizes = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 1 and max(sizes) < 600_000


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_quantiles_by_selection(spark, by):
    import random

    import duckdb
    from assayloom.operators import features

    r = random.Random(len(by))
    rows = [(r.choice(["a", "b", None]), r.randrange(3), r.choice([None, r.random(), float(r.randrange(4)), -1e300, 1e300])) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(4)
    con = duckdb.connect()
    con.execute("create table t (g varchar, h int, v double)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    group = ", ".join(by)
    want = con.execute(f"select {group + ',' if by else ''} count(v), min(v), max(v), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.9) from t where abs(v) < 1e10 {'group by ' + group if by else ''}").fetchall()
    some = df.filter("abs(v) < 1e10")
    q = features.quantiles(some, by, "v", {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    about = features.describe(some, by, "v").select(*by, "count", "min", "max")
    near = lambda t: tuple(round(x, 9) if isinstance(x, float) else x for x in t)
    got = features.joined_null_safe(about, q, by).select(*by, "count", "min", "max", "q25", "q50", "q90")
    assert sorted(map(str, map(near, map(tuple, got.collect())))) == sorted(map(str, map(near, want)))


def test_quantiles_of_a_hot_group(spark):
    """One group of 200,000 distinct values lies in many ranges; few of them are looked into."""
    from assayloom.operators import features

    df = spark.range(200_000).selectExpr("'hot' as g", "(id * 7919) % 200000 * 1.0D as v").unionByName(spark.range(10).selectExpr("'cold' as g", "id * 1.0D as v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges stay apart although they are small
    try:
        counted = features.counted_values(df.repartition(6), ["g"], "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counted.filter("g = 'hot'").select("_part").distinct().count() >= 4
    got = {x.g: (x.q0, x.q1, x.q50) for x in features.quantiles_of(counted, ["g"], "v", {"q0": 0.0, "q1": 1.0, "q50": 0.5}).collect()}
    assert got == {"hot": (0.0, 199999.0, 99999.5), "cold": (0.0, 9.0, 4.5)}
    assert features.describe(df.filter("v < 0"), ["g"], "v").count() == 0 and features.describe(df.filter("v < 0"), [], "v").first()["count"] == 0


def test_percent_of_a_first_mass_of_zero(spark):
    """IEEE quotients as in SQL, no error."""
    nan, inf = float("nan"), float("inf")
    runs = [("zero", [0.0, 5.0, -5.0, None, nan]), ("minus", [-0.0, 5.0, -5.0]), ("null", [None, 5.0]), ("some", [4.0, 0.0, 2.0, inf])]
    df = spark.createDataFrame([(run, k, m) for run, masses in runs for k, m in enumerate(masses)], "experiment_id string, row_idx int, mass_mg double")
    want = {"zero": [nan, inf, -inf, None, nan], "minus": [nan, -inf, inf], "null": [None, None], "some": [100.0, 0.0, 50.0, inf]}
    for large in (False, True):
        got = C.mass_percent(df, mode="initial", large=large).orderBy("experiment_id", "row_idx").collect()
        assert str([r["mass_pct"] for r in got]) == str([m for run in sorted(want) for m in want[run]])


def test_large_runs_stay_where_they_lie(spark):
    """three runs don't become three tasks: the rows are joined without a shuffle."""
    df = spark.range(3000).selectExpr("id % 3 as experiment_id", "cast(id as double) as mass_mg")
    out = C.mass_percent(df, large=True)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("mass_pct = 100").count() == 3 and out.count() == 3000


def test_labels_and_files_of_runs_share_a_shuffle_and_a_sort(spark, tmp_path):
    """F4 of round 4: rows that lie together by experiment pass through two windows and aren't shuffled or sorted again."""
    from assayloom.operators import catalog

    df = spark.range(4000).selectExpr("'i' as instrument_name", "cast(id % 20 as string) as experiment_id", "id % 2 as _file", "id as row_idx", "cast(id * 7919 % 11 as double) as temperature_C")
    df.write.parquet(str(tmp_path / "rows"))
    out = C.segment_labels(catalog.by_experiment(spark.read.parquet(str(tmp_path / "rows"))), by=["instrument_name", "experiment_id", "_file"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and plan.count("Window [") == 2
    catalog.write_measurements(out, str(tmp_path / "store"), together=True)
    got = spark.read.parquet(str(tmp_path / "store"))
    assert got.count() == 4000 and got.select("experiment_id").distinct().count() == 20
