"""Raw text exports.

All readers work on numbered lines of many files at once and give rows (source_file, row_idx, raw map of header to
text) and a table of bad files (source_file, reason); one malformed file never stops the others. A file of up to ``WHOLE`` bytes is
one row while it is split; larger ones are staged by the planned scan (``sources.scan``), in byte ranges.

What a reader has to know of each file (where its header is, which files are uneven) is found by aggregates over numbers and
written first (``_known``), so that Spark knows its size: lines meet it where they lie and are shuffled only if there are
very many files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.functions import scalar
from assayloom.functions.scalar import infer_detector, spectrum_time, to_number
from assayloom.sources.files import list_files
from assayloom.sources.scan import source_path, staged_lines
from assayloom.sources.shared import shared_folder, stored

EXTENSIONS = (".txt", ".csv", ".tsv", ".bsc", ".dat", ".jsonl")
WAVELENGTHS = (280, 900)  # fixed values: the range kept of a spectrum, in nm
NO_END = r"\A\b\B"  # matches nothing
WHOLE = 8 << 20
_DECIMAL = r"[+-]?(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][+-]?\d++)?+"
PLAIN = rf"\A(?:{_DECIMAL}\n)*+\z"  # lines that are plain decimal numbers; possessive: it never steps back
GAPS = rf"\A(?=\n*+[^\n])(?:(?:{_DECIMAL})?+\n)*+\z"  # plain numbers, at least one, and empty lines


def _named_so(path: str, extensions: tuple[str, ...]) -> Column:
    return F.lower(path).rlike(r"(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + r")\z")


def readable(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The files (path) that the readers take, whatever the case of their extensions."""
    return files.filter(_named_so("path", extensions))


def read_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, most: int | None = None) -> DataFrame:
    """source_file and value, the whole text, of every text file (of at most ``most`` bytes) below a path; other extensions are skipped."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    if most is not None:
        files = files.filter(F.col("_metadata.file_size") <= most)  # the others are pruned, not opened
    named = files.select(source_path(F.col("_metadata.file_path")).alias("source_file"), "value")
    return named.filter(_named_so("source_file", extensions))


def read_lines(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """source_file, line_no (from 0) and line of every text file below a path."""
    large = stored(readable(list_files(spark, path).filter(F.col("length") > WHOLE), extensions).select("path"), shared_folder(spark), "large")
    if large.isEmpty():
        return lines_of(read_texts(spark, path, extensions))
    small = lines_of(read_texts(spark, path, extensions, WHOLE))
    return small.unionByName(staged_lines(large, f"{shared_folder(spark)}/lines"))


def lines_of(texts: DataFrame) -> DataFrame:
    """Numbered lines of (source_file, value)."""
    body = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n\\z", "")
    return texts.select("source_file", F.posexplode(F.split(body, "\n")).alias("line_no", "line"))


def _by_file():
    return Window.partitionBy("source_file").orderBy("line_no")


def _solid(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("line") != "")


def _known(df: DataFrame) -> DataFrame:
    """Rows about files, written: their size is known to the planner."""
    return stored(df, shared_folder(df.sparkSession), "known")


def _named(df: DataFrame) -> DataFrame:
    """``named``: the header's names are its own each; found once a file where the header is known by file."""
    own = ~F.array_contains("header", "\n") & (F.size(F.array_distinct("header")) == F.size("header"))  # null where a name is null
    return df.withColumn("named", F.coalesce((F.size("header") > 0) & own, F.lit(False)))


def _plain_tokens(pattern: str = PLAIN) -> Column:
    return F.concat(F.array_join("tokens", "\n", ""), F.lit("\n")).rlike(pattern)


def _finish(rows: DataFrame, all_files: DataFrame, strict_width: bool = True, drop: str = "any", numeric: bool = True, text_columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """From (source_file, line_no, header, tokens): rows with raw maps, and bad files.

    ``strict_width``: a row with another number of tokens makes the file bad. ``drop``: rows without any, or with all, values go.
    """
    uneven = _known(rows.filter(F.size("tokens") != F.size("header")).select("source_file").distinct()) if strict_width else None
    even = rows.join(uneven, "source_file", "left_anti") if strict_width else rows
    fit = F.when(F.size("tokens") >= F.size("header"), F.slice("tokens", F.lit(1), F.size("header"))).otherwise(F.concat("tokens", F.array_repeat(F.lit(None).cast("string"), F.size("header") - F.size("tokens"))))
    value = (lambda h, t: F.when(h.isin(*text_columns), t).otherwise(F.when(to_number(t).isNotNull(), F.trim(t)))) if text_columns else (lambda h, t: F.when(to_number(t).isNotNull(), F.trim(t)))
    pairs = F.zip_with("header", fit, lambda h, t: F.struct(h.alias("key"), (value(h, t) if numeric else t).alias("value")))
    # of columns of one name the first is kept
    first = F.filter(pairs, lambda p, i: F.array_position("header", p["key"]) == i + 1)
    keep = (lambda m: F.forall(F.map_values(m), lambda v: v.isNotNull())) if drop == "any" else (lambda m: F.exists(F.map_values(m), lambda v: v.isNotNull())) if drop == "all" else (lambda m: F.lit(True))
    made = F.filter(F.array(F.map_from_entries(first)), keep)
    if numeric:
        # nearly all rows are plain numbers under names of their own: their map needs no function of single tokens
        even = even if "named" in even.columns else _named(even)
        fits = (F.size("tokens") == F.size("header")) & F.col("named")
        sort = F.when(fits & _plain_tokens(), 1)
        if not text_columns:
            sort = sort.when(fits & _plain_tokens(GAPS), 2)
        even = even.withColumn("sort", sort.otherwise(0))
        gaps = F.array(F.map_from_arrays("header", F.transform("tokens", lambda t: F.nullif(t, F.lit("")))))
        some = F.filter(gaps, lambda m: F.lit(False)) if drop == "any" else gaps
        made = F.when(F.col("sort") == 1, F.array(F.map_from_arrays("header", "tokens"))).when(F.col("sort") == 2, some).otherwise(made)
    # the map is made once: a filter on a column would be pushed below it and make it again
    out = even.select("source_file", F.col("line_no").alias("row_idx"), F.explode(made).alias("raw"))
    wrong = uneven.withColumn("reason", F.lit("rows of another width than the header")) if strict_width else None
    empty = _without(all_files, out).withColumn("reason", F.lit("no data rows"))
    return out, (empty if wrong is None else wrong.union(empty.join(uneven, "source_file", "left_anti")))


def _without(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files (source_file) that give no row."""
    return files.select("source_file").distinct().join(rows.select("source_file").distinct(), "source_file", "left_anti")


def read_sectioned(lines: DataFrame, start: str, end: str = NO_END, delimiter: str = r"\s+", limit: int = -1, unit_shift: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows after a line matching ``start`` up to a line matching ``end``.

    The start line holds the headers, the line after it the units (a blank one goes before them if ``unit_shift``); a column is
    called ``header unit``. ``limit``: at most so many tokens a row, the last takes the rest.
    """
    tokens = lambda c: F.split(F.trim(c) if delimiter.startswith("\\s") else F.rtrim(c), delimiter, limit)
    begin = _known(lines.filter(F.col("line").rlike(start)).groupBy("source_file").agg(F.min("line_no").alias("s")))
    line_no, s, line = F.col("line_no"), F.col("s"), F.col("line")
    near = lines.join(begin, "source_file").filter(line_no.between(s, s + 1) | ((line_no > s) & line.rlike(end)))
    about = near.groupBy("source_file", "s").agg(F.max(F.when(line_no == s, line)).alias("h"), F.max(F.when(line_no == s + 1, line)).alias("u"), F.min(F.when((line_no > s) & line.rlike(end), line_no)).alias("e"))
    units = F.when(F.lit(unit_shift), F.concat(F.array(F.lit("")), tokens(F.coalesce("u", F.lit(""))))).otherwise(tokens(F.coalesce("u", F.lit(""))))
    about = about.select("source_file", "s", "e", tokens(F.col("h")).alias("hs"), units.alias("us"))
    n = F.least(F.size("hs"), F.size("us"))
    header = F.zip_with(F.slice("hs", F.lit(1), n), F.slice("us", F.lit(1), n), lambda h, u: F.trim(F.concat(h, F.lit(" "), u)))
    inside = (line_no > s + 1) & (F.col("e").isNull() | (line_no < F.col("e")))
    about = _known(_named(about.select("source_file", "s", "e", header.alias("header"))))
    rows = _solid(lines).join(about, "source_file").filter(inside)
    return _finish(rows.select("source_file", "line_no", tokens(line).alias("tokens"), "header", "named"), lines)


def read_signals(lines: DataFrame, delimiter: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Columns named by the second token of Sig lines, data after StartOfData."""
    sig = F.col("line").rlike(r"\ASig\d+")
    names = lines.filter(sig).groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("line_no", F.lower(F.trim(F.split("line", delimiter)[1])).alias("name")))).alias("n"))
    names = names.select("source_file", F.transform("n", lambda x: x["name"]).alias("header"))
    begin = lines.filter(F.col("line").startswith("StartOfData")).groupBy("source_file").agg(F.min("line_no").alias("b"))
    about = _known(_named(begin.join(names, "source_file")))
    rows = lines.join(about, "source_file").filter((F.col("line_no") > F.col("b")) & (F.trim("line") != "")).select("source_file", "line_no", F.split(F.rtrim("line"), delimiter).alias("tokens"), "header", "named")
    return _finish(rows, lines)


def read_delimited(lines: DataFrame, delimiter: str = ",", skip: int = 0, names: list[str] | None = None, strict: bool = False, drop: str = "any", text_columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """A header after ``skip`` lines, or given names; ``strict``: one bad number makes its file bad."""
    line_no = F.col("line_no")
    taken = (line_no >= skip) & (F.trim("line") != "")
    solid = lines.filter(taken)
    cells = lambda c: F.transform(F.split(c, delimiter), lambda x: F.btrim(F.trim(x), F.lit('"')))
    rows = solid.select("source_file", "line_no", cells("line").alias("tokens"))
    if names is None:
        about = _known(lines.groupBy("source_file").agg(F.min(F.when(taken, line_no)).alias("s"), F.count_if(taken).alias("n")))
        first = about.filter("n > 0").select("source_file", F.col("s").alias("line_no"))
        heads = _known(_named(solid.join(first, ["source_file", "line_no"]).select("source_file", F.col("line_no").alias("s"), cells("line").alias("header"))))
        rows = rows.join(heads, "source_file").filter(line_no > F.col("s")).drop("s")
        empty = about.filter("n < 2").select("source_file")
    else:
        rows = rows.withColumn("header", F.array(*[F.lit(n) for n in names]))
        empty = _without(lines, solid)
    if not strict:
        return _finish(rows, lines, strict_width=False, drop=drop, text_columns=text_columns)
    odd = F.when(_plain_tokens(), False).otherwise(F.exists("tokens", lambda t: to_number(t).isNull()))
    wrong = _known(rows.filter((F.size("tokens") != F.size("header")) | odd).select("source_file").distinct())
    # the files left have even rows of numbers only: all are kept
    out, _ = _finish(rows.join(wrong, "source_file", "left_anti"), lines, strict_width=False, drop=drop)
    bad = empty.join(wrong, "source_file", "left_anti").withColumn("reason", F.lit("no data rows"))
    return out, bad.union(wrong.withColumn("reason", F.lit("a value is no number")))


def read_two_row_header(lines: DataFrame, first: int = 4, second: int = 6, delimiter: str = "\t", drop_columns: tuple[str, ...] = ("Interval data:", "Point No.")) -> tuple[DataFrame, DataFrame]:
    """Names from two header lines (numbered without blank ones), joined by a blank; wide rows are skipped, short ones padded."""
    solid = _solid(lines)
    # a row number with an upper limit: each task keeps the first lines of a file before they are shuffled
    ranked = solid.withColumn("rank", F.row_number().over(_by_file()) - 1).filter(F.col("rank") <= second)
    heads = ranked.groupBy("source_file").agg(F.max(F.when(F.col("rank") == first, F.col("line"))).alias("a"), F.max(F.when(F.col("rank") == second, F.struct("line_no", "line"))).alias("b")).filter("a is not null and b is not null")
    heads = heads.select("source_file", "a", F.col("b.line").alias("b"), F.col("b.line_no").alias("s"))
    split = lambda c: F.transform(F.split(c, delimiter), lambda x: F.trim(x))
    header = F.zip_with(split("a"), split("b"), lambda x, y: F.trim(F.concat(F.coalesce(x, F.lit("")), F.lit(" "), F.coalesce(y, F.lit("")))))
    heads = _known(_named(heads.select("source_file", "s", header.alias("header"))))
    rows = solid.select("source_file", "line_no", F.split("line", delimiter).alias("tokens")).join(heads, "source_file").filter((F.col("line_no") > F.col("s")) & (F.size("tokens") <= F.size("header"))).drop("s")
    out, bad = _finish(rows, lines, strict_width=False, drop="all")
    away = lambda k: F.lit(False) if not drop_columns else k.isin(*drop_columns)
    return out.withColumn("raw", F.map_filter("raw", lambda k, _: ~away(k) & (k != ""))), bad


def read_preamble_spectrum(lines: DataFrame, table_mark: str = "Number of Pixels", delimiter: str = "\t") -> tuple[DataFrame, DataFrame]:
    """The time from the Date line, a line skipped after the mark, the one after that taken as header whatever it holds.

    The first two columns are kept as ``wavelength (nm)`` and ``transmission``, the UTC time as ``timestamp``; files of fewer columns are bad.
    """
    told = lines.filter(F.col("line").contains(table_mark) | F.col("line").startswith("Date"))
    begin = _known(told.groupBy("source_file").agg(F.min(F.when(F.col("line").contains(table_mark), F.col("line_no"))).alias("b"), F.max(F.when(F.col("line").startswith("Date"), F.col("line"))).alias("date")))
    rows = lines.join(begin.filter("b is not null"), "source_file").filter((F.col("line_no") > F.col("b") + 2) & (F.trim("line") != ""))
    rows = rows.select("source_file", "line_no", F.split(F.trim("line"), delimiter).alias("tokens")).filter(F.size("tokens") >= 2).withColumn("tokens", F.slice("tokens", 1, 2)).withColumn("header", F.array(F.lit("wavelength (nm)"), F.lit("transmission")))
    out, bad = _finish(rows, lines)
    times = begin.select("source_file", spectrum_time(F.col("date"), F.col("source_file")).alias("timestamp"))
    return out.join(times, "source_file", "left"), bad


def explode_spectrum(df: DataFrame, x: str, y: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A row a point of two arrays of one length; (rows, rejected rows with the reason)."""
    same = F.col(x).isNotNull() & F.col(y).isNotNull() & (F.size(x) == F.size(y))
    good = df.filter(same).dropDuplicates(keys).select(*keys, F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("row_idx", "p"))
    return good.select(*keys, "row_idx", F.col("p.x").alias("x"), F.col("p.y").alias("y")), df.filter(~same).select(*keys, F.lit("arrays of unlike length").alias("reason"))


def with_detector(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw", F.map_concat("raw", F.create_map(F.lit("detector_name"), infer_detector(F.element_at(F.split("source_file", "/"), -1)))))


Parser = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def peak_list(lines: DataFrame) -> DataFrame:
    """(source_file, mz) of the lines after one with Peak up to one with End, however many such blocks a file has."""
    marker = F.when(F.col("line").contains("Peak"), 1).when(F.col("line").contains("End"), 0)
    before = F.last(marker, ignorenulls=True).over(_by_file().rowsBetween(Window.unboundedPreceding, -1))
    cells = F.split(F.trim("line"), ",")
    begin = _known(lines.filter(F.col("line").contains("Peak")).groupBy("source_file").agg(F.min("line_no").alias("b")))
    listed = lines.join(begin, "source_file").filter(F.col("line_no") >= F.col("b")).drop("b")
    listed = listed.withColumn("inside", F.coalesce(before, F.lit(0))).filter("inside = 1").select("source_file", to_number(F.get(cells, F.lit(0))).alias("mz"), to_number(F.get(cells, F.lit(1))).alias("intensity"))
    return listed.filter("mz is not null and intensity is not null").select("source_file", "mz")


def read_mass_spectrum(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of points with one m/z text the first counts, rows lie in m/z order, ``peaks`` marks those of the file's peak list."""
    mz = F.trim(F.split("line", ",")[0])
    first = _known(lines.groupBy("source_file", mz.alias("mz")).agg(F.min("line_no").alias("line_no")).drop("mz"))
    firsts = lines.join(first, ["source_file", "line_no"], "left_semi")
    points, bad = read_delimited(firsts, names=["m/z", "intensity"])
    points = points.withColumn("mz", to_number(F.col("raw")["m/z"]))
    points = points.withColumn("row_idx", F.row_number().over(Window.partitionBy("source_file").orderBy("mz", "row_idx")) - 1)
    listed = peak_list(lines).distinct().withColumn("peaks", F.lit(True))
    return points.join(listed, ["source_file", "mz"], "left").select("source_file", "row_idx", "raw", F.coalesce("peaks", F.lit(False)).alias("peaks")), bad


def read_decoded_spectra(lines: DataFrame, x: str = "ppm", y: str = "intensity") -> tuple[DataFrame, DataFrame]:
    """Files whose one line is a JSON object of two arrays, decoded elsewhere; a row a point, empty points left out."""
    body = lines.filter(F.trim("line") != "").withColumn("r", F.from_json("line", f"`{x}` array<double>, `{y}` array<double>"))
    arrays = body.groupBy("source_file").agg(F.min_by("r", "line_no").alias("r")).select("source_file", F.col("r")[x].alias("a"), F.col("r")[y].alias("b"))
    rows, bad = explode_spectrum(arrays, "a", "b", ["source_file"])
    rows = rows.filter("x is not null or y is not null")
    raw = F.create_map(F.lit(x), F.col("x").cast("string"), F.lit(y), F.col("y").cast("string"))
    without = lines.select("source_file").distinct().join(rows.select("source_file").distinct(), "source_file", "left_anti").join(bad.select("source_file"), "source_file", "left_anti")
    return rows.select("source_file", "row_idx", raw.alias("raw")), bad.unionByName(without.withColumn("reason", F.lit("no data rows")))


def csv_apart(lines: DataFrame, read: Parser) -> tuple[DataFrame, DataFrame]:
    """.csv files have one header and keep all rows, the others go to ``read``."""
    plain = F.lower("source_file").endswith(".csv")
    rows, bad = read_delimited(lines.filter(plain), drop="none")
    others, broken = read(lines.filter(~plain))
    return rows.unionByName(others), bad.unionByName(broken)


def and_then(got: tuple[DataFrame, DataFrame], *steps: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Steps on the rows of a reader; bad files stay as they are."""
    rows, bad = got
    for step in steps:
        rows = step(rows)
    return rows, bad


def named_by(name: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn("name", name)


def within(column: str, least: float, most: float) -> Callable[[DataFrame], DataFrame]:
    """P10."""
    return lambda rows: rows.filter(to_number(F.col("raw")[column]).between(least, most))


def without_empty_values(rows: DataFrame) -> DataFrame:
    """A raw column without any value in an experiment isn't one of its headers."""
    return rows.withColumn("raw", F.map_filter("raw", lambda _, v: v.isNotNull()))


PARSERS: dict[tuple[str, str], Parser] = {}
#: Parsers that judge each file by its own lines and take no rows from bad ones: those of this module.
BY_FILE: set[tuple[str, str]] = set()


def parser(kind: str, model: str):
    """Register a parser of (type, model): numbered lines to (rows, bad files). A bare DataFrame is taken for rows."""

    def add(make: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]]):
        def run(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
            got = make(lines)
            return got if isinstance(got, tuple) else (got, lines.select("source_file").limit(0).withColumn("reason", F.lit("")))

        PARSERS[(kind, model)] = run
        BY_FILE.discard((kind, model))
        return make

    return add


# The markers and delimiters of each instrument's export.
@parser("dsc", "prior")
def _prior(lines):
    return and_then(read_sectioned(lines, "Index", "Results", r"\s+", 6), named_by(scalar.stem(F.col("source_file"))))


@parser("tga", "tgaX")
def _tga(lines):
    return and_then(csv_apart(lines, lambda x: read_sectioned(x, "Index", "Results", r"\s+", 6, unit_shift=False)), named_by(scalar.stem(F.col("source_file"))))


@parser("dsc", "perkin_elmer")
@parser("dsc", "default")
def _tabbed(lines):
    return and_then(csv_apart(lines, lambda x: read_sectioned(x, r"\tTime", NO_END, "\t")), named_by(scalar.stem(F.col("source_file"))))


@parser("dsc", "mettler_toledo")
def _mettler(lines):
    return and_then(read_sectioned(lines, r"\s+Index", NO_END, r"\s\s+", unit_shift=False), named_by(scalar.stem(F.col("source_file"))))


@parser("ms", "bruker")
def _ms(lines):
    return and_then(read_mass_spectrum(lines), named_by(F.lower(scalar.stem(F.col("source_file")))))


@parser("sec", "agilent")
def _sec(lines):
    return and_then(read_delimited(lines, names=["time (min)", "value"]), with_detector, named_by(scalar.without_dx(F.lower(scalar.stem(F.col("source_file"))))))


@parser("saxs", "anton_paar")
def _saxs(lines):
    return and_then(read_delimited(lines), named_by(F.lower(scalar.base_name(scalar.dir_name(F.col("source_file"))))))


@parser("rheometer", "anton_paar")
def _rheometer(lines):
    return and_then(read_two_row_header(lines), without_empty_values, named_by(scalar.before_dollar(scalar.base_name(F.col("source_file")))))


@parser("uv_vis", "flame")
@parser("reflection", "flame")
def _flame(lines):
    return and_then(read_preamble_spectrum(lines), within("wavelength (nm)", *WAVELENGTHS), named_by(scalar.base_name(scalar.dir_name(F.col("source_file")))))


@parser("uv_vis", "Shimadzu")
def _shimadzu(lines):
    titrant = lambda rows: rows.withColumn("titrant", scalar.titrant(scalar.stem(F.col("source_file"))))
    return and_then(read_delimited(lines, delimiter="\t", skip=1), titrant, named_by(scalar.base_name(scalar.dir_name(F.col("source_file")))))


parser("nmr", "bruker_nmr")(lambda lines: and_then(read_decoded_spectra(lines), without_empty_values))
parser("dma", "ta_q800")(read_signals)
parser("ftir", "bruker")(lambda lines: read_delimited(lines, skip=1, strict=True))
BY_FILE.update(PARSERS)


def parsed(lines: DataFrame, kind: str, model: str) -> tuple[DataFrame, DataFrame]:
    if (kind, model) not in PARSERS:
        raise KeyError((kind, model))
    return PARSERS[(kind, model)](lines)


def bad_files(lines: DataFrame, rows: DataFrame, bad: DataFrame, kind: str, model: str) -> DataFrame:
    """The bad files of ``parsed`` where its rows are written: of a parser that takes no rows from bad files only the files without any are read again."""
    if (kind, model) not in BY_FILE:
        return bad
    without = _known(_without(lines, rows))
    if without.isEmpty():
        return without.withColumn("reason", F.lit(""))
    return parsed(lines.join(without, "source_file", "left_semi"), kind, model)[1]


def column(raw: str) -> Column:
    return F.try_element_at("raw", F.lit(raw))
