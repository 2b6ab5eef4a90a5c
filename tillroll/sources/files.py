"""Delimited basket and catalogue files.

The text is scanned once, into a landing table: one row per line with its file,
the split it was read in and its number there. Everything else reads columns of
that table. Each file's first line decides its delimiter ('|' when present, else
',') and whether it is a header: it is data when all its cells are digits or when
it names none of the required columns. Cells are then mapped to the required
columns by header position (or by order for headerless files). The per-file
format table has one row per file, so it is the small side of its join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillroll.schemas import CATEGORY_COLUMNS, PRODUCT_CATEGORY_COLUMNS, TRANSACTION_COLUMNS
from tillroll.session import small_tasks, written

STORE_FILE_PATTERN = r"(?:^|/)(\d+)_Tran\.csv(?:/|$)"
# a store "file" may be a plain file or a directory of part files named like one
SOURCE_PATTERN = r"^((?:.*/)?[^/]*_Tran\.csv)"


def land(spark: SparkSession, paths) -> DataFrame:
    """The lines of text files as a stored table (file_path, block_start, pos,
    value): the only scan of the text. ``block_start`` names the split a line was
    read in, ``pos`` counts up within it. Being stored, the numbers are the same
    for every reader, whatever splits a second scan of the text would have had."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    small_tasks(spark)
    return written(numbered(with_source(spark.read.text(paths))), "landing")


def with_source(text: DataFrame) -> DataFrame:
    """The lines of a text source with their file and split."""
    return text.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), "value")


def numbered(lines: DataFrame) -> DataFrame:
    """The columns of a landing table, for lines with their file and split."""
    return lines.select("file_path", "block_start", F.monotonically_increasing_id().alias("pos"), "value")


def _unquote(cell):
    c = F.trim(cell)
    inner = F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.when(c.rlike(r'^".*"$') & (F.length(c) >= 2), inner).otherwise(cell)


def _split(value, delim):
    """Cells of a line; a delimiter inside double quotes does not separate, and
    a doubled quote inside quotes is one quote. Lines without quotes are cut plainly."""
    def at(suffix):
        return F.when(delim == "|", F.split(value, r"\|" + suffix, -1)).otherwise(F.split(value, "," + suffix, -1))

    outside = r'(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'
    return F.when(F.contains(value, F.lit('"')), F.transform(at(outside), _unquote)).otherwise(at(""))


def _splits(landed: DataFrame) -> DataFrame:
    """One row per split of a file: the position of its first line and how many
    lines it has. Reads three narrow columns of the landing table."""
    return landed.groupBy("file_path", "block_start").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_lines"))


def _first_lines(landed: DataFrame) -> DataFrame:
    """Each file's first line: only row groups that hold a file's first split are read."""
    return landed.filter(F.col("block_start") == 0).groupBy("file_path").agg(
        F.min("pos").alias("first_pos"), F.min_by("value", "pos").alias("first_line"))


def _lines_before(splits: DataFrame) -> DataFrame:
    """Per split the lines of its source in front of it. Files of a folder named
    like a store file follow each other by name. A window over splits, not lines."""
    source = F.regexp_extract("file_path", SOURCE_PATTERN, 1)
    w = Window.partitionBy(F.when(source != "", source).otherwise(F.col("file_path"))).orderBy("file_path", "block_start")
    return splits.select("file_path", "block_start", F.col("first_pos").alias("split_pos"),
                         (F.sum("n_lines").over(w) - F.col("n_lines")).alias("lines_before"))


def sniff_format(landed: DataFrame, required: list[str]) -> DataFrame:
    """One row per file: delimiter, has_header, header cells, column count,
    missing required columns and whether the layout is usable."""
    first = _first_lines(landed)
    delim = F.when(F.col("first_line").contains("|"), F.lit("|")).otherwise(F.lit(","))
    first = first.select("*", delim.alias("delimiter"))
    cells = F.transform(_split(F.col("first_line"), F.col("delimiter")), lambda c: F.trim(c))
    all_digits = F.forall(cells, lambda c: c.rlike(r"^[0-9]+$"))
    names_any = F.exists(cells, lambda c: c.isin(*required))
    headerless = all_digits | ~names_any
    missing = F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.array_contains(cells, r))
    return first.select(
        "file_path", "first_pos", "delimiter", (~headerless).alias("has_header"),
        F.when(~headerless, cells).alias("header"), F.size(cells).alias("n_columns"),
        F.when(headerless, F.array().cast("array<string>")).otherwise(missing).alias("missing_columns"),
        F.when(headerless, F.size(cells) == len(required)).otherwise(F.size(missing) == 0).alias("ok"))


def read_delimited(spark: SparkSession, paths, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lands the files and cuts their lines (see ``cut_lines``)."""
    return cut_lines(land(spark, paths), required)


def cut_lines(landed: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, formats) of landed lines: rows carry file_path, pos, row_no (the
    line's number in its source, from 0, whatever the read splits) and the required
    columns as strings, from files whose layout is usable; blank lines are skipped.

    A row per split gives the line numbers and a row per file the layouts, so the
    lines themselves are not sorted. These few rows go to the lines: by the sizes of
    their compressed files the planner would take the lines for the smaller side, and
    cut them all in the one task that holds the splits."""
    splits = _splits(landed)
    fmt = sniff_format(landed, required)
    layout = _lines_before(splits).join(
        fmt.filter("ok").select("file_path", "first_pos", "delimiter", "has_header", "header"), "file_path")
    j = landed.join(F.broadcast(layout), ["file_path", "block_start"])
    j = j.filter(~(F.col("has_header") & (F.col("pos") == F.col("first_pos"))) & (F.trim("value") != ""))
    cells = _split(F.col("value"), F.col("delimiter"))
    cols = []
    for i, name in enumerate(required):
        idx = F.when(F.col("has_header"), F.array_position(F.col("header"), name)).otherwise(F.lit(i + 1))
        cols.append(F.try_element_at(cells, idx.cast("int")).alias(name))
    row_no = F.col("lines_before") + F.col("pos") - F.col("split_pos")
    return j.select("file_path", "pos", row_no.alias("row_no"), *cols), fmt


def store_of_file(path_col="file_path"):
    return F.regexp_extract(F.col(path_col), STORE_FILE_PATTERN, 1)


def load_transactions(spark: SparkSession, raw_dir: str, store_ids=None) -> tuple[DataFrame, DataFrame]:
    """Baskets of every ``<store>_Tran.csv`` (or the listed stores) that passes
    the store gate, and a per-file report.

    Gate: a file is kept only when its layout is usable, its name is exactly
    ``<number>_Tran.csv`` and every row's store_id equals that number. The report
    has one row for every file found, with the reason of a rejection and the
    counts of rows whose date or customer id does not parse. Rows keep their
    text and say in ``problem`` why they can't be used, if so;
    ``typed_transactions`` converts them.

    The landed lines are cut into cells once and stored; the report reads the
    flags of that table, not the cells.
    """
    return gated(land(spark, f"{raw_dir.rstrip('/')}/*_Tran.csv"), store_ids)


def gated(landed: DataFrame, store_ids=None) -> tuple[DataFrame, DataFrame]:
    """``load_transactions`` of landed lines."""
    rows, fmt = cut_lines(landed, TRANSACTION_COLUMNS)
    rows, found = (df.select("*", store_of_file().alias("file_store"),
                             F.regexp_extract("file_path", SOURCE_PATTERN, 1).alias("source")) for df in (rows, fmt))
    if store_ids is not None:
        wanted = F.col("file_store").isin([str(s) for s in store_ids])
        rows, found = rows.filter(wanted), found.filter(wanted)
    store = F.trim("store_id").try_cast("int")
    foreign = store.isNull() | ~store.eqNullSafe(F.col("file_store").try_cast("int"))
    bad_date, bad_customer = _unparsable()
    problem = F.when(bad_date, "bad date").when(bad_customer, "bad customer id")
    rows = written(rows.select("*", foreign.alias("foreign"), bad_date.alias("bad_date"), bad_customer.alias("bad_customer"),
                               problem.alias("problem")), "loaded")
    per_file = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("foreign").alias("foreign_rows"),
        F.count_if("bad_date").alias("bad_dates"), F.count_if("bad_customer").alias("bad_customer_ids"))
    layouts = found.groupBy("source", "file_store").agg(
        F.bool_and("ok").alias("layout_ok"),
        F.array_distinct(F.flatten(F.collect_set("missing_columns"))).alias("missing_columns"))
    counts = ["rows", "foreign_rows", "bad_dates", "bad_customer_ids"]
    report = layouts.join(per_file, "source", "left").select(
        "source", "file_store", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "layout_ok", "missing_columns")
    reason = (F.when(F.col("file_store") == "", "file name has no store number of its own")
               .when(~F.col("layout_ok"), "columns missing or surplus")
               .when(F.col("foreign_rows") > 0, "rows of another store"))
    report = written(report.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()), "gate")
    good = report.filter("accepted").select("source")
    return rows.drop("foreign", "bad_date", "bad_customer").join(good, "source", "left_semi"), report


def _unparsable():
    """Conditions on text rows: the date, the customer id does not parse."""
    return (F.try_to_date(F.trim("date"), "yyyy-M-d").isNull(), F.trim("customer_id").try_cast("bigint").isNull())


def load_figures() -> list:
    """Aggregates over loaded text rows that tell whether they are whole: what a
    load observes while it writes (see ``quality.integrity_report``)."""
    bad_date, bad_customer = _unparsable()
    return [F.count(F.lit(1)).alias("rows"), F.count_if(bad_date).alias("null_date"),
            F.count_if(bad_customer).alias("null_customer_id"), F.count_if(F.col("products").isNull()).alias("null_products")]


def rejected_rows(rows: DataFrame) -> DataFrame:
    """Rows of accepted files that can't be used, as they were read, with the reason."""
    return rows.select("file_path", "row_no", "date", "store_id", "customer_id", "products", F.col("problem").alias("reason")) \
               .filter(F.col("reason").isNotNull())


def typed_transactions(rows: DataFrame) -> DataFrame:
    """date, store_id, customer_id typed (bad values -> null), products kept as text."""
    return rows.select(
        "file_path", "pos", "row_no",
        F.try_to_date(F.trim("date"), "yyyy-M-d").alias("date"),
        F.trim("store_id").try_cast("int").alias("store_id"),
        F.trim("customer_id").try_cast("bigint").alias("customer_id"),
        "products")


def preview(rows: DataFrame, source: str, n: int = 10) -> DataFrame:
    """The first n rows of the store file (or folder) named ``source``, as text."""
    return (rows.filter(F.endswith("source", F.lit(f"/{source}"))).orderBy("row_no").limit(n)
                .select("date", "store_id", "customer_id", "products"))


def read_catalogue(spark: SparkSession, paths, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rejected, report) of catalogue files of a kind in ``CATALOGUES``.

    rows are typed, with ``pos`` (duplicate keys are kept). rejected holds the
    lines whose ids don't parse, as they were read. The report has one row per
    file: its layout, its missing columns, how many rows it has and how many of
    them are rejected, and why the file is not accepted: its columns, or bad ids
    in a catalogue of which every row must be usable. Lines of a file whose columns
    are wrong can't be cut into cells, but are counted."""
    columns, bad_ids_refuse = CATALOGUES[kind]
    landed = land(spark, paths)
    rows, fmt = cut_lines(landed, list(columns))
    cells = [F.trim(c) if t == "string" else F.trim(c).try_cast(t) for c, t in columns.items()]
    bad = reduce(lambda a, b: a | b, [v.isNull() for v, t in zip(cells, columns.values(), strict=True) if t != "string"])
    uncut = landed.join(F.broadcast(fmt.filter(~F.col("ok")).select("file_path", "first_pos", "has_header")), "file_path").filter(
        ~(F.col("has_header") & (F.col("pos") == F.col("first_pos"))) & (F.trim("value") != ""))
    if kind == "product_category":  # a header of its own, which names no column
        own_header = lambda text: F.startswith(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("v.code"))
        rows, uncut = rows.filter(~own_header("product_id")), uncut.filter(~own_header("value"))
    rows = written(rows.select("file_path", "row_no", "pos", F.struct(*columns).alias("read"), bad.alias("bad"),
                               *[v.alias(c) for v, c in zip(cells, columns, strict=True)]), f"catalogue-{kind}")
    counts = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("bad_rows"))
    counts = counts.unionByName(uncut.groupBy("file_path").agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("bad_rows")))
    report = fmt.join(counts, "file_path", "left").select(
        "file_path", "has_header", "n_columns", "missing_columns", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"), F.col("ok").alias("layout_ok"))
    reason = F.when(~F.col("layout_ok"), "columns missing or surplus")
    if bad_ids_refuse:
        reason = reason.when(F.col("bad_rows") > 0, "ids that are not numbers")
    report = report.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    return rows.filter(~F.col("bad")).select("pos", *columns), rows.filter("bad").select("file_path", "row_no", "read.*"), report


#: columns and types of each kind; whether one bad id refuses the whole file
CATALOGUES = {
    "categories": (dict(zip(CATEGORY_COLUMNS, ("int", "string"), strict=True)), True),
    "product_category": (dict(zip(PRODUCT_CATEGORY_COLUMNS, ("bigint", "int"), strict=True)), False),
}


def _accepted_rows(spark: SparkSession, paths, kind: str) -> DataFrame:
    rows, _, report = read_catalogue(spark, paths, kind)
    faults = report.filter(~F.col("accepted")).orderBy("file_path").limit(10).collect()
    if faults:
        raise ValueError(f"{kind}: " + "; ".join(
            f"{r['file_path']}: {r['reason']}" + (f" ({', '.join(r['missing_columns'])})" if r["missing_columns"] else "")
            + (f" ({r['bad_rows']} rows)" if r["bad_rows"] else "") for r in faults))
    return rows


def load_categories(spark: SparkSession, paths) -> DataFrame:
    """category_id int, category_name trimmed. A file whose columns are wrong, or
    with an id that is not a number, is a ValueError that names it."""
    return _accepted_rows(spark, paths, "categories")


def load_product_category(spark: SparkSession, paths) -> DataFrame:
    """product_id bigint, category_id int; a 'v.Code' header line and rows with
    a non-numeric cell are left out (``read_catalogue`` counts and returns them).
    Duplicate products are kept. Wrong columns are a ValueError."""
    return _accepted_rows(spark, paths, "product_category")


def write_delimited(df: DataFrame, path: str, sep: str = "|", header: bool = False, compression: str = "none") -> None:
    # empty strings are written as nothing (not as a quoted "") so they read back empty
    df.write.mode("overwrite").option("sep", sep).option("header", header).option("emptyValue", "").option("escape", '"').option("compression", compression).csv(path)
