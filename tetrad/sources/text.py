"""Readers and writers of the text formats.

Readers take a DataFrame with a ``value`` column of lines (from
``spark.read.text`` or any other source), so the same parsing works on files,
tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tetrad.functions.strings import trivial_analogy, valid_analogy

RATIO, CONFORMITY, COMMENT, EQUAL, HOLE = " : ", " :: ", "#", " == ", "None"


def word_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct trimmed non-empty lines as ``word``."""
    return lines.select(F.trim(F.col(column)).alias("word")).where("word <> ''").distinct()


def sniff_sigmorphon(lines: DataFrame, column: str = "value") -> str:
    """'plain', 'sig2016' or 'sig2017', from one line of three fields (if there is one)."""
    first = lines.select(F.split(column, "\t").alias("f")).limit(1).first()
    if first is None or len(first["f"]) != 3:
        return "plain"
    _, second, third = first["f"]
    if "," in second or "=" in second:
        return "sig2016"
    if ";" in third:
        return "sig2017"
    raise ValueError("three fields, but no known feature format")


def sigmorphon(lines: DataFrame, year: int = 2017, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(lemma, form, msd, feats) of the lines with exactly three fields, behind the columns to keep."""
    f = F.split(F.rtrim(F.col(column)), "\t")
    lemma, form, msd = (f[0], f[1], f[2]) if year >= 2017 else (f[0], f[2], f[1])
    rows = lines.where(F.size(f) == 3).select(*keep, lemma.alias("lemma"), form.alias("form"), msd.alias("msd"))
    return rows.withColumn("feats", F.array_distinct(F.split("msd", ";" if year >= 2017 else ",")))


def blind(lines: DataFrame, column: str = "value") -> DataFrame:
    """(lemma, msd) of the lines with exactly two fields."""
    f = F.split(F.rtrim(F.col(column)), "\t")
    return lines.where(F.size(f) == 2).select(f[0].alias("lemma"), f[1].alias("msd"))


def forms_and_lemmas(triples: DataFrame, lemma_feature: bool = False) -> DataFrame:
    """(word, feats): every form, and every lemma with the feature LEMMA=YES."""
    feats = F.concat("feats", F.array(F.concat(F.lit("LEMMA="), "lemma"))) if lemma_feature else F.col("feats")
    forms = triples.select(F.col("form").alias("word"), feats.alias("feats"))
    lemmas = triples.select(F.col("lemma").alias("word"), F.array(F.lit("LEMMA=YES")).alias("feats")).distinct()
    return forms.unionByName(lemmas)


def last_of_each_form(triples: DataFrame, order: str) -> DataFrame:
    """One row a form, the one of the largest ``order``."""
    last = F.row_number().over(Window.partitionBy("form").orderBy(F.desc(order)))
    return triples.withColumn("_n", last).where("_n = 1").drop("_n")


def language_split(spark: SparkSession, root: str, language: str, mode: str = "dev", category: str | None = None) -> DataFrame:
    """(category, family, lang, mode, lemma, form, msd, feats) of the files
    ``<root>/<category>/<family>/<language>.<mode>``; only those files are read."""
    if len(language) != 3 or mode not in ("trn", "dev", "tst"):
        raise ValueError("a three-letter language and trn, dev or tst are needed")
    place = root.rstrip("/") + (f"/{category}" if category else "")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{language}.{mode}").text(place)
    folder = F.split(F.input_file_name(), "/")
    named = files.select("value", F.element_at(folder, -3).alias("category"), F.element_at(folder, -2).alias("family"), F.lit(language).alias("lang"), F.lit(mode).alias("mode"))
    return sigmorphon(named, keep=("category", "family", "lang", "mode"))


def vectors(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, v) of ``word<TAB>(1, 0, 2)`` lines; comment lines are skipped."""
    f = F.split(F.col(column), "\t")
    numbers = F.transform(F.regexp_extract_all(f[1], F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("int"))
    return lines.where(~F.col(column).startswith(COMMENT) & (F.size(f) == 2)).select(f[0].alias("word"), numbers.alias("v"))


def clusters(lines: DataFrame, column: str = "value") -> DataFrame:
    """(cluster_id, pos, a, b) of ``A : B :: C : D`` lines; the line is the id."""
    line = F.trim(F.col(column))
    rows = lines.where(~line.startswith(COMMENT) & line.contains(RATIO)).select(line.alias("cluster_id"))
    rows = rows.select("cluster_id", F.posexplode(F.split("cluster_id", CONFORMITY)).alias("pos", "r"))
    r = F.split("r", RATIO)
    return rows.select("cluster_id", "pos", F.trim(r[0]).alias("a"), F.trim(r[1]).alias("b"))


def cluster_file(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """The classes of equivalents of a cluster file's header, and its clusters;
    marks before a cluster are no part of its first word."""
    unmarked = lines.withColumn(column, F.regexp_replace(F.col(column), r"^(\d+\t)?(OOO |XXX )?", ""))
    return equivalents(lines, column), clusters(unmarked, column)


def analogies(lines: DataFrame, column: str = "value") -> DataFrame:
    """(a, b, c, d) of ``a : b :: c : d`` lines of two ratios, without those that
    are invalid or trivial."""
    rows = clusters(lines, column).groupBy("cluster_id").agg(F.array_sort(F.collect_set(F.struct("pos", "a", "b"))).alias("r")).where(F.size("r") == 2)
    quads = rows.select(*[F.col("r")[i][w].alias(n) for i, w, n in ((0, "a", "a"), (0, "b", "b"), (1, "a", "c"), (1, "b", "d"))])
    return quads.where(valid_analogy("a", "b", "c", "d") & ~trivial_analogy("a", "b", "c", "d"))


def equivalents(lines: DataFrame, column: str = "value") -> DataFrame:
    """(rep, members) of ``# a == b == c`` lines."""
    line = F.col(column)
    rows = lines.where(line.startswith(COMMENT) & line.contains(EQUAL))
    members = F.array_sort(F.transform(F.split(F.regexp_replace(line, r"^#\s*", ""), EQUAL), lambda w: F.trim(w)))
    return rows.select(members.alias("members")).select(F.get("members", F.lit(0)).alias("rep"), "members")


def grids(lines: DataFrame, column: str = "value") -> DataFrame:
    """(grid_id, row, col, word) of ``w : w :: w : None`` lines; holes are no rows."""
    line = F.trim(F.col(column))
    rows = lines.where(~line.startswith(COMMENT) & (line != "")).select(line.alias("grid_id"))
    rows = rows.select("grid_id", F.posexplode(F.split("grid_id", CONFORMITY)).alias("row", "r"))
    rows = rows.select("grid_id", "row", F.posexplode(F.split("r", RATIO)).alias("col", "word"))
    return rows.withColumn("word", F.trim("word")).where(F.col("word") != HOLE)


def markdown_languages(lines: DataFrame, order: str = "line_no", column: str = "value") -> DataFrame:
    """(code, family, name) of a Markdown table whose family cell is empty when it
    is that of the row above; the first two lines are its head."""
    cell = F.transform(F.split(F.col(column), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.col(order) > 2).select(order, F.get(cell, F.lit(1)).alias("f"), F.get(cell, F.lit(2)).alias("name"), F.get(cell, F.lit(3)).alias("code"))
    above = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a table of languages: some hundreds of rows
    family = F.lower(F.last(F.expr("nullif(f, '')"), ignorenulls=True).over(above))
    return rows.select("code", F.when(family == "indo-european", "germanic").otherwise(family).alias("family"), "name")


def tuple_cell(cell: Column | str, index: int = 1) -> Column:
    """A number of a cell like ``(0.9, 0.8, 0.7)``."""
    found = F.regexp_extract_all(cell, F.lit(r"[-+0-9.eE]+|nan"), F.lit(0))
    return F.nullif(F.get(found, F.lit(index)), F.lit("nan")).cast("double")


ACCURACIES = ("acc_valid", "acc_invalid", "acc_raw")


def matrix_table(long: DataFrame, values: tuple[str, ...] = ACCURACIES) -> DataFrame:
    """A matrix (model_lang, data_lang, and values) as a wide table: a row for each
    model, a column for each data language, cells like ``(0.9, 0.8, 0.7)``."""
    said = F.concat(F.lit("("), F.concat_ws(", ", *[F.coalesce(F.col(v).cast("string"), F.lit("nan")) for v in values]), F.lit(")"))
    return long.groupBy("model_lang").pivot("data_lang").agg(F.first(said))


def matrix(wide: DataFrame, values: tuple[str, ...] = ACCURACIES) -> DataFrame:
    """Such a table as a matrix again: whatever its columns are called, the first
    one names the models and the others are data languages; empty cells go."""
    first, *others = wide.columns
    cells = wide.select(F.col(f"`{first}`").alias("model_lang"), *[F.col(f"`{c}`").cast("string").alias(c) for c in others])
    if not others:
        return cells.select("model_lang", F.lit(None).cast("string").alias("data_lang"), *[F.lit(None).cast("double").alias(v) for v in values]).limit(0)
    long = cells.unpivot("model_lang", [f"`{c}`" for c in others], "data_lang", "cell").where("cell is not null")
    return long.select("model_lang", "data_lang", *[tuple_cell("cell", i).alias(v) for i, v in enumerate(values)])


def write_matrix(long: DataFrame, path: str, values: tuple[str, ...] = ACCURACIES) -> None:
    """A matrix as a CSV file with a head, models in order."""
    matrix_table(long, values).orderBy("model_lang").coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_matrix(spark: SparkSession, path: str, values: tuple[str, ...] = ACCURACIES) -> DataFrame:
    return matrix(spark.read.csv(path, header=True), values)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


# ---- lines to write -----------------------------------------------------------


def vector_lines(rows: DataFrame) -> DataFrame:
    """``word<TAB>(1, 0, 2)`` of (word, v)."""
    return rows.select(F.concat("word", F.lit("\t("), F.array_join(F.col("v").cast("array<string>"), ", "), F.lit(")")).alias("value"))


def equivalent_lines(classes: DataFrame) -> DataFrame:
    """``# a == b`` of (members), for classes of two words or more."""
    return classes.where(F.size("members") > 1).select(F.concat(F.lit("# "), F.array_join("members", EQUAL)).alias("value"))


def vector_file(vectors: DataFrame) -> DataFrame:
    """(value): the lines of a vector file, classes of equivalents first, then
    the vectors of their representatives alone."""
    classes = vectors.groupBy("v").agg(F.array_sort(F.collect_set("word")).alias("members"))
    return class_file(classes.select(F.get("members", F.lit(0)).alias("rep"), "members", "v"))


def class_file(classes: DataFrame, ordered: bool = True) -> DataFrame:
    """(value): the same file of (rep, members, v); without ``ordered``, its lines
    as they come, for readers to whom their order is nothing."""
    head = equivalent_lines(classes).select(F.lit(0).alias("_part"), "value")
    body = vector_lines(classes.select(F.col("rep").alias("word"), "v")).select(F.lit(1).alias("_part"), "value")
    lines = head.union(body)
    return (lines.orderBy("_part", "value") if ordered else lines).select("value")


def cluster_lines(ratios: DataFrame, first: int | None = None, marks: DataFrame | None = None, sizes: bool = False) -> DataFrame:
    """(cluster_id, size, value) of (cluster_id, pos, a, b), largest first; with
    ``first``, only so many ratios are written; with ``marks`` (cluster_id, mark)
    a cluster's mark stands before it, with ``sizes`` its size and a tab."""
    joined = ratios.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("r"))
    written = F.transform("r", lambda x: F.concat(x["a"], F.lit(RATIO), x["b"]))
    shown = F.slice(written, 1, first) if first else written
    value = F.array_join(shown, CONFORMITY)
    if marks is not None:
        joined = joined.join(marks, "cluster_id", "left")
        value = F.concat(F.coalesce("mark", F.lit("")), value)
    if sizes:
        value = F.concat(F.size("r").cast("string"), F.lit("\t"), value)
    return joined.select("cluster_id", F.size("r").alias("size"), value.alias("value")).orderBy(F.desc("size"), "value")


def grid_lines(cells: DataFrame) -> DataFrame:
    """(grid_id, value) of (grid_id, row, col, word), holes written as None."""
    shape = cells.groupBy("grid_id").agg(F.max("row").alias("r"), F.max("col").alias("c"))
    full = shape.select("grid_id", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("row"), "c").select("grid_id", "row", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("col"))
    named = full.join(cells, ["grid_id", "row", "col"], "left").withColumn("word", F.coalesce("word", F.lit(HOLE)))
    rows = named.groupBy("grid_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "word"))), lambda x: x["word"]), RATIO).alias("line"))
    return rows.groupBy("grid_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), CONFORMITY).alias("value"))


def statistics_lines(counted: DataFrame) -> DataFrame:
    """(value): tab-separated ``size saturation freq`` lines, smallest first."""
    return counted.orderBy("size", "saturation").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("size", "saturation", "freq")]).alias("value"))


def pretty_grids(cells: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(grid_id, row, value): rows aligned by padding every cell to the grid's
    longest word; with ``attributes`` (grid_id, ...) they stand above it, as row -1."""
    lines = grid_lines(cells)
    parsed = lines.select("grid_id", F.posexplode(F.split("value", CONFORMITY)).alias("row", "line")).withColumn("cells", F.split("line", RATIO))
    width = parsed.groupBy("grid_id").agg(F.max(F.array_max(F.transform("cells", lambda w: F.length(w)))).alias("w"))
    padded = F.transform("cells", lambda w: F.rpad(F.when(w == HOLE, F.lit("")).otherwise(w), F.col("w"), " "))
    rows = parsed.join(width, "grid_id").select("grid_id", "row", F.array_join(padded, RATIO).alias("value"))
    if attributes is None:
        return rows
    named = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in attributes.columns if c != "grid_id"]
    return rows.unionByName(attributes.select("grid_id", F.lit(-1).alias("row"), F.concat(F.lit("# "), F.concat_ws(" ", *named)).alias("value")))


def to_json_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON object of a small table of keys and values."""
    return rows.groupBy().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("value"))


def concatenated(*files: DataFrame) -> DataFrame:
    """The lines of all files."""
    out = files[0]
    for other in files[1:]:
        out = out.unionByName(other)
    return out


def shuffled(lines: DataFrame, seed: int = 0) -> DataFrame:
    """Lines in an order that a seed gives."""
    return lines.orderBy(F.xxhash64(*lines.columns, F.lit(seed)), *lines.columns)
