"""Sources and sinks, and adapters from the star schema to event, edge, prediction and vector tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_id, number

ORIGIN, SPAN = "2024-01-01 00:00:00", 2_592_000.0
FOCAL = ("purchase", "click")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, call_id, label, start_s, end_s, focal, k): closed intervals in seconds since the clip's origin."""
    start = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{ORIGIN}', ts)") / F.lit(1e6)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("call_id"), F.col("event_type").alias("label"), start.alias("start_s"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select("clip", "call_id", "label", "start_s", (F.col("start_s") + F.col("value")).alias("end_s"), F.col("label").isin(*FOCAL).alias("focal"), "k")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, clip, label, fold, target, y, m0, m1, valid): two models' probabilities for two targets a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    j = d.join(table(spark, sf_dir, "labels"), "doc_id")
    score = lambda width: 1 / (1 + F.exp(-(F.col("n_chars") - 1500) / F.lit(float(width))))
    fold = (F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 5 + 1).alias("fold")
    each = F.explode(F.array(F.struct(F.lit("post").alias("target"), F.col("quality").alias("y")), F.struct(F.lit("pre").alias("target"), F.col("toxic").alias("y")))).alias("x")
    return j.select(F.col("doc_id").alias("call_id"), F.col("source").alias("clip"), F.col("lang").alias("label"), fold, score(2000).alias("m0"), score(1000).alias("m1"), (F.col("n_chars") < 5000).alias("valid"), each).select("call_id", "clip", "label", "fold", "x.target", "x.y", "m0", "m1", "valid")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, cluster, v)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 4).alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))


# -- reading text and writing


def read_csv(spark: SparkSession, path: str, schema: str | None = None, raw: bool = False) -> DataFrame:
    """A CSV file with a header. ``raw``: all strings, and empty cells stay empty strings."""
    r = spark.read.option("header", True)
    if raw:
        return r.option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path).na.fill("")
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def ragged_pairs(lines: DataFrame, fixed: Sequence[str], line: str = "value") -> DataFrame:
    """Lines of some fixed cells and any number of (start, end) cells as one row a pair, numbered from 1.

    A pair with a blank or unreadable cell, and an odd last cell, give no row;
    numbers count places in the line, so they may have gaps.
    """
    cells = F.transform(F.split(line, ",", -1), lambda x: F.trim(x))  # a function of two would get the position as well
    t = lines.select(*(F.try_element_at(cells, F.lit(k + 1)).alias(c) for k, c in enumerate(fixed)), F.slice(cells, len(fixed) + 1, F.greatest(F.size(cells) - len(fixed), F.lit(0))).alias("cells__"))
    n = F.floor(F.size("cells__") / 2).cast("int")
    pairs = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(k.alias("ordinal"), number(F.element_at("cells__", 2 * k - 1)).alias("start"), number(F.element_at("cells__", 2 * k)).alias("end")))
    return t.select(*fixed, F.explode(pairs).alias("p")).select(*fixed, "p.*").where("start is not null and `end` is not null")


def zipped(df: DataFrame, arrays: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Parallel arrays, some shorter, as rows: missing cells are null, ``position`` counts from 0."""
    return df.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("position", "z")).select(*keep, "position", "z.*")


def resolve(columns: Sequence[str], candidates: Sequence[str], override: str | None = None, required: bool = True) -> str | None:
    """The first candidate that names a column, whatever its case and outer blanks; an override must exist."""
    by = {c.strip().lower(): c for c in reversed(columns)}
    for c in [override] if override else candidates:
        if c.strip().lower() in by:
            return by[c.strip().lower()]
    if required or override:
        raise ValueError(f"none of {[override] if override else list(candidates)} is a column")
    return None


def feature_columns(df: DataFrame, drop: str = r"$^", include: str = "", exclude: str = "") -> list[str]:
    """Numeric columns that no pattern drops; ``include`` and ``exclude`` are masks."""
    numeric = [c for c, t in df.dtypes if re.match(r"(tinyint|smallint|int|bigint|float|double|decimal)", t)]
    return [c for c in numeric if not re.search(drop, c) and re.search(include, c) and not (exclude and re.search(exclude, c))]


def normalised(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(call_id, clip, label, start_s, end_s, duration_s) from columns by role; rows that lack a key or a bound go."""
    t = df.select(clean_id(F.col(roles["call_id"])).alias("call_id"), F.col(roles["clip"]).cast("string").alias("clip"), F.col(roles["label"]).cast("string").alias("label"), number(F.col(roles["start"])).alias("start_s"), number(F.col(roles["end"])).alias("end_s"))
    return t.withColumn("duration_s", F.col("end_s") - F.col("start_s")).na.drop(subset=["clip", "start_s", "end_s"])


def checked_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table, if its key is one; raises otherwise."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{list(keys)} is no key: {twice[0].asDict()}")
    return df


def joined_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", one_left: bool = False) -> DataFrame:
    """An equi-join whose right side (and left, if asked) has each key once."""
    return (checked_unique(left, on) if one_left else left).join(checked_unique(right, on), list(on), how)


PRIVATE = ("call_id", "clip", "source_id", "path", "source_wav", "start_s", "end_s")


def export(df: DataFrame, path: str, deny: Sequence[str] = PRIVATE) -> None:
    """Writes an aggregate as CSV, and refuses tables with columns of single rows."""
    if bad := [c for c in df.columns if c.lower() in deny]:
        raise ValueError(f"row-level columns: {bad}")
    df.coalesce(1).write.option("header", True).csv(path)


def union_all(*tables: DataFrame) -> DataFrame:
    """One under the other, by name; missing columns are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def when_map(x: Column, book: dict) -> Column:
    """Codes to names; a code without a name stays as it is."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in book.items() for v in kv)), x), x.cast("string"))


# -- files: many of them, text, and commits by rename


def headers(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(file, position, column) from the first line of every CSV file below a folder, whatever their columns are."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", False).text(path)
    lines = lines.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("n"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("line"))
    return first.select("file", F.posexplode(F.split("line", ",", -1)).alias("position", "column"))


def scan(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """All CSV files below a folder at any depth, with the name of each row's file."""
    t = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path)
    return t.select("*", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("folder"))


def ragged_wide(lines: DataFrame, fixed: Sequence[str], most: int | None = None, prefix: str = "cell_", line: str = "value") -> DataFrame:
    """Lines of differing length as columns: the fixed ones, then cell_1 and so on, null where a line is shorter.

    There are as many columns as the longest line has cells; a line with more than ``most``, where given, is an error.
    """
    cells = F.split(line, ",", -1)
    longest = max(0, (lines.agg(F.max(F.size(cells))).first()[0] or 0) - len(fixed))
    if most is not None and longest > most:
        raise ValueError(f"a line has {longest} cells, more than {most}")
    most = longest if most is None else most
    return lines.select(*(F.try_element_at(cells, F.lit(k + 1)).alias(c) for k, c in enumerate(fixed)), *(F.try_element_at(cells, F.lit(len(fixed) + k)).alias(f"{prefix}{k}") for k in range(1, most + 1)))


def moved_into_place(df: DataFrame, path: str) -> None:
    """Writes a table beside ``path`` and renames it when it is complete: a reader sees all of it or nothing."""
    spark, tmp = df.sparkSession, path.rstrip("/") + ".tmp"
    jvm = spark.sparkContext._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to):
        raise FileExistsError(path)
    try:
        df.write.mode("overwrite").parquet(tmp)
        if fs.exists(to):
            raise FileExistsError(path)
        if not fs.rename(at, to):
            raise OSError(f"could not rename {tmp}")
    finally:
        fs.delete(at, True)  # nothing is there once it is renamed


def markdown(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(line, text) of a table for Markdown: numbers with 6 significant digits, null as nothing. For aggregates: rows are numbered in one order."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            x = F.col(c).cast("double")
            digits = 5 - F.floor(F.log10(F.abs(x)))
            up, down = F.pow(F.lit(10.0), F.greatest(digits, F.lit(0))), F.pow(F.lit(10.0), F.greatest(-digits, F.lit(0)))
            six = F.when((x == 0) | (F.abs(x) < 1e-290), F.lit(0.0)).when(digits >= 0, F.rint(x * up) / up).otherwise(F.rint(x / down) * down)
            return F.coalesce(F.when(F.isnan(x), F.lit("")).otherwise(six.cast("string")), F.lit(""))
        return F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))

    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("line"), row.alias("text"))
    head = [(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + " --- |" * len(df.columns))]
    return df.sparkSession.createDataFrame(head, "line int, text string").unionByName(body)


def flattened(df: DataFrame, prefix: str = "") -> DataFrame:
    """Nested structs as columns named by their path (``a_b_c``)."""
    from pyspark.sql import types as T

    def walk(schema, path, name):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, [*path, f.name], f"{name}{f.name}_")
            else:
                yield F.col(".".join(f"`{x}`" for x in [*path, f.name])).alias(f"{name}{f.name}")

    return df.select(*walk(df.schema, [], prefix))
