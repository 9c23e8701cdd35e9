"""Readers of text tables (manifests, ranks, graphs, captures, documents) and writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path of each line of a manifest, gzipped or not; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def index_parts(paths: DataFrame, subset: str) -> DataFrame:
    """The manifest's paths of one subset; none is an error."""
    found = paths.where(F.contains(F.col("path"), F.lit(f"/subset={subset}/")))
    if found.isEmpty():
        raise ValueError(f"the manifest has no part of subset {subset}")
    return found


def ranks(lines: DataFrame) -> DataFrame:
    """Rank lines (value): at least five fields between white space, # lines are comments, numbers that don't parse are null."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 5)
    return rows.select(
        F.col("f")[0].try_cast("long").alias("harmonic_pos"),
        F.col("f")[1].try_cast("double").alias("harmonic_val"),
        F.col("f")[2].try_cast("long").alias("pagerank_pos"),
        F.col("f")[3].try_cast("double").alias("pagerank_val"),
        F.col("f")[4].alias("host_rev"),
    )


def domain_ranks(lines: DataFrame) -> DataFrame:
    """Strict: tabs, and all four numbers must parse or the line is dropped; a bad or missing number of hosts is 0."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 5)
    made = rows.select(
        F.concat_ws(".", F.reverse(F.split(F.col("f")[4], r"\."))).alias("domain"),
        F.col("f")[0].try_cast("long").alias("harmonic_pos"),
        F.col("f")[1].try_cast("double").alias("harmonic_val"),
        F.col("f")[2].try_cast("long").alias("pagerank_pos"),
        F.col("f")[3].try_cast("double").alias("pagerank_val"),
        F.coalesce(F.get("f", F.lit(5)).try_cast("long"), F.lit(0)).alias("n_hosts"),
    )
    return made.dropna(subset=["harmonic_pos", "harmonic_val", "pagerank_pos", "pagerank_val"])


def vertices(lines: DataFrame) -> DataFrame:
    """id and host_rev; lines that aren't both are skipped."""
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 2).select(f[0].try_cast("long").alias("id"), f[1].alias("host_rev")).where("id is not null")


def edges(lines: DataFrame) -> DataFrame:
    """src and dst; lines that aren't two numbers are skipped."""
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 2).select(f[0].try_cast("long").alias("src"), f[1].try_cast("long").alias("dst")).dropna()


CAPTURE = "urlkey string, timestamp string, url string, mime string, `mime-detected` string, status string, digest string, length string, offset string, filename string, languages string, encoding string"


def capture_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captures from JSON lines; lines that don't parse are dropped, all columns stay strings."""
    return spark.read.schema(CAPTURE).option("mode", "DROPMALFORMED").json(path).where("url is not null")


def document_lines(rows: DataFrame) -> DataFrame:
    """Documents from JSON lines with a URL; the language is the first of three names that is set."""
    names = [c for c in ("language", "content_language", "ContentLanguage") if c in rows.columns]
    language = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names], F.lit(""))
    return rows.where(F.coalesce(F.col("url"), F.lit("")) != "").select("url", "title", "text", language.alias("language"))


def numeric_parts(paths: DataFrame) -> DataFrame:
    """Part files with the number that orders them: part-2 comes before part-10."""
    return paths.withColumn("part", F.coalesce(F.regexp_extract("path", r"(\d+)\D*$", 1).try_cast("long"), F.lit(0))).orderBy("part", "path")


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def write_strings(df: DataFrame, path: str) -> None:
    """Every column as a string."""
    write_parquet(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]), path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def render(df: DataFrame, how: str) -> DataFrame:
    """Lines (value) of a result: json, jsonl, csv, tsv, list, url, markdown or raw."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    quoted = [F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x) for x in cells]
    lines = {
        "json": F.to_json(F.struct("*")),
        "jsonl": F.to_json(F.struct("*")),
        "csv": F.concat_ws(",", *quoted),
        "tsv": F.concat_ws("\t", *cells),
        "list": F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), x) for c, x in zip(df.columns, cells, strict=True)]),
        "url": F.col("url").cast("string") if "url" in df.columns else cells[0],
        "markdown": F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(x, F.lit("|"), F.lit("\\|")) for x in cells]), F.lit(" |")),
        "raw": F.concat_ws("", *cells),
    }
    return df.select(lines[how].alias("value"))


def headed(df: DataFrame, how: str) -> DataFrame:
    """Lines of a result with its header: csv, tsv, markdown, or table (auto is table), whose columns are as wide as their longest cell.

    A table's widths are one row, an aggregation over the result. Cells are one line each: line breaks in a table's cells become blanks.
    The header is the first line; the rows follow in their order.
    """
    names = df.columns
    if how in ("table", "auto"):
        cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[\r\n]+", " ") for c in names]
        found = df.agg(*[F.max(F.char_length(x)).alias(f"w{i}") for i, x in enumerate(cells)]).first()
        widths = [max(len(c), w or 0) for c, w in zip(names, found, strict=True)]
        lines = F.rtrim(F.concat_ws("  ", *[F.rpad(x, w, " ") for x, w in zip(cells, widths, strict=True)]))
        body, head = df.select(lines.alias("value")), ["  ".join(c.ljust(w) for c, w in zip(names, widths, strict=True)).rstrip()]
    else:
        head = {"csv": [",".join(names)], "tsv": ["\t".join(names)], "markdown": ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]}[how]
        body = render(df, how)
    first = df.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1)
    return first.unionAll(body)


def replace_table(spark: SparkSession, name: str, query: str) -> DataFrame:
    """A table made anew from a query; one row with its count."""
    spark.sql(query).write.mode("overwrite").saveAsTable(name)
    return spark.table(name).agg(F.count("*").alias("rows"))


def passthrough(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """Any SQL over named tables."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)
