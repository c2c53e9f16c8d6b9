"""Crawl tables as audit input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sitegauge.functions.urls import normalize_url
from sitegauge.schema import PAGE

# Optional crawl columns and the value a page gets when the table lacks them.
DEFAULTS = {
    "final_url": lambda: F.col("url"),
    "status": lambda: F.lit(200),
    "reason": lambda: F.lit(""),
    "fetch_error": lambda: F.lit(None).cast("string"),
    "headers": lambda: F.create_map().cast("map<string,string>"),
    "redirect_hops": lambda: F.lit(0),
    "crawled_at": lambda: F.lit(None).cast("timestamp"),
}


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | None = None
) -> DataFrame:
    """Read a table by format; the format defaults to the path's suffix, else parquet.

    `schema` types JSON rows, which would otherwise be read twice to guess it.
    """
    known = {"json": "json", "jsonl": "json", "csv": "csv", "orc": "orc", "parquet": "parquet"}
    fmt = fmt or known.get(path.rstrip("/").rsplit(".", 1)[-1], "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    elif fmt == "json" and schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def header(headers: Column, name: str) -> Column:
    """Header value by case-insensitive name, NULL when absent."""
    hits = F.filter(F.map_entries(headers), lambda h: F.lower(h["key"]) == name.lower())
    return F.try_element_at(hits, F.lit(1))["value"]


def as_instant(df: DataFrame, column: str) -> DataFrame:
    """Read a time without zone as UTC, whatever the session's zone."""
    if df.schema[column].dataType.typeName() != "timestamp_ntz":
        return df
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column))
    return df.withColumn(column, local.cast("timestamp"))


def page_source(pages: DataFrame) -> DataFrame:
    """Normalise the URL and fill in the crawl columns a table may lack."""
    pages = pages.withColumn("url", normalize_url(F.col("url")))

    def given(name: str) -> Column:
        if name == "headers" and pages.schema[name].dataType == StringType():
            return F.from_json(name, "map<string,string>")  # text tables keep the map as JSON
        return F.col(name).cast(PAGE[name].dataType)

    optional = [
        (F.coalesce(given(name), default()) if name in pages.columns else default()).alias(name)
        for name, default in DEFAULTS.items()
    ]
    return pages.select("page_id", "url", "html", *optional)


# Session setting for small local runs; see `spread`.
SPREAD = "sitegauge.spread"


def spread(scan: DataFrame, key: str) -> DataFrame:
    """The scan, dealt over all cores by `key` where the session asks for it.

    For local runs on tables stored in one piece, which a scan cannot split. Off by
    default: a plan then never moves a page, whatever the number of splits and cores.
    """
    session = scan.sparkSession
    if session.conf.get(SPREAD, "false") != "true":
        return scan
    return scan.repartition(session.sparkContext.defaultParallelism, key)


def fetch_note(status: Column, reason: Column, fetch_error: Column) -> Column:
    """Why a page could not be scored, NULL when it was fetched."""

    def message(text: str) -> Column:
        return F.concat(F.lit("HTTP "), status.cast("string"), F.lit(text))

    return (
        F.when(fetch_error.isNotNull(), fetch_error)
        .when(status == 404, message(": no page at this address; check the path."))
        .when(status.isin(401, 403), message(": the site refused the request (login, paywall or bot wall)."))
        .when(status == 429, message(": too many requests; try again in a minute."))
        .when(status >= 500, message(": the site reported an error of its own; try again later."))
        .when(status >= 400, F.rtrim(F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" "), reason)))
    )
