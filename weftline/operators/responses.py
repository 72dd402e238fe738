"""Fetch results as rows: lists of urls, merged forms, answers matched to requests, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One url a line; empty lines and those that begin with ``#`` are left out."""
    return urls_of(spark.read.text(path), "value")


def urls_of(lines: DataFrame, column: str) -> DataFrame:
    return lines.withColumn("url", F.regexp_replace(column, r"^\s+|\s+$", "")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def merged_fields(form: Column, own: Column) -> Column:
    """A form's fields (maps) with one's own over them."""
    return F.map_zip_with(form, own, lambda k, a, b: F.coalesce(b, a))


def field_args(args: Column) -> Column:
    """``name=value`` texts as (name, value), split at the first equals sign; one without it is an error."""
    split = lambda a: F.when(F.contains(a, F.lit("=")), F.struct(F.regexp_extract(a, r"(?s)^([^=]*)=", 1).alias("name"), F.regexp_extract(a, r"(?s)^[^=]*=(.*)$", 1).alias("value"))).otherwise(F.raise_error(F.concat(F.lit("no = in "), a)).cast("struct<name:string,value:string>"))
    return F.transform(args, split)


def answered(requests: DataFrame, replies: DataFrame, timeout: float) -> DataFrame:
    """Each request (id, req_ts) with its first reply (id, resp_ts, outcome) in time; null without one. Equal ids, then a range."""
    met = requests.join(replies, "id").filter((F.col("resp_ts") >= F.col("req_ts")) & (F.col("resp_ts") <= F.col("req_ts") + timeout))
    first = met.groupBy("id", "req_ts").agg(F.min(F.struct("resp_ts", "outcome")).alias("r"))
    return requests.join(first, ["id", "req_ts"], "left").select(*requests.columns, F.col("r.resp_ts").alias("resp_ts"), F.col("r.outcome").alias("outcome"))


def shown(body: Column, most: int) -> Column:
    """A body as a console shows it: so many characters at most, with what is missing counted in bytes (0: no limit)."""
    if not most:
        return F.concat(F.lit("\n"), body)
    kept = F.substring(body, 1, most)
    more = F.octet_length(body) - F.octet_length(kept)
    return F.when(more > 0, F.concat(F.lit("\n"), kept, F.lit("\n\n... ["), more.cast("string"), F.lit(" more bytes]"))).otherwise(F.concat(F.lit("\n"), body))


def quoted(text: Column) -> Column:
    """A text as JSON writes it."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def compact_line(status: Column, size: Column, ms: Column, url: Column, error: Column) -> Column:
    whole = F.replace(F.format_number(ms, 0), F.lit(","), F.lit(""))
    return F.when(error.isNotNull(), F.concat(F.lit("ERR "), url, F.lit(" "), quoted(error))).otherwise(F.concat(status.cast("string"), F.lit(" "), size.cast("string"), F.lit("B "), whole, F.lit("ms "), url))


def full_text(status: Column, ms: Column, url: Column, error: Column, markdown: Column, with_body: bool, most: int) -> Column:
    """A result as a batch shows it in full: a heading, and below it the body cut to so many characters (0: no limit)."""
    whole = F.replace(F.format_number(ms, 0), F.lit(","), F.lit(""))
    head = F.concat(F.lit("\n\U0001f310 "), url, F.lit(" ["), status.cast("string"), F.lit(" "), whole, F.lit("ms]"))
    body = F.concat(F.lit("\n"), F.substring(markdown, 1, most) if most else markdown)
    shown_body = F.coalesce(body, F.lit("")) if with_body else F.lit("")
    return F.when(error.isNotNull(), F.concat(F.lit("\n\u274c "), url, F.lit(" - "), quoted(error))).otherwise(F.concat(head, shown_body))


def as_array(results: DataFrame, key: str, size: int, by: str, value: str = "json") -> DataFrame:
    """JSON values as arrays of at most ``size`` values, in the order of ``by``, one array for each run of keys; a whole batch as one
    array would be one row, so it is one only where the size covers it."""
    part = F.floor(F.col(key) / size).alias("part")
    rows = results.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(by, value))).alias("r"))
    return rows.select("part", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x[value]), ","), F.lit("]")).alias("json"))


def error_json(url: Column, error: Column) -> Column:
    return F.to_json(F.struct(error.alias("error"), url.alias("url")))


def as_json(url: Column, status: Column, content_type: Column, markdown: Column, title: Column, ms: Column) -> Column:
    """A result as JSON; the time to one decimal, halves away from zero."""
    meta = F.struct(title.alias("title"), F.octet_length(markdown).alias("content_length"), content_type.alias("content_type"))
    return F.to_json(F.struct(url.alias("url"), status.alias("status"), content_type.alias("content_type"), markdown.alias("markdown"), meta.alias("metadata"), (F.round(ms * 10) / 10).alias("elapsed_ms")))


def documents_of(results: DataFrame) -> DataFrame:
    """Results as (page_content, metadata) for retrieval; failed ones have status 0 and no text."""
    meta = F.struct(F.col("url").alias("source"), F.coalesce("status", F.lit(0)).alias("status"), F.coalesce(F.octet_length("markdown"), F.lit(0)).alias("size"), F.col("time_ms"))
    return results.select(F.coalesce("markdown", F.lit("")).alias("page_content"), meta.alias("metadata"))


def cookie_lines(domain: Column, path: Column, secure: Column, expires: Column, name: Column, value: Column) -> Column:
    """Rows of a supplied cookie table in the seven tab-separated columns of cookie files."""
    flag = lambda c: F.when(c, "TRUE").otherwise("FALSE")
    return F.concat_ws("\t", domain, flag(F.startswith(domain, F.lit("."))), path, flag(secure), expires.cast("string"), name, value)


def preview(text: Column) -> Column:
    return X.truncate(text, 500)
