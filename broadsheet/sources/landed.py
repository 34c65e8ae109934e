"""Landed feed and entry files as binary: character sets from the XML declaration, bad files as rows of a status.

Every file gives one row, whatever it holds, so one broken file costs its own rows and not the job. ``status`` is ``ok`` or
the first of: ``empty`` (no bytes but white space), ``charset`` (a declared character set that is not known), ``bytes``
(bytes that the character set does not have), ``truncated`` (the root element or JSON value does not end) and ``format``
(neither XML feed nor JSON page). Only ``ok`` files have a ``body``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import ENTRY_PAGE

# Declared names of the character sets that can be read, and the reader's names for them.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1",
            "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16le": "UTF-16LE",
            "utf-16be": "UTF-16BE"}
SINGLE_BYTE = ("US-ASCII", "ISO-8859-1")
ROOT = r"(?is)\A.{0,4096}?<(rss|feed|rdf:RDF)(?![A-Za-z0-9_:])"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """``(file, fetched_at, content binary)`` of every file below ``path``.

    Scans pass over files without bytes; they are taken from the scan's own list of files, with a null ``fetched_at``.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # One call for all names; inputFiles() of Python asks for them one by one.
    names = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", scan._jdf.inputFiles())
    listed = spark.createDataFrame([(name,) for name in names.split("\n") if name], "place string")

    def one_form(place: str) -> Column:
        return F.regexp_replace(place, r"\A(\w+):/+", "$1:/").alias("place")

    empty = listed.select(one_form("place")).join(scan.select(one_form("_metadata.file_path")), "place", "left_anti").select(
        F.url_decode(F.replace(F.regexp_extract("place", "([^/]*)$", 1), F.lit("+"), F.lit("%2B"))).alias("file"),
        F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(b"").alias("content"))
    return scan.select(F.col("_metadata.file_name").alias("file"), F.col("modificationTime").alias("fetched_at"),
                       "content").unionByName(empty)


def _marked_charset(content: Column) -> Column:
    """Character set told by a byte order mark, else null."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "UTF-8").when(head.startswith("FFFE"), "UTF-16").when(head.startswith("FEFF"), "UTF-16")


def decoded(files: DataFrame) -> DataFrame:
    """Adds ``body`` and ``status`` (``ok``, ``empty``, ``charset`` or ``bytes``) in place of ``content``."""
    content = F.col("content")
    head = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(head, r"""\A\s*<\?xml[^>]*\sencoding\s*=\s*["']([^"']+)["']""", 1))
    known = F.create_map(*[F.lit(x) for pair in CHARSETS.items() for x in pair])
    charset = F.coalesce(_marked_charset(content), F.when(declared == "", "UTF-8"), F.try_element_at(known, declared))
    rows = files.withColumn("_charset", charset)
    text = F.when(F.col("_charset") == "UTF-8", F.try_validate_utf8(content.cast("string")))
    for name in SINGLE_BYTE:
        fits = F.lit(True) if name == "ISO-8859-1" else ~F.decode(content, "ISO-8859-1").rlike("[^\\x00-\\x7F]")
        text = text.when((F.col("_charset") == name) & fits, F.decode(content, "ISO-8859-1"))
    # Pairs of bytes: an odd number of them is not text, and Spark's decoder would stop the job.
    for name in ("UTF-16", "UTF-16LE", "UTF-16BE"):
        text = text.when((F.col("_charset") == name) & (F.length(content) % 2 == 0), F.decode(content, name))
    rows = rows.withColumn("body", F.regexp_replace(text, "\\A\uFEFF", ""))
    blank = (F.length(content) == 0) | F.decode(content, "ISO-8859-1").rlike(r"\A[\s\x00]*\z")
    status = (F.when(blank, "empty").when(F.col("_charset").isNull(), "charset").when(F.col("body").isNull(), "bytes")
              .otherwise("ok"))
    return rows.withColumn("status", status).drop("content", "_charset")


def _checked(rows: DataFrame, good: Column, format_ok: Column) -> DataFrame:
    status = F.when(F.col("status") != "ok", F.col("status")).when(~format_ok, "format").when(~good, "truncated").otherwise("ok")
    rows = rows.withColumn("status", status)
    return rows.withColumn("body", F.when(F.col("status") == "ok", F.col("body")))


def landed_feeds(spark: SparkSession, path: str) -> DataFrame:
    """``(file, fetched_at, body, status)`` of landed RSS and Atom files."""
    rows = decoded(read_landed(spark, path)).withColumn("_root", F.regexp_extract("body", ROOT, 1))
    ended = F.lower("body").rlike(r"</(rss|feed|rdf:rdf)\s*>\s*(<!--.*-->\s*)*\z")
    return _checked(rows, F.coalesce(ended, F.lit(False)), F.coalesce(F.col("_root") != "", F.lit(False))).drop("_root")


def landed_pages(spark: SparkSession, path: str, kind: str | Column) -> DataFrame:
    """``(file, kind, data, status)`` of landed JSON entry pages; ``data`` is null unless the status is ``ok``."""
    rows = decoded(read_landed(spark, path))
    parsed = F.from_json("body", ENTRY_PAGE, {"mode": "PERMISSIVE"})["data"]
    ended = F.col("body").rlike(r"\}\s*\z")
    rows = _checked(rows.withColumn("data", parsed), F.coalesce(ended, F.lit(False)),
                    F.coalesce(F.col("body").rlike(r"\A\s*\{"), F.lit(False)))
    whole = (F.col("status") == "ok") & F.col("data").isNull()
    return rows.withColumn("status", F.when(whole, "format").otherwise(F.col("status"))).select(
        "file", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), "data", "status")


def feeds_of(landed: DataFrame, feeds: DataFrame) -> DataFrame:
    """Raw feed rows of the good files; ``feeds`` maps ``file`` to ``name, url, ord``. Files without an entry are left out."""
    return landed.filter("status = 'ok'").join(feeds, "file").select(
        F.col("name").alias("feed_name"), F.col("url").alias("feed_url"), F.col("ord").alias("feed_ord"), "body",
        "fetched_at")


def file_status(*landed: DataFrame) -> DataFrame:
    """``(file, status)`` of all files of the given scans."""
    first, *rest = [x.select("file", "status") for x in landed]
    for frame in rest:
        first = first.unionByName(frame)
    return first
