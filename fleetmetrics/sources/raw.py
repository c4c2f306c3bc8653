"""Raw metric payloads: JSON scan, path fallbacks and the partitioned JSON sink."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.timestamps import parse_utc
from ..schemas import RAW_PAYLOAD

CORRUPT = "_corrupt"
#: The type a document gives its datapoints, where whole documents are parsed.
LIST_TYPE = "_list_type"
# Fixed value: the folder a partitioned sink writes for NULL.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: Raw objects: one JSON document a file, and the JSON lines that :func:`write_raw` lands.
RAW_FILES = "{*.json,part-*.txt,part-*.txt.gz}"
#: Documents in one compressed file, which one task reads as a whole.
COMPRESSED_FILE_ROWS = 100_000
#: Files that one landing task keeps open; it sorts what is left when it meets more directories.
OPEN_FILES = 100
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _plain_path(path: str) -> str:
    """A root as the plain path that file metadata shows after its scheme."""
    if re.match(_SCHEME, path):
        return re.sub(_SCHEME, "", path).rstrip("/")
    return os.path.abspath(path)


def _file_path() -> Column:
    """The scanned file's path, percent-decoded, without scheme and authority."""
    uri = F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "")
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def path_value(path: Column, key: str) -> Column:
    """First Hive-style ``key=value`` segment of a path; NULL if absent, empty or written for NULL."""
    value = F.regexp_extract(F.concat(F.lit("/"), path), rf"/{key}=([^/]*)", 1)
    return F.nullif(F.nullif(value, F.lit("")), F.lit(NULL_FOLDER))


def relative_name(path: Column, root: str) -> Column:
    """``path`` relative to ``root``, or the full path when it lies elsewhere."""
    prefix = _plain_path(root) + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def with_origin(raw: DataFrame, root: str) -> DataFrame:
    """Add ``source_file``, ``source_bytes``, ``path_account_id`` and ``path_region`` from file metadata.

    Partition discovery is not used: it would read account "012..." as a
    number, and the path's ``region`` would collide with the payload's.
    """
    path = _file_path()
    return raw.withColumns(
        {
            "source_file": relative_name(path, root),
            "source_bytes": F.col("_metadata.file_size"),
            "path_account_id": path_value(path, "account_id"),
            "path_region": path_value(path, "region"),
        }
    )


def scan_schema() -> T.StructType:
    return T.StructType(RAW_PAYLOAD.fields + [T.StructField(CORRUPT, T.StringType())])


def scan_options(multi_line: bool = True) -> dict[str, str]:
    return {
        "multiLine": str(multi_line).lower(),
        "recursiveFileLookup": "true",
        "pathGlobFilter": RAW_FILES,
        "columnNameOfCorruptRecord": CORRUPT,
    }


def _documents(spark: SparkSession, paths: list[str], multi_line: bool) -> DataFrame:
    """Whole documents as VARIANT: NULL where a text is no JSON object.

    Typed columns come out of the variant, as text where the scan schema has text, beside the
    type that the document gives ``datapoints`` (NULL if it has none).
    """
    texts = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", RAW_FILES)
        .text(paths, wholetext=multi_line)
        .where(F.col("value").rlike(r"\S"))
    )
    parsed = F.expr("try_parse_json(value)")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    docs = texts.select(F.when(is_object, parsed).alias("document"), "_metadata")
    fields = {f.name: F.try_variant_get("document", f"$.{f.name}", f.dataType.simpleString()) for f in RAW_PAYLOAD.fields}
    fields["datapoints"] = F.expr(
        "transform(try_variant_get(document, '$.datapoints', 'array<variant>'), p -> named_struct("
        "'timestamp', try_variant_get(p, '$.timestamp', 'string'), 'value', try_variant_get(p, '$.value', 'string')))"
    )
    held = F.schema_of_variant(F.try_variant_get("document", "$.datapoints", "variant"))
    corrupt = F.when(F.col("document").isNull(), F.lit("no JSON object"))
    return docs.select(
        *[c.alias(name) for name, c in fields.items()], corrupt.alias(CORRUPT), held.alias(LIST_TYPE), "_metadata"
    )


def read_raw(
    spark: SparkSession,
    root: str,
    partitioned_only: bool = False,
    collection_dates: Iterable[str] | None = None,
    multi_line: bool = True,
    variant: bool = False,
) -> DataFrame:
    """Scan every ``*.json`` payload under ``root``.

    ``partitioned_only`` leaves out objects whose first segment is not
    ``account_id=``. The globs it adds also let Spark list the account
    directories in parallel. ``collection_dates`` narrows the listing itself to
    those ``date=`` directories, which is what an hourly refresh should pass.
    ``multi_line`` reads one (pretty-printed) document per file; switch it off
    for JSON lines, which Spark can also split. ``variant`` parses whole documents
    first: it tells a ``datapoints`` that is JSON ``null`` or no list from a missing
    one, which a scan with a schema cannot, and costs a parse of the fields nobody reads.
    """
    base = root.rstrip("/")
    if collection_dates is not None:
        paths = [f"{base}/account_id=*/region=*/metric=*/date={day}" for day in collection_dates]
    elif partitioned_only:
        paths = [f"{base}/account_id=*"]
    else:
        paths = [base]
    try:
        if variant:
            raw = _documents(spark, paths, multi_line)
        else:
            raw = spark.read.schema(scan_schema()).options(**scan_options(multi_line)).json(paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"No raw JSON files found under {root}") from error
        raise
    return with_origin(raw, root)


def stream_raw(
    spark: SparkSession,
    root: str,
    max_files_per_trigger: int = 100_000,
    multi_line: bool = True,
    partitioned_only: bool = False,
) -> DataFrame:
    """The payloads under ``root`` as a stream of files; ``partitioned_only`` as in :func:`read_raw`."""
    source = f"{root.rstrip('/')}/account_id=*" if partitioned_only else root
    stream = (
        spark.readStream.schema(scan_schema())
        .options(**scan_options(multi_line))
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(source)
    )
    return with_origin(stream, root)


def list_objects(spark: SparkSession, root: str, pattern: str = RAW_FILES) -> DataFrame:
    """(name, length) of the objects under ``root``; contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(
            relative_name(F.regexp_replace("path", _SCHEME, ""), root).alias("name"),
            F.col("length"),
        )
    )


def object_counts(spark: SparkSession, root: str) -> DataFrame:
    """One row: objects that carry an account partition and objects that do not."""
    partitioned = F.col("name").startswith("account_id=")
    return list_objects(spark, root).agg(
        F.count_if(partitioned).alias("partitioned_count"),
        F.count_if(~partitioned).alias("skipped_count"),
    )


@contextmanager
def _unsorted(spark: SparkSession) -> Iterator[None]:
    """Partitioned writes that keep a file open for each directory in place of sorting rows by directory."""
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, str(OPEN_FILES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def write_raw(payloads: DataFrame, root: str, compressed: bool = False) -> None:
    """Land payloads as JSON lines under ``account_id=/region=/metric=/date=``.

    ``date`` is the collection date. All partition columns are copies: the document keeps
    every field, ``region`` included, so it can be read without its path. A partitioned JSON
    sink would take ``region`` out of the document, hence documents are written as text. Payloads
    are rebalanced by directory, so that not every task leaves a
    small file in every directory. Documents are not sorted: a task meets few directories and keeps
    a file open for each (past ``OPEN_FILES`` it sorts the rest), so that it never holds its documents. Read the result with
    ``read_raw(..., multi_line=False)``. With ``compressed`` the lines are gzip files of at most
    ``COMPRESSED_FILE_ROWS`` documents each: a payload repeats its field names and its target,
    so that most of what plain files take is saved, and reading stays parallel.
    """
    options = {"compression": "gzip", "maxRecordsPerFile": COMPRESSED_FILE_ROWS} if compressed else {}
    layout = ("account_id", "region", "metric", "date")
    document = F.to_json(F.struct(*payloads.columns))
    landed = payloads.select(
        document.alias("value"),
        F.col("source_account_id").alias("account_id"),
        "region",
        F.col("metric_name").alias("metric"),
        F.date_format(parse_utc(F.col("end_time")), "yyyy-MM-dd").alias("date"),
    ).hint("rebalance", *layout)
    with _unsorted(payloads.sparkSession):
        landed.write.mode("append").options(**options).partitionBy(*layout).text(root)
