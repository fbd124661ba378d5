"""Writing results to files and reading them back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv")
CLIENT_ROWS = 100_000


def _options(file_format: str, null_text: str, line_ends: bool = True) -> dict[str, str]:
    """For CSV: quotes doubled, blanks and line ends kept, microseconds written."""
    if file_format not in FORMATS:
        raise ValueError(f"cannot export as {file_format!r}")
    if file_format == "parquet":
        return {}
    return {
        "header": "true",
        "escape": '"',
        "multiLine": str(line_ends).lower(),
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
        "nullValue": null_text,
    }


_MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "file string, bytes bigint, rows bigint, checksum string"


def export_result(
    df: DataFrame,
    path: str,
    file_format: str = "parquet",
    null_text: str = "",
    manifest: bool = False,
) -> None:
    """Write a result below a new path, in as many files as it has partitions.

    CSV writes NULL as ``null_text``. With the empty default, NULL and empty text read back alike.
    With ``manifest``, the files are read once more and their names, sizes, rows and checksums are
    written beside them, last of all: an export with a manifest is complete.
    """
    options = _options(file_format, null_text)
    df.write.mode("error").format(file_format).options(**options).save(path)
    if manifest:
        spark = df.sparkSession
        found = _files(read_export(spark, path, df.schema, file_format, null_text))
        # One row per file.
        found.coalesce(1).write.mode("error").json(f"{path.rstrip('/')}/{_MANIFEST}")


def _files(df: DataFrame) -> DataFrame:
    """Name, size, rows and checksum of each file a frame reads; files without rows do not show.

    The checksum is the exact sum of the rows' hashes: it does not depend on how a file is split,
    and combines on the map side.
    """
    hashed = F.xxhash64(*df.columns) if df.columns else F.lit(0)
    rows = df.select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
        hashed.cast("decimal(38,0)").alias("hashed"),
    )
    return rows.groupBy("file", "bytes").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("hashed").cast("string").alias("checksum")
    )


def check_export(read: DataFrame, path: str) -> None:
    """Hold what ``read`` finds in its files against the manifest; ``ValueError`` if they differ.

    Reads every row once. What comes to the driver is ten of the files that are missing, changed or
    new at most.
    """
    spark = read.sparkSession
    try:
        listed = spark.read.schema(_MANIFEST_SCHEMA).json(f"{path.rstrip('/')}/{_MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"the export at {path} has no manifest: it is not complete") from error
    names = ["file", "bytes", "rows", "checksum"]
    found = _files(read).select(*names)
    wrong = listed.select(*names).exceptAll(found).union(found.exceptAll(listed.select(*names)))
    files = sorted({row["file"] for row in wrong.select("file").limit(10).collect()})
    if files:
        raise ValueError(f"the export at {path} differs from its manifest: {', '.join(files)}")


def read_export(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    null_text: str = "",
    line_ends: bool = True,
    verify: bool = False,
) -> DataFrame:
    """A written result, with the schema it had.

    Where no text of a CSV holds a line end, ``line_ends=False`` lets Spark split large files.
    ``verify`` holds the files against the manifest first, which reads them once more.
    """
    options = _options(file_format, null_text, line_ends)
    read = spark.read.format(file_format).schema(schema).options(**options).load(path)
    if verify:
        check_export(read, path)
    return read


def to_client(df: DataFrame, at_most: int = CLIENT_ROWS):
    """A pandas frame, for aggregated results: every row comes to the driver.

    A result of more than ``at_most`` rows raises ``ValueError`` and is never cut; listings go to
    ``export_result``.
    """
    rows = df.limit(at_most + 1).toPandas()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} rows; write them with export_result")
    return rows
