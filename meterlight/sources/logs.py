"""Usage logs kept as parquet folders or catalog tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight import schemas

# The day of a log's start_time, by which stored logs may be partitioned.
DAY_COLUMN = "start_date"
USER_COLUMNS = ("user_name", "username")


# What the files' Bloom filters are kept on, for logs that are looked up by it.
ID_COLUMN = "query_id"
# A filter may list so many ids; a longer list would find a match in nearly every file.
LISTED_IDS = 1000
_IDS_IN_A_LIST = 10


def with_day(df: DataFrame) -> tuple[DataFrame, str | None]:
    """The log with the day it is stored by, and that column's name; ``None`` if it has no day."""
    if "start_time" in df.columns:
        if DAY_COLUMN in df.columns:
            raise ValueError(f"the log has a column {DAY_COLUMN} of its own")
        df = df.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
        return df.withColumn(DAY_COLUMN, F.col("start_time").cast("date")), DAY_COLUMN
    return df, "usage_date" if "usage_date" in df.columns else None


def write_days(df: DataFrame, path: str, day: str, mode: str = "error", only_these: bool = False) -> None:
    """Write rows in folders by ``day``; with ``only_these`` other days' folders stay as they are."""
    users = [column for column in USER_COLUMNS if column in df.columns]
    by_day = df.hint("rebalance", day).sortWithinPartitions(day, *users)
    writer = by_day.write.mode("overwrite" if only_these else mode).partitionBy(day)
    if only_these:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.options(**_bloom_options(df)).parquet(path)


def _bloom_options(df: DataFrame) -> dict[str, str]:
    if ID_COLUMN not in df.columns:
        return {}
    return {
        f"parquet.bloom.filter.enabled#{ID_COLUMN}": "true",
        "parquet.bloom.filter.adaptive.enabled": "true",
    }


def store_log(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a log as parquet, one folder per day, so that date ranges read their days only.

    ``start_time`` is stored without a zone, as the log's schema declares it, and its day follows
    from that value: a reader in another zone sees the same rows by day and not by day. Rows move to the tasks of their day; AQE splits the days that are too large for one task and
    merges the small ones. Within a file rows are ordered by user, so that the row filter skips row
    groups, and Bloom filters on the query id skip those that hold none of the ids asked for. A log
    without ``start_time`` or ``usage_date`` is written in one folder.
    """
    dated, day = with_day(df)
    if day is None:
        df.write.mode(mode).options(**_bloom_options(df)).parquet(path)
    else:
        write_days(dated, path, day, mode)


def last_day_before(stored: DataFrame, column: str, day: date) -> date | None:
    """The last day before ``day`` that has a folder, told by the names of the files Spark has listed."""
    last = None
    for file in stored.inputFiles():
        name = file.rpartition(f"/{column}=")[2].partition("/")[0]
        # NULL has a folder of another form.
        if name[:4].isdigit():
            found = date.fromisoformat(name)
            if found < day and (last is None or found > last):
                last = found
    return last


def with_ids(df: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of ``df`` whose query is among ``queries``, found by the files' Bloom filters.

    Runs a job that brings at most ``LISTED_IDS`` and one ids to the driver. If there are no more,
    they become literals, in lists short enough to reach the parquet reader. Otherwise a semi-join
    does the same.
    """
    ids = queries.select(ID_COLUMN).where(F.col(ID_COLUMN).isNotNull()).distinct()
    found = [row[0] for row in ids.limit(LISTED_IDS + 1).collect()]
    if len(found) > LISTED_IDS:
        return df.join(queries.select(ID_COLUMN), ID_COLUMN, "left_semi")
    wanted = F.lit(False)
    for at in range(0, len(found), _IDS_IN_A_LIST):
        wanted = wanted | F.col(ID_COLUMN).isin(found[at : at + _IDS_IN_A_LIST])
    return df.where(wanted)


class StoredLogs:
    """The usage logs at the given places, read lazily.

    ``places`` maps a log name to a path (anything with a ``/``) or a table name. ``by_day`` names
    the logs that ``store_log`` wrote, or is ``True`` for all: ranges then read their days only, and
    the day's own column does not show. In other logs no column is taken for the day.

    A range limits queries by their own start, and attribution is read for all dates to join them.
    Where every attribution row is known to carry its query's ``start_time``, say so with
    ``attribution_starts_with_query``: the range then also limits what is read of the attribution.
    With ``find_by_id``, a range or a caller with few queries has their ids looked up first, and of
    the logs that follow a query only row groups that may hold one of them are read. Results are the
    same; building one then runs the lookup.
    """

    def __init__(
        self,
        spark: SparkSession,
        places: Mapping[str, str],
        attribution_starts_with_query: bool = False,
        by_day: bool | Collection[str] = False,
        find_by_id: bool = False,
    ):
        self._spark = spark
        self._places = dict(places)
        if isinstance(by_day, bool):
            by_day = self._places if by_day else ()
        self.by_day = frozenset(by_day)
        self.attribution_starts_with_query = attribution_starts_with_query
        self.find_by_id = find_by_id

    def has(self, name: str) -> bool:
        """Whether a place for this log is known."""
        return name in self._places

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        place = self._places[name]
        frame = self._spark.read.parquet(place) if "/" in place else self._spark.read.table(place)
        return schemas.conform(frame, schema, name)

    @cached_property
    def query_history(self) -> DataFrame:
        return self._read("query_history", schemas.QUERY_HISTORY)

    @cached_property
    def attribution(self) -> DataFrame:
        return self._read("attribution", schemas.ATTRIBUTION)

    @property
    def attribution_credits(self) -> DataFrame:
        return self.attribution.select("query_id", "credits_attributed_compute")

    @cached_property
    def metering(self) -> DataFrame:
        return self._read("metering", schemas.METERING)

    @cached_property
    def ai_functions(self) -> DataFrame:
        return self._read("ai_functions", schemas.AI_FUNCTIONS)

    @cached_property
    def ai_analyst(self) -> DataFrame:
        return self._read("ai_analyst", schemas.AI_ANALYST)

    @cached_property
    def storage_snapshots(self) -> DataFrame:
        return self._read("storage_snapshots", schemas.STORAGE_SNAPSHOTS)
