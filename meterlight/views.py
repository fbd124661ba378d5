"""The governed views over one set of usage logs, for one caller and one date range."""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.fixed_values import LINK_BASE
from meterlight.functions.dates import (
    MIDNIGHT,
    WHOLE_DAY,
    check_end_rule,
    check_range,
    in_date_range,
    in_ts_range,
)
from meterlight.functions.links import ACCOUNT_VARIABLE, ORG_VARIABLE, session_variable
from meterlight.operators import governance
from meterlight.operators.governance import ADMINISTRATOR, Caller
from meterlight.operators.per_query import credits_per_query
from meterlight.sources.logs import DAY_COLUMN, StoredLogs, last_day_before, with_ids
from meterlight.sources.sample import SampleLogs

Day = date | str | None


class _SessionUser:
    """Stands for the user of the Spark session, the caller unless another one is named."""

    def __repr__(self) -> str:
        return "the session's user"


SESSION_USER = _SessionUser()


class UsageViews:
    """Frames are built when first asked for; nothing runs until a result is used.

    They show the rows of the session's user, ``F.current_user()``, unless another caller is named;
    ``user=ADMINISTRATOR`` shows all rows. ``prefix`` replaces the account's part of links. With
    ``account_of_session`` organisation and account of links are those of the SQL session variables
    ``usage_organization`` and ``usage_account``, which must be declared (``declare_account``).
    """

    def __init__(
        self,
        logs: StoredLogs | SampleLogs,
        org: str | Column = "ORG",
        account: str | Column = "ACC",
        user: Caller | _SessionUser = SESSION_USER,
        base: str = LINK_BASE,
        prefix: str | None = None,
        account_of_session: bool = False,
    ):
        self._logs = logs
        if account_of_session:
            org, account = session_variable(ORG_VARIABLE), session_variable(ACCOUNT_VARIABLE)
        self._link = (org, account, base, prefix)
        self._user = F.current_user() if user is SESSION_USER else user
        self._range: tuple[date, date] | None = None
        self._end_rule = MIDNIGHT

    def _copy(self, user: Caller) -> UsageViews:
        org, account, base, prefix = self._link
        scope = UsageViews(self._logs, org, account, user, base, prefix)
        scope._range, scope._end_rule = self._range, self._end_rule
        return scope

    def scoped(
        self,
        start: Day = None,
        end: Day = None,
        user: Caller = None,
        end_rule: str | None = None,
    ) -> UsageViews:
        """The same views for a date range and a caller; what is not given stays as it is.

        Views that belong to a caller cannot be turned into those of another one.
        """
        scope = self._copy(self._caller(user))
        if end_rule is not None:
            scope._end_rule = check_end_rule(end_rule)
        if start is not None or end is not None:
            scope._range = check_range(start, end)
        return scope

    @property
    def range(self) -> tuple[date, date] | None:
        """First and last date, or ``None`` for all dates."""
        return self._range

    @property
    def end_rule(self) -> str:
        """How the last date of a range ends."""
        return self._end_rule

    def all_dates(self) -> UsageViews:
        """The same views without a range."""
        scope = self._copy(self._user)
        scope._range = None
        return scope

    def with_days_before(self, days: int) -> UsageViews:
        """The same views from some days before the range to the end of its last day."""
        scope = self._copy(self._user)
        if self._range is not None:
            first, last = self._range
            scope._range, scope._end_rule = (first - timedelta(days=days), last), WHOLE_DAY
        return scope

    def _caller(self, user: Caller) -> Caller:
        if user is None or self._user is None:
            return self._user if user is None else user
        if isinstance(user, str) and isinstance(self._user, str) and user == self._user:
            return user
        raise PermissionError("these views belong to another caller")

    def register(self, prefix: str = "") -> list[str]:
        """Temporary views for SQL, named by prefix and log; the names are returned.

        The metering log is registered for the administrator only.
        """
        frames = {
            "query_history": self.queries,
            "query_attribution_history": self.attribution,
            "ai_functions_query_usage_history": self.ai_queries,
            "ai_analyst_usage_history": self.analyst,
        }
        if self._user is ADMINISTRATOR:
            frames["metering_daily_history"] = self.metering
        for name, frame in frames.items():
            frame.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in frames]

    def frames_by_day(self) -> dict[str, DataFrame]:
        """The governed frames for a range that comes later; logs stored by day keep the day's column.

        Metering is among them for the administrator, if there is any.
        """
        if self._range is not None:
            raise ValueError("these views have a range already")
        frames = {
            "queries": governance.row_access(self._logs.query_history, "user_name", self._user),
            "attribution": governance.attribution_view(self._logs.attribution, self._user),
        }
        if self._user is ADMINISTRATOR and self._logs.has("metering"):
            frames["metering"] = self.metering
        return frames

    def _between(self, df: DataFrame, column: str, log: str) -> DataFrame:
        by_day = log in getattr(self._logs, "by_day", ())
        if self._range is not None:
            if by_day:
                df = in_date_range(df, DAY_COLUMN, *self._range)
            df = in_ts_range(df, column, *self._range, end_rule=self._end_rule)
        return df.drop(DAY_COLUMN) if by_day else df

    def _administrator_only(self, log: str) -> None:
        if self._user is not ADMINISTRATOR:
            raise PermissionError(f"the {log} log has no user column; ask for it without a user")

    @cached_property
    def queries(self) -> DataFrame:
        """query_history with profile links."""
        org, account, base, prefix = self._link
        view = governance.query_history_view(
            self._logs.query_history, org, account, self._user, base, prefix
        )
        return self._between(view, "start_time", "query_history")

    @cached_property
    def attribution(self) -> DataFrame:
        view = governance.attribution_view(self._logs.attribution, self._user)
        return self._between(view, "start_time", "attribution")

    @cached_property
    def attribution_credits(self) -> DataFrame:
        """Attribution to join to queries that the range already limits.

        It covers all dates, unless the logs say that attribution starts with its query.
        """
        if self._range is not None and self._logs.attribution_starts_with_query:
            return self.attribution
        if self._user is ADMINISTRATOR:
            return self._logs.attribution_credits
        return governance.attribution_view(self._logs.attribution, self._user)

    @cached_property
    def query_credits(self) -> DataFrame:
        """Credits per query, whatever dates its attribution has."""
        return self.credits_of(self.queries if self._range is not None else None)

    def credits_of(self, queries: DataFrame | None) -> DataFrame:
        """Credits per query, for the given queries only.

        Rows of other queries go before the sum: a filter on the ids can then reach the scan, and
        only matching rows are shuffled. With ``None`` all are summed, without a join.
        """
        rows = self.attribution_credits
        if queries is not None:
            rows = self._of_queries(rows, queries)
        return credits_per_query(rows)

    def _of_queries(self, rows: DataFrame, queries: DataFrame) -> DataFrame:
        if getattr(self._logs, "find_by_id", False):
            return with_ids(rows, queries)
        return rows.join(queries.select("query_id"), "query_id", "left_semi")

    @cached_property
    def attributed_in_range(self) -> DataFrame:
        """Credits per query from the attribution within the range."""
        return credits_per_query(
            self.attribution_credits if self._range is None else self.attribution
        )

    @cached_property
    def ai_queries(self) -> DataFrame:
        return governance.ai_query_view(self.queries, self._logs.ai_functions)

    def ai_calls(self, *by: str) -> DataFrame:
        """AI calls, tokens and credits per query and the given columns.

        Summed before they meet the query log, so that a query with very many calls joins as a few
        rows. Where a range or a caller limits the queries, calls of others go before the sum: the
        filter on the ids can then reach the scan, and only matching rows are shuffled.
        """
        rows = self._logs.ai_functions
        if self._range is not None or self._user is not ADMINISTRATOR:
            rows = self._of_queries(rows, self.queries)
        return rows.groupBy("query_id", *by).agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum(F.col("tokens").cast("decimal(20,0)")).cast("decimal(25,0)").alias("tokens"),
            F.sum("token_credits").cast("decimal(25,9)").alias("token_credits"),
        )

    @cached_property
    def ai_log(self) -> DataFrame:
        """The AI log alone; a caller or a range can only be told through the query view."""
        if self._user is ADMINISTRATOR and self._range is None:
            return self._logs.ai_functions
        return self.ai_queries

    @cached_property
    def analyst(self) -> DataFrame:
        view = governance.analyst_view(self._logs.ai_analyst, self._user)
        return self._between(view, "start_time", "ai_analyst")

    @cached_property
    def metering(self) -> DataFrame:
        """Daily metering, which belongs to the account and not to a user."""
        self._administrator_only("metering")
        if self._range is None:
            return self._logs.metering
        return in_date_range(self._logs.metering, "usage_date", *self._range)

    def metering_before(self, day: date) -> DataFrame:
        """The rows of the last day with metering before ``day``.

        Of a log stored by day the names of its folders tell which day that is, so that only its
        folder is read; otherwise the dates of all earlier rows are.
        """
        self._administrator_only("metering")
        log = self._logs.metering
        if "metering" in getattr(self._logs, "by_day", ()):
            last = last_day_before(log, "usage_date", day)
            return log.where(F.col("usage_date") == F.lit(last) if last else F.lit(False))
        earlier = log.where(F.col("usage_date") < F.lit(day)).agg(F.max("usage_date"))
        return log.where(F.col("usage_date") == earlier.scalar())

    @cached_property
    def storage(self) -> DataFrame:
        self._administrator_only("storage")
        if self._range is None:
            return self._logs.storage_snapshots
        return in_date_range(self._logs.storage_snapshots, "snapshot_date", *self._range)
