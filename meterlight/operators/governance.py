"""Governed views: the rows and columns a caller gets to see.

A DataFrame filter shapes results; it does not stop a caller who can read the files underneath.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.fixed_values import LINK_BASE
from meterlight.functions.links import profile_url

Caller = str | Column | None

# The caller who sees every row; views have to be asked for by this name.
ADMINISTRATOR = None


def row_access(df: DataFrame, user_col: str, user: Caller) -> DataFrame:
    """Rows whose user column equals the caller; a NULL user matches nobody.

    ``None`` is the administrator, who sees every row. ``F.current_user()`` is the session's user.
    """
    if user is None:
        return df
    return df.where(F.col(user_col) == (F.lit(user) if isinstance(user, str) else user))


def attribution_view(df: DataFrame, user: Caller = None) -> DataFrame:
    return row_access(df, "user_name", user)


def analyst_view(df: DataFrame, user: Caller = None) -> DataFrame:
    return row_access(df, "username", user)


def query_history_view(
    df: DataFrame,
    org: str,
    account: str,
    user: Caller = None,
    base: str = LINK_BASE,
    prefix: str | None = None,
) -> DataFrame:
    """The query log, all columns, with a link to each query's profile."""
    visible = row_access(df, "user_name", user)
    return visible.withColumn("query_id_url", profile_url("query_id", org, account, base, prefix))


def ai_query_view(query_view: DataFrame, ai_functions: DataFrame) -> DataFrame:
    """AI function calls with the query that made them.

    The AI log knows no user: the join to the governed query view is what limits the rows. It stands
    on the left, the side a sort-merge join streams, since one query may make very many calls.
    A further column of the AI log that the query view has too is called ``ai_`` and its name.
    """
    calls = ai_functions.drop("warehouse_id")
    taken = {column.lower() for column in [*query_view.columns, *calls.columns]}
    for column in calls.columns:
        if column != "query_id" and column in query_view.columns:
            name = f"ai_{column}"
            while name.lower() in taken:
                name = f"ai_{name}"
            taken.add(name.lower())
            calls = calls.withColumnRenamed(column, name)
    details = [column for column in calls.columns if column != "query_id"]
    return calls.join(query_view, "query_id", "inner").select(*query_view.columns, *details)
