"""Links to the profile page of a query."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from meterlight.fixed_values import LINK_BASE, LINK_END, LINK_MIDDLE


# The SQL session variables that links follow where the views are told so.
ORG_VARIABLE = "usage_organization"
ACCOUNT_VARIABLE = "usage_account"


def session_variable(name: str) -> Column:
    """A SQL session variable, as it is when a result is built."""
    return F.expr(f"session.{name}")


def declare_account(spark: SparkSession, org: str | None = None, account: str | None = None) -> None:
    """Declare the session variables, as ``DECLARE VARIABLE`` and ``SET VARIABLE`` in SQL do."""
    for name, value in ((ORG_VARIABLE, org), (ACCOUNT_VARIABLE, account)):
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} STRING DEFAULT NULL")
        spark.sql(f"SET VARIABLE {name} = :value", args={"value": value})


def profile_url(
    query_id: Column | str,
    org: Column | str | None = None,
    account: Column | str | None = None,
    base: str = LINK_BASE,
    prefix: Column | str | None = None,
) -> Column:
    """The link of a query; NULL when any part is NULL.

    ``org`` and ``account`` may be columns or plain text, ``query_id`` a column or its name. Where
    links are built from a connection name or an account locator, ``prefix`` is all that stands
    before the part they share, and ``base``, ``org`` and ``account`` are not used.
    """
    identifier = F.col(query_id) if isinstance(query_id, str) else query_id
    account_page = [F.lit(base), F.lit(org), F.lit("/"), F.lit(account)]
    return F.concat(
        *(account_page if prefix is None else [F.lit(prefix)]),
        F.lit(LINK_MIDDLE),
        identifier,
        F.lit(LINK_END),
    )
