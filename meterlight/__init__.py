"""Usage and cost analytics over warehouse usage logs, as Spark DataFrames."""

from meterlight.operators.governance import ADMINISTRATOR
from meterlight.session import remove_copies
from meterlight.sources.logs import StoredLogs
from meterlight.sources.sample import SampleLogs
from meterlight.views import UsageViews

__all__ = ["ADMINISTRATOR", "SampleLogs", "StoredLogs", "UsageViews", "remove_copies"]
