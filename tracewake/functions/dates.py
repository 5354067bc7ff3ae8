"""Column expressions on times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an ISO 8601 time with an explicit offset.
_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def normalise_timestamp(value: Column) -> Column:
    """A time with an offset as UTC with milliseconds, whatever the session's zone; null stays null, anything else is an error."""
    moment = F.to_utc_timestamp(F.try_to_timestamp(F.when(value.rlike(_WITH_OFFSET), value)), F.current_timezone())
    text = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(value.isNull() | text.isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit("not a time with an offset: "), value)).cast("string"))
