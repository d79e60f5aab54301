"""Published-date parsing: epoch milliseconds or ISO-8601 text -> UTC date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that counts as "no date" (falsy in the source data), and
# the largest epoch-milliseconds magnitude a JavaScript Date accepts (beyond
# it the date is invalid, i.e. missing).
MISSING_DATE_TEXT = ["", "0"]
MAX_EPOCH_MS = 8_640_000_000_000_000


def parse_published_date(c) -> Column:
    """Epoch milliseconds (all digits) or ISO text -> date in the session zone.

    The session zone must be UTC (see ``feedlake.session``). Missing, ``''``,
    ``'0'``, unparseable text and epochs outside the representable range give
    NULL; one malformed value never fails the job.
    """
    raw = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    present = raw.isNotNull() & ~raw.isin(*MISSING_DATE_TEXT)
    is_epoch = raw.rlike(r"^-?\d+$")
    ms = raw.try_cast("bigint")
    from_epoch = F.when(ms.between(-MAX_EPOCH_MS, MAX_EPOCH_MS), F.to_date(F.timestamp_millis(ms)))
    # a time alone would be read as today's: a date starts with its year
    from_text = F.when(raw.rlike(r"^\d{4}-"), F.to_date(F.try_to_timestamp(raw)))
    return F.when(present, F.when(is_epoch, from_epoch).otherwise(from_text))
