"""Schemas, fixed column orders and the time bound that everything model-facing must state."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The log's column orders and vocabularies.
AUTH_COLS = ["time", "src_user", "dst_user", "src_computer", "dst_computer", "auth_type", "logon_type", "auth_orientation", "success"]
REDTEAM_COLS = ["time", "user", "src_computer", "dst_computer"]
LABEL_COLS = ["row_id", "is_malicious", "campaign_id", "hop_index"]
EVENT_KEY = ["time", "src_user", "src_computer", "dst_computer"]
AUTH_TYPES = ["unknown", "Kerberos", "NTLM", "Negotiate", "other"]
LOGON_TYPES = ["Network", "unknown", "Service", "Unlock", "Interactive", "Batch", "NewCredentials", "other"]
MALICIOUS = {"auth_type": "NTLM", "logon_type": "Network", "auth_orientation": "LogOn", "success": "Success"}
HOUR, DAY = 3600, 86400
#: Second 0 of the adapter from events.
EPOCH = datetime(2024, 1, 1)

AUTH_SCHEMA = T.StructType([T.StructField("time", T.LongType()), *[T.StructField(c, T.StringType()) for c in AUTH_COLS[1:]]])
REDTEAM_SCHEMA = T.StructType([T.StructField("time", T.LongType()), *[T.StructField(c, T.StringType()) for c in REDTEAM_COLS[1:]]])


def between(df: DataFrame, low: int | None, high: int | None) -> Column:
    """low <= time <= high. Where df has them, bounds on `day` prune folders and bounds on `ts` reach the scan's row groups: both follow from those on time, which is computed from ts."""
    out = F.lit(True)
    for bound, sign in ((low, -1), (high, 1)):
        if bound is None:
            continue
        out = out & (F.col("time") <= bound if sign > 0 else F.col("time") >= bound)
        if "day" in df.columns:
            out = out & (F.col("day") <= bound // DAY if sign > 0 else F.col("day") >= bound // DAY)
        if "ts" in df.columns:
            edge = F.lit(EPOCH + timedelta(seconds=bound + sign)).cast(df.schema["ts"].dataType)
            out = out & (F.col("ts") < edge if sign > 0 else F.col("ts") > edge)
    return out


@dataclass(frozen=True)
class FitWindow:
    """Rows with time <= t_hi. A required argument wherever a model or the generator consumes the result."""

    t_hi: int

    def condition(self, df: DataFrame) -> Column:
        return between(df, None, self.t_hi)


class _Unbounded:
    """States on purpose that there is no bound."""

    def condition(self, df: DataFrame) -> Column:
        return F.lit(True)

    def __repr__(self) -> str:
        return "UNBOUNDED"


UNBOUNDED = _Unbounded()
Window_ = FitWindow | _Unbounded


def bounded(df: DataFrame, window: FitWindow | _Unbounded) -> DataFrame:
    if not isinstance(window, (FitWindow, _Unbounded)):
        raise TypeError("state a FitWindow, or UNBOUNDED on purpose")
    return df if window is UNBOUNDED else df.where(window.condition(df))
