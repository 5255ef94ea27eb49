"""The receipt-like messages of a mail table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import receipt_subject
from ..operators.views import rank_latest
from ..params import DEFAULTS, Params


def receipt_messages(messages: DataFrame, as_of: dt.date, params: Params = DEFAULTS) -> DataFrame:
    """Messages whose subject reads like a receipt, newest first, a few per account."""
    since = F.lit(as_of - dt.timedelta(days=params.message_window_days))
    recent = messages.filter((F.col("sent_on") >= since) & receipt_subject("subject"))
    newest = [F.col("sent_on").desc(), F.col("message_key").desc()]
    return rank_latest(recent, ["user_id"], newest, params.message_limit)
