"""Normalisation of texts before detection, in a fixed order of steps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import fixed
from veilspark.functions.core import col, strip


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column | str) -> Column:
    """Canonical composition. No built-in does it; only texts beyond ASCII are sent to Python."""
    t = col(text)
    return F.coalesce(_composed(F.when(t.rlike("[^\\x00-\\x7F]"), t)), t)


def decoded(content: Column | str) -> Column:
    """Bytes as text, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(col(content).cast("string"))


def clean(text: Column | str, compose: bool = True) -> Column:
    t = nfc(text) if compose else col(text)
    for pattern, to in fixed.BEFORE_STRIP:
        t = F.regexp_replace(t, pattern, to)
    t = strip(t)
    for pattern, to in fixed.AFTER_STRIP:
        t = F.regexp_replace(t, pattern, to)
    return t
