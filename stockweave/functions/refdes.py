"""Reference designators: ranges and lists to sorted single ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.functions import jvm

#: Longest range that is expanded; one of more stays as it is. A row of a million designators takes about 100 MB while it
#: is made, so tasks of an executor may meet some at once; the limit is a parameter.
RANGE_CAP = 1_000_000


def expand(c: Column, cap: int = RANGE_CAP) -> Column:
    """"R3, R1-R2, X?" -> "R1, R2, R3, X?": prefixes in order, then numbers, then what has another form.

    A range with its ends swapped gives nothing, unless nothing else is left: then the text stays. Digits are ASCII.
    """
    return jvm.call("Expand", T.StringType(), c, F.lit(cap))
