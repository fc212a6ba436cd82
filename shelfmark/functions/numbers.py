"""Numbers out of text that may hold none.

A ``try_cast`` that fails raises and catches an error inside the row, which costs
as much as parsing the whole record.  Text that cannot be a number is told apart
first; what remains (a number too large) is rare.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a cast to a whole number takes: blanks and control characters around it are dropped.
_WHOLE = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"
#: A distance as records write it: digits and points only.
_RECORDED = r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"


def whole_number(text: Column) -> Column:
    """``text`` as an int, NULL when it is none or too large."""
    return F.when(text.rlike(_WHOLE), text.try_cast("int"))


def recorded_number(text: Column) -> Column:
    """A recorded distance (``[0-9.]*``) as a double, NULL when it is malformed or empty."""
    return F.when(text.rlike(_RECORDED), text.try_cast("double"))
