"""Columns with static types.

A lambda's variable has no type that Spark could be asked for outside the lambda, so
each value carries a second column, ``probe``, in which such variables are typed nulls;
outside of lambdas both are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, STRING, BOOLEAN, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
NUMBERS = ("integer", "float")


class Typed:
    __slots__ = ("col", "probe", "_type", "_ask", "constant")

    def __init__(self, col: Column, dtype: T.DataType | None = None, probe: Column | None = None, ask: Callable | None = None, constant=None):
        self.col, self.probe, self._type, self._ask = col, col if probe is None else probe, dtype, ask
        #: The Python value of a literal, in a tuple; None otherwise.
        self.constant = constant

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self._ask(self.probe)
        return self._type

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "integer"
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "float"
        for kind, types in (("string", (T.StringType, T.CharType, T.VarcharType)), ("boolean", T.BooleanType), ("list", T.ArrayType), ("null", T.NullType)):
            if isinstance(t, types):
                return kind
        if isinstance(t, T.StructType):
            return "duration" if t.fieldNames() == list(DURATION_FIELDS) else "map"
        if isinstance(t, T.MapType):
            return "map"
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "temporal"
        return "other"


#: Components of a duration value.
DURATION_FIELDS = ("years", "months", "weeks", "days", "hours", "minutes", "seconds", "milliseconds", "microseconds", "nanoseconds")


def make(fn: Callable[..., Column], *args: Typed, dtype: T.DataType | None = None) -> Typed:
    """Apply ``fn`` to the columns of ``args`` (and to their probes, where these differ)."""
    ask = next((a._ask for a in args if a._ask is not None), None)
    col = fn(*(a.col for a in args))
    probe = col if all(a.col is a.probe for a in args) else fn(*(a.probe for a in args))
    return Typed(col, dtype, probe, ask)


def text(value: Typed) -> Typed:
    """The value as a string."""
    if value.kind == "string":
        return value
    if value.kind in ("map", "list", "duration"):
        return make(F.to_json, value, dtype=STRING)
    return make(lambda c: c.cast("string"), value, dtype=STRING)


def as_double(value: Typed) -> Typed:
    return value if isinstance(value.type, T.DoubleType) else make(lambda c: c.cast("double"), value, dtype=DOUBLE)


def as_long(value: Typed) -> Typed:
    return value if isinstance(value.type, T.LongType) else make(lambda c: c.cast("long"), value, dtype=LONG)


def null_of(dtype: T.DataType | None = None) -> Column:
    return F.lit(None) if dtype is None else F.lit(None).cast(dtype)
