"""Dates, datetimes and durations: ISO 8601 texts and a struct of ten components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.errors import CypherSemanticError
from trellis.functions.typed import DURATION_FIELDS, LONG, STRING, Typed, make

DATETIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
#: Fields that can be read from a temporal text or column.
FIELDS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "week": F.weekofyear, "dayOfWeek": lambda c: F.weekday(c) + 1, "dayOfYear": F.dayofyear, "quarter": F.quarter,
    "millisecond": lambda c: F.floor(F.unix_micros(c) % 1_000_000 / 1000), "microsecond": lambda c: F.unix_micros(c) % 1_000_000,
}
DURATION_TYPE = T.StructType([T.StructField(f, T.LongType()) for f in DURATION_FIELDS])


def moment(value: Column) -> Column:
    """The timestamp of an ISO text (null if it is none); offsets are applied, in UTC."""
    return F.to_utc_timestamp(value.try_cast("timestamp"), "UTC")


def is_date(value: Column) -> Column:
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$")


def field(value: Typed, name: str) -> Typed:
    """A field of a temporal value; null for texts that are no moments."""
    pick = FIELDS[name]
    if value.kind == "string":
        clock = lambda c: F.when(c.rlike(r"^\d{2}:\d{2}"), F.concat(F.lit("1970-01-01T"), c)).otherwise(c)
        return make(lambda c: pick(moment(clock(c))).cast("long"), value, dtype=LONG)
    return make(lambda c: pick(c.cast("timestamp")).cast("long"), value, dtype=LONG)


def date(value: Typed | None) -> Typed:
    if value is None:
        return Typed(F.date_format(F.current_date(), "yyyy-MM-dd"), STRING)
    if value.kind == "map":
        part = lambda c, k, d: c[k] if k in value.type.fieldNames() else F.lit(d)
        return make(lambda c: F.date_format(F.make_date(part(c, "year", 1970), part(c, "month", 1), part(c, "day", 1)), "yyyy-MM-dd"), value, dtype=STRING)
    return make(lambda c: F.date_format(c.cast("string").substr(1, 10).try_cast("date"), "yyyy-MM-dd"), value, dtype=STRING)


def datetime(value: Typed | None) -> Typed:
    if value is None:
        return Typed(F.date_format(F.current_timestamp(), DATETIME), STRING)
    if value.kind == "map":
        part = lambda c, k, d: c[k] if k in value.type.fieldNames() else F.lit(d)
        keys = (("year", 1970), ("month", 1), ("day", 1), ("hour", 0), ("minute", 0), ("second", 0))
        return make(lambda c: F.date_format(F.make_timestamp(*[part(c, k, d) for k, d in keys]), DATETIME), value, dtype=STRING)
    return make(lambda c: F.date_format(moment(c.cast("string")), DATETIME), value, dtype=STRING)


def duration(value: Typed) -> Typed:
    if value.kind == "map":
        known = value.type.fieldNames() if isinstance(value.type, T.StructType) else None
        if known is not None and set(known) - set(DURATION_FIELDS):
            raise CypherSemanticError(f"a duration has no {sorted(set(known) - set(DURATION_FIELDS))}")
        get = lambda c, f: c[f] if known is None or f in known else F.lit(0)
        return make(lambda c: F.struct(*[F.coalesce(get(c, f).cast("long"), F.lit(0)).cast("long").alias(f) for f in DURATION_FIELDS]), value, dtype=DURATION_TYPE)
    shape = r"^(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?)?$"

    def parse(c: Column) -> Column:
        sign = F.when(F.regexp_extract(c, shape, 1) == "-", -1).otherwise(1)
        number = lambda k: F.coalesce(F.regexp_extract(c, shape, k).try_cast("long"), F.lit(0))
        nanos = F.coalesce(F.rpad(F.regexp_extract(c, shape, 9), 9, "0").try_cast("long"), F.lit(0))
        parts = [*(number(k) for k in range(2, 9)), F.floor(nanos / 1_000_000), F.floor(nanos / 1000) % 1000, nanos % 1000]
        whole = F.struct(*[(sign * p).cast("long").alias(f) for p, f in zip(parts, DURATION_FIELDS, strict=True)])
        return F.when(c.rlike(shape), whole)

    return make(parse, value, dtype=DURATION_TYPE)


def _months(d: Column) -> Column:
    return d["years"] * 12 + d["months"]


def _micros(d: Column) -> Column:
    seconds = ((d["weeks"] * 7 + d["days"]) * 24 + d["hours"]) * 3600 + d["minutes"] * 60 + d["seconds"]
    return seconds * 1_000_000 + d["milliseconds"] * 1000 + d["microseconds"] + F.floor(d["nanoseconds"] / 1000)


def shift(value: Typed, by: Typed, sign: int) -> Typed:
    """A date or datetime moved by a duration: months first, clamped to the month's end, then the rest."""

    def move(v: Column, d: Column) -> Column:
        text = v.cast("string")
        at = moment(text)
        day = F.add_months(at.cast("date"), (sign * _months(d)).cast("int"))
        clock = F.unix_micros(at) - F.unix_micros(at.cast("date").cast("timestamp"))
        out = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + clock + sign * _micros(d))
        whole_days = is_date(text) & (_micros(d) % 86_400_000_000 == 0)
        return F.when(whole_days, F.date_format(out, "yyyy-MM-dd")).otherwise(F.date_format(out, DATETIME))

    return make(move, value, by, dtype=STRING)


def combine(a: Typed, b: Typed, sign: int) -> Typed:
    return make(lambda x, y: F.struct(*[(x[f] + sign * y[f]).alias(f) for f in DURATION_FIELDS]), a, b, dtype=DURATION_TYPE)


def between(a: Typed, b: Typed) -> Typed:
    """a - b as days, seconds and microseconds."""

    def diff(x: Column, y: Column) -> Column:
        micros = F.unix_micros(moment(x.cast("string"))) - F.unix_micros(moment(y.cast("string")))
        days = (micros / 86_400_000_000).cast("long")
        rest = micros - days * 86_400_000_000
        seconds = (rest / 1_000_000).cast("long")
        parts = {"days": days, "seconds": seconds, "microseconds": rest - seconds * 1_000_000}
        return F.when(micros.isNotNull(), F.struct(*[parts.get(f, F.lit(0)).cast("long").alias(f) for f in DURATION_FIELDS]))

    return make(diff, a, b, dtype=DURATION_TYPE)


def truncate(unit: Typed, value: Typed, whole_day: bool) -> Typed:
    if unit.constant is None:
        raise CypherSemanticError("the unit to truncate to must be a literal")
    name = str(unit.constant[0]).lower()
    units = ("millennium", "century", "decade", "year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond")
    if name not in units or whole_day and name in units[8:]:
        raise CypherSemanticError(f"can't truncate to {name!r}")
    span = {"millennium": 1000, "century": 100, "decade": 10}.get(name)

    def cut(c: Column) -> Column:
        at = moment(c.cast("string"))
        if span:
            at = F.make_timestamp(F.floor(F.year(at) / span) * span, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        else:
            at = F.date_trunc(name, at)
        return F.date_format(at, "yyyy-MM-dd" if whole_day else DATETIME)

    return make(cut, value, dtype=STRING)
