"""Scalar functions of the query language as built-in column expressions.

Each entry maps a lower-case name to (least arguments, most arguments, builder); a
builder gets typed columns and returns one.  Nulls propagate unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.errors import CypherSemanticError
from trellis.functions import temporal
from trellis.functions.typed import BOOLEAN, DOUBLE, LONG, STRING, Typed, as_double, as_long, make, text

REGISTRY: dict[str, tuple[int, float, Callable[..., Typed]]] = {}


def register(names: str, least: int, most: float | None = None):
    def add(builder: Callable[..., Typed]):
        for name in names.split():
            REGISTRY[name.lower()] = (least, least if most is None else most, builder)
        return builder

    return add


def lookup(name: str, count: int) -> Callable[..., Typed]:
    if name.lower() not in REGISTRY:
        raise CypherSemanticError(f"there is no function {name!r}")
    least, most, builder = REGISTRY[name.lower()]
    if not least <= count <= most:
        raise CypherSemanticError(f"{name} takes {least} to {most} arguments, not {count}" if least != most else f"{name} takes {least} arguments, not {count}")
    return builder


def _simple(names: str, least: int, most: int, fn: Callable[..., Column], dtype: T.DataType | None, convert: Callable = lambda x: x) -> None:
    register(names, least, most)(lambda *args: make(fn, *map(convert, args), dtype=dtype))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


_SPACE = r"[\s\u001c-\u001f\u0085   -     　]"

# strings
_simple("toUpper upper", 1, 1, F.upper, STRING, text)
_simple("toLower lower", 1, 1, F.lower, STRING, text)
_simple("trim", 1, 1, lambda s: F.regexp_replace(s, rf"^{_SPACE}+|{_SPACE}+$", ""), STRING, text)
_simple("ltrim", 1, 1, lambda s: F.regexp_replace(s, rf"^{_SPACE}+", ""), STRING, text)
_simple("rtrim", 1, 1, lambda s: F.regexp_replace(s, rf"{_SPACE}+$", ""), STRING, text)
_simple("left", 2, 2, lambda s, n: F.left(s, n.cast("int")), STRING)
_simple("right", 2, 2, lambda s, n: F.right(s, n.cast("int")), STRING)
_simple("replace", 3, 3, F.replace, STRING)
_simple("startsWith", 2, 2, F.startswith, BOOLEAN)
_simple("endsWith", 2, 2, F.endswith, BOOLEAN)
_simple("contains", 2, 2, F.contains, BOOLEAN)
_simple("repeat", 2, 2, lambda s, n: F.repeat(s, n.cast("int")), STRING)
_simple("md5", 1, 1, lambda s: F.md5(F.encode(s, "UTF-8")), STRING, text)
_simple("sha1", 1, 1, lambda s: F.sha1(F.encode(s, "UTF-8")), STRING, text)
_simple("sha256", 1, 1, lambda s: F.sha2(F.encode(s, "UTF-8"), 256), STRING, text)
_simple("encodeBase64", 1, 1, lambda s: F.replace(F.base64(F.encode(s, "UTF-8")), F.lit("\r\n"), F.lit("")), STRING, text)
_simple("decodeBase64 decode_serialized", 1, 1, lambda s: F.decode(F.unbase64(s), "UTF-8"), STRING, text)
_simple("charAt", 2, 2, lambda s, i: F.when((i >= 0) & (i < F.length(s)), F.substring(s, (i + 1).cast("int"), F.lit(1))), STRING)
_simple("charCodeAt", 2, 2, lambda s, i: F.when((i >= 0) & (i < F.length(s)), F.ascii(F.substring(s, (i + 1).cast("int"), F.lit(1)))).cast("long"), LONG)


@register("substring", 2, 3)
def _substring(s: Typed, start: Typed, length: Typed | None = None) -> Typed:
    at = lambda c: (c + 1).cast("int")
    if length is None:
        return make(lambda s, a: F.substring(s, at(a), F.length(s)), s, start, dtype=STRING)
    return make(lambda s, a, n: F.substring(s, at(a), n.cast("int")), s, start, length, dtype=STRING)


@register("split", 2)
def _split(s: Typed, by: Typed) -> Typed:
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    return make(lambda s, d: F.when(d == "", F.array(s)).otherwise(F.split(s, quoted(d), -1)), s, by, dtype=T.ArrayType(STRING))


@register("join", 2)
def _join(items: Typed, by: Typed) -> Typed:
    """Null elements are left out."""
    return make(lambda l, d: F.when(l.isNotNull(), F.call_function("concat_ws", d, l.cast("array<string>"))), items, by, dtype=STRING)


@register("reverse", 1)
def _reverse(x: Typed) -> Typed:
    return make(F.reverse, x, dtype=x.type)


@register("length size len", 1)
def _size(x: Typed) -> Typed:
    if x.kind == "list":
        return make(lambda c: F.when(c.isNotNull(), F.size(c)).cast("long"), x, dtype=LONG)
    if x.kind == "map":
        if isinstance(x.type, T.StructType):
            return make(lambda c: F.when(c.isNotNull(), F.lit(len(x.type.fields)).cast("long")), x, dtype=LONG)
        return make(lambda c: F.when(c.isNotNull(), F.size(c)).cast("long"), x, dtype=LONG)
    return make(lambda c: F.length(c).cast("long"), text(x), dtype=LONG)


@register("isEmpty", 1)
def _is_empty(x: Typed) -> Typed:
    return make(lambda c: F.coalesce(c == 0, F.lit(True)), _size(x), dtype=BOOLEAN)


def _pad(fn: Callable):
    def build(s: Typed, width: Typed, fill: Typed | None = None) -> Typed:
        if width.constant is None or fill is not None and fill.constant is None:
            raise CypherSemanticError("the width and the fill of a padding must be literals")
        n, with_ = int(width.constant[0]), " " if fill is None else str(fill.constant[0])
        return make(lambda c: fn(c, n, with_), s, dtype=STRING)

    return build


register("lpad", 2, 3)(_pad(F.lpad))
register("rpad", 2, 3)(_pad(F.rpad))


@register("btrim", 1, 2)
def _btrim(s: Typed, chars: Typed | None = None) -> Typed:
    return REGISTRY["trim"][2](s) if chars is None else make(F.btrim, s, chars, dtype=STRING)


@register("indexOf", 2, 3)
def _index_of(s: Typed, sub: Typed, start: Typed | None = None) -> Typed:
    if start is None:
        return make(lambda s, t: (F.call_function("locate", t, s) - 1).cast("long"), s, sub, dtype=LONG)
    return make(lambda s, t, a: (F.call_function("locate", t, s, (a + 1).cast("int")) - 1).cast("long"), s, sub, start, dtype=LONG)


@register("char", 1)
def _char(x: Typed) -> Typed:
    digits = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    return make(lambda c: F.when((c > 0) & (c < 1_114_112), F.decode(F.unhex(digits(c)), "UTF-32")), x, dtype=STRING)


@register("normalize", 1, 2)
def _normalize(s: Typed, form: Typed | None = None) -> Typed:
    """No built-in expression: an Arrow-batched function."""
    name = "NFC" if form is None else str(form.constant[0])
    if name not in ("NFC", "NFD", "NFKC", "NFKD", "NFKCCaseFold"):
        raise CypherSemanticError(f"there is no normal form {name!r}")

    @F.pandas_udf("string")
    def normalise(values):
        if name == "NFKCCaseFold":
            return values.map(lambda v: unicodedata.normalize("NFKC", v.casefold()), na_action="ignore")
        return values.map(lambda v: unicodedata.normalize(name, v), na_action="ignore")

    return make(lambda c: normalise(c), text(s), dtype=STRING)


@register("byteSize", 1)
def _byte_size(x: Typed) -> Typed:
    return make((lambda c: F.octet_length(c).cast("long")) if x.kind == "string" else (lambda c: F.lit(None).cast("long")), x, dtype=LONG)


# conversion
_TRUE, _FALSE = ("true", "1"), ("false", "0")


def _boolean(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False)


def _integer(x: Typed) -> Callable[[Column], Column]:
    if x.kind == "integer":
        return lambda c: c.cast("long")
    if x.kind == "boolean":
        return lambda c: c.cast("int").cast("long")
    if x.kind == "string":
        # whole numbers stay exact beyond 2^53
        return lambda c: F.coalesce(c.try_cast("long"), c.try_cast("double").try_cast("long"))
    return lambda c: c.try_cast("long")


register("toString str toStringOrNull", 1)(text)
register("toInteger int toIntegerOrNull", 1)(lambda x: make(_integer(x), x, dtype=LONG))
register("toFloat float toFloatOrNull", 1)(lambda x: make(lambda c: c.try_cast("double"), x, dtype=DOUBLE))
register("toBoolean bool toBooleanOrNull", 1)(lambda x: make(_boolean, x, dtype=BOOLEAN))


def _each(fn: Callable[[Column], Column], dtype: T.DataType):
    return lambda x: make(lambda c: F.transform(c, fn), x, dtype=T.ArrayType(dtype))


register("toStringList", 1)(_each(lambda v: v.cast("string"), STRING))
register("toIntegerList", 1)(_each(lambda v: v.cast("string").try_cast("double").try_cast("long"), LONG))
register("toFloatList", 1)(_each(lambda v: v.cast("string").try_cast("double"), DOUBLE))
register("toBooleanList", 1)(_each(_boolean, BOOLEAN))

# types
_NAMES = {"null": "NULL", "boolean": "BOOLEAN", "integer": "INTEGER", "float": "FLOAT", "string": "STRING", "map": "MAP", "duration": "MAP", "temporal": "STRING", "other": "ANY"}


def _type_name(x: Typed) -> str:
    if x.kind == "list":
        return f"LIST<{_type_name(Typed(x.col, x.type.elementType))}>"
    return _NAMES[x.kind]


register("valueType", 1)(lambda x: make(lambda c: F.when(c.isNull(), "NULL").otherwise(_type_name(x)), x, dtype=STRING))
for _name, _kinds in (("isString", ("string",)), ("isInteger", ("integer",)), ("isFloat", ("float",)), ("isBoolean", ("boolean",)), ("isList", ("list",)), ("isMap", ("map", "duration"))):
    register(_name, 1)(lambda x, kinds=_kinds: make(lambda c: F.when(c.isNotNull(), F.lit(x.kind in kinds)), x, dtype=BOOLEAN))


@register("keys", 1)
def _keys(x: Typed) -> Typed:
    if isinstance(x.type, T.StructType):
        return make(lambda c: F.when(c.isNotNull(), F.array(*[F.lit(n) for n in x.type.fieldNames()])), x, dtype=T.ArrayType(STRING))
    return make(F.map_keys, x)


@register("values", 1)
def _values(x: Typed) -> Typed:
    if isinstance(x.type, T.StructType):
        kinds = {f.dataType.simpleString() for f in x.type.fields}
        numbers = all(isinstance(f.dataType, T.NumericType) for f in x.type.fields)
        whole = all(isinstance(f.dataType, T.IntegralType) for f in x.type.fields)
        common = "bigint" if whole else "double" if numbers else "string"
        one = (lambda v: v) if len(kinds) == 1 else (lambda v: v.cast(common))
        return make(lambda c: F.when(c.isNotNull(), F.array(*[one(c[n]) for n in x.type.fieldNames()])), x)
    return make(F.map_values, x)


register("properties", 1)(lambda x: x)

# mathematics
_simple("abs", 1, 1, F.abs, None)
_simple("ceil", 1, 1, lambda c: F.ceil(c).cast("double"), DOUBLE, as_double)
_simple("floor", 1, 1, lambda c: F.floor(c).cast("double"), DOUBLE, as_double)
_simple("sign", 1, 1, F.signum, DOUBLE, as_double)
_simple("sqrt", 1, 1, lambda c: F.when(c >= 0, F.sqrt(c)), DOUBLE, as_double)
_simple("cbrt", 1, 1, F.cbrt, DOUBLE, as_double)
_simple("log ln", 1, 1, F.ln, DOUBLE, as_double)
_simple("log2", 1, 1, F.log2, DOUBLE, as_double)
_simple("log10", 1, 1, F.log10, DOUBLE, as_double)
_simple("exp", 1, 1, F.exp, DOUBLE, as_double)
for _name in ("sin", "cos", "tan", "atan", "sinh", "cosh", "tanh", "degrees", "radians"):
    _simple(_name, 1, 1, getattr(F, _name), DOUBLE, as_double)
for _name in ("asin", "acos"):
    _simple(_name, 1, 1, lambda c, f=getattr(F, _name): _finite(f(c)), DOUBLE, as_double)
_simple("cot", 1, 1, lambda c: F.when(c != 0, F.cos(c) / F.nullif(F.sin(c), F.lit(0.0))), DOUBLE, as_double)
_simple("haversin", 1, 1, lambda c: (1 - F.cos(c)) / 2, DOUBLE, as_double)
_simple("hypot", 2, 2, F.hypot, DOUBLE, as_double)
_simple("atan2", 2, 2, F.atan2, DOUBLE, as_double)
_simple("fmod", 2, 2, lambda a, b: a % F.nullif(b, F.lit(0.0)), DOUBLE, as_double)
_simple("pow power", 2, 2, lambda a, b: _finite(F.pow(a, b)), DOUBLE, as_double)
_simple("bitAnd", 2, 2, lambda a, b: a.bitwiseAND(b), LONG, as_long)
_simple("bitOr", 2, 2, lambda a, b: a.bitwiseOR(b), LONG, as_long)
_simple("bitXor", 2, 2, lambda a, b: a.bitwiseXOR(b), LONG, as_long)
_simple("bitNot", 1, 1, F.bitwise_not, LONG, as_long)
_simple("bitShiftLeft", 2, 2, lambda a, b: F.call_function("shiftleft", a, b.cast("int")), LONG, as_long)
_simple("bitShiftRight", 2, 2, lambda a, b: F.call_function("shiftright", a, b.cast("int")), LONG, as_long)
register("pi", 0, 1)(lambda *_: Typed(F.pi(), DOUBLE))
register("e", 0, 1)(lambda *_: Typed(F.e(), DOUBLE))
register("rand", 0)(lambda: Typed(F.rand(), DOUBLE))
register("infinity", 0)(lambda: Typed(F.lit(float("inf")), DOUBLE))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid in a fold; 93 steps suffice for 64-bit values."""
    start = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0).cast("long"))).alias("y")))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"]))


_simple("gcd", 2, 2, _gcd, LONG, as_long)
_simple("lcm", 2, 2, lambda a, b: F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise((F.abs(a) / F.nullif(_gcd(a, b), F.lit(0).cast("long"))).cast("long") * F.abs(b)), LONG, as_long)


@register("round", 1, 3)
def _round(x: Typed, precision: Typed | None = None, mode: Typed | None = None) -> Typed:
    digits = 0 if precision is None else precision.constant and int(precision.constant[0])
    if digits is None:
        raise CypherSemanticError("the precision of round must be a literal")
    name = "HALF_UP" if mode is None else str(mode.constant[0]).upper()
    scale = 10.0**digits
    ways = {
        "HALF_UP": lambda c: F.round(c, digits),
        "HALF_EVEN": lambda c: F.bround(c, digits),
        "HALF_DOWN": lambda c: F.signum(c) * F.ceil(F.abs(c) * scale - 0.5) / scale,
        "CEILING": lambda c: F.ceil(c * scale) / scale,
        "FLOOR": lambda c: F.floor(c * scale) / scale,
        "UP": lambda c: F.signum(c) * F.ceil(F.abs(c) * scale) / scale,
        "DOWN": lambda c: F.signum(c) * F.floor(F.abs(c) * scale) / scale,
    }
    if name not in ways:
        raise CypherSemanticError(f"there is no rounding mode {name!r}")
    return make(lambda c: ways[name](c).cast("double"), as_double(x), dtype=DOUBLE)


# lists
register("toList", 1)(lambda x: x if x.kind == "list" else make(lambda c: F.when(c.isNotNull(), F.array(c)), x))
register("head", 1)(lambda x: make(lambda c: F.get(c, F.lit(0)), x, dtype=x.type.elementType if x.kind == "list" else None))
register("last", 1)(lambda x: make(lambda c: F.get(c, F.size(c) - 1), x, dtype=x.type.elementType if x.kind == "list" else None))
register("tail", 1)(lambda x: make(lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(0))), x, dtype=x.type))
register("sort", 1)(lambda x: make(F.array_sort, x, dtype=x.type))
register("flatten", 1)(lambda x: make(F.flatten, x) if x.kind == "list" and isinstance(x.type.elementType, T.ArrayType) else x)
register("min", 1)(lambda x: make(F.array_min, x))
register("max", 1)(lambda x: make(F.array_max, x))


@register("range", 2, 3)
def _range(start: Typed, stop: Typed, step: Typed | None = None) -> Typed:
    """Inclusive at both ends; empty where the step leads away from the end."""
    step = step or Typed(F.lit(1).cast("long"), LONG)
    none = F.array().cast("array<bigint>")

    def build(a: Column, b: Column, s: Column) -> Column:
        leads = ((s > 0) & (a <= b)) | ((s < 0) & (a >= b))
        return F.when(a.isNotNull() & b.isNotNull() & s.isNotNull(), F.when(leads, F.sequence(a, b, s)).otherwise(none))

    return make(build, *map(as_long, (start, stop, step)), dtype=T.ArrayType(LONG))


# time
register("now timestamp", 0, 1)(lambda *_: Typed(F.unix_millis(F.current_timestamp()), LONG))
register("date", 0, 1)(lambda x=None: temporal.date(x))
register("datetime localdatetime", 0, 1)(lambda x=None: temporal.datetime(x))
register("localtime", 0, 1)(lambda *_: Typed(F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS"), STRING))
register("localdate", 0, 1)(lambda *_: Typed(F.date_format(F.current_date(), "yyyy-MM-dd"), STRING))
register("duration", 1)(temporal.duration)
register("date.truncate", 2)(lambda u, x: temporal.truncate(u, x, True))
register("datetime.truncate localdatetime.truncate", 2)(lambda u, x: temporal.truncate(u, x, False))


# utility
@register("coalesce", 1, float("inf"))
def _coalesce(*args: Typed) -> Typed:
    known = [a for a in args if a.kind != "null"]
    return make(F.coalesce, *(known or args[:1]))


register("id elementId", 1)(lambda x: x)
_simple("nullIf", 2, 2, F.nullif, None)
_simple("exists", 1, 1, lambda c: c.isNotNull(), BOOLEAN)
register("randomUUID", 0, 1)(lambda *_: Typed(F.uuid(), STRING))
register("isNaN", 1)(lambda x: make(lambda c: F.when(c.isNotNull(), F.isnan(c)), as_double(x), dtype=BOOLEAN))
register("isInfinite", 1)(lambda x: make(lambda c: F.abs(c) == float("inf"), as_double(x), dtype=BOOLEAN))
register("isFinite", 1)(lambda x: make(lambda c: ~F.isnan(c) & (F.abs(c) < float("inf")), as_double(x), dtype=BOOLEAN))
