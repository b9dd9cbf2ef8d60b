"""Aggregating functions as built-in aggregate expressions (partial and final by Spark)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.errors import CypherSemanticError
from trellis.functions.typed import DOUBLE, LONG, Typed, as_double, make

NAMES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}


def _collect(x: Typed, distinct: bool) -> Typed:
    """Nulls are kept: each value is wrapped while it is gathered."""
    gathered = make(lambda c: F.transform(F.collect_list(F.struct(c.alias("v"))), lambda s: s["v"]), x, dtype=T.ArrayType(x.type))
    return make(F.array_distinct, gathered, dtype=gathered.type) if distinct else gathered


def _percentile_disc(x: Typed, p: Typed) -> Typed:
    """The element at floor((n - 1) * p) of the sorted values."""

    def pick(c, q):
        values = F.array_sort(F.collect_list(c))
        return F.get(values, F.floor((F.size(values) - 1) * q).cast("int"))

    return make(pick, x, p, dtype=x.type)


def aggregate(name: str, args: list[Typed], distinct: bool) -> Typed:
    name = name.lower()
    if name.startswith("percentile"):
        if len(args) != 2:
            raise CypherSemanticError(f"{name} takes 2 arguments")
        if name == "percentilecont":
            return make(lambda c, q: F.percentile(c, q), as_double(args[0]), args[1], dtype=DOUBLE)
        return _percentile_disc(*args)
    if len(args) != 1:
        raise CypherSemanticError(f"{name} takes 1 argument")
    (x,) = args
    if name == "collect":
        return _collect(x, distinct)
    if name == "count":
        return make(F.count_distinct if distinct else F.count, x, dtype=LONG)
    if name == "sum":
        dtype = LONG if x.kind == "integer" else DOUBLE
        return make(lambda c: (F.sum_distinct if distinct else F.sum)(c.cast(dtype)), x, dtype=dtype)
    if name in ("min", "max"):
        return make(F.min if name == "min" else F.max, x, dtype=x.type)
    if distinct:
        # moments of distinct values, over the gathered set
        values = make(lambda c: F.collect_set(c.cast("double")), x, dtype=T.ArrayType(DOUBLE))
        n = lambda v: F.nullif(F.size(v), F.lit(0)).cast("double")
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
        square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + (b - total(v) / n(v)) * (b - total(v) / n(v)))
        ways = {"avg": lambda v: total(v) / n(v), "stdevp": lambda v: F.sqrt(square(v) / n(v)), "stdev": lambda v: F.sqrt(square(v) / F.nullif(n(v) - 1, F.lit(0.0)))}
        return make(ways[name], values, dtype=DOUBLE)
    ways = {"avg": F.avg, "stdev": F.stddev_samp, "stdevp": F.stddev_pop}
    return make(ways[name], as_double(x), dtype=DOUBLE)
