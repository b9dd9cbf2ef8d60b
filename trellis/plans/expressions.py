"""Expressions of the syntax tree to typed columns over a frame."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.errors import CypherSemanticError
from trellis.functions import aggregates, scalar, temporal
from trellis.functions.typed import BOOLEAN, DOUBLE, LONG, NULL, STRING, Typed, as_double, as_long, make, text
from trellis.plans import ast as A
from trellis.plans.scope import Frame, quoted

MAX_PATTERN_CHARS = 1000


def has_aggregate(e: Any) -> bool:
    """Whether an aggregate is in the expression (``min`` and ``max`` of lists are told apart by type later)."""
    return any(isinstance(n, A.Call) and (n.star or n.name.lower() in aggregates.NAMES) for n in A.walk(e))


def literal(value: Any) -> Typed:
    """A Python value as a column."""
    constant = (value,)
    if value is None:
        return Typed(F.lit(None), NULL, constant=constant)
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOLEAN, constant=constant)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), LONG, constant=constant)
    if isinstance(value, float):
        return Typed(F.lit(None).cast("double") if math.isnan(value) else F.lit(value), DOUBLE, constant=constant)
    if isinstance(value, str):
        return Typed(F.lit(value), STRING, constant=constant)
    return Typed(F.lit(value), None, constant=constant)


class Expressions:
    """Compiles expressions over one frame.

    ``exists`` and ``comprehensions`` map sub-queries, which the clause compiler has
    already joined to the frame, to the columns that hold their values.
    """

    def __init__(self, frame: Frame, parameters: dict[str, Any], udfs: dict, joined: dict | None = None, aggregating: bool = False):
        self.frame, self.parameters, self.udfs = frame, parameters, udfs
        self.joined, self.aggregating = joined or {}, aggregating
        self.local: dict[str, Typed] = {}

    def ask(self, probe: Column) -> T.DataType:
        return self.frame.df.select(probe.alias("x")).schema[0].dataType

    def __call__(self, e: A.Node) -> Typed:
        if e in self.joined:
            return self._of_column(self.joined[e])
        out = getattr(self, f"_{type(e).__name__.lower()}")(e)
        if out._ask is None:
            out._ask = self.ask
        return out

    def _of_column(self, name: str) -> Typed:
        return Typed(quoted(name), self.frame.type_of(name), ask=self.ask)

    # leaves

    def _literal(self, e: A.Literal) -> Typed:
        return literal(e.value)

    def _parameter(self, e: A.Parameter) -> Typed:
        if e.name not in self.parameters:
            raise CypherSemanticError(f"the parameter ${e.name} is not given")
        return self.value(self.parameters[e.name])

    def value(self, v: Any) -> Typed:
        """Lists and maps of Python values; lists of maps get all their keys."""
        if isinstance(v, dict):
            return self._map([(str(k), self.value(x)) for k, x in v.items()])
        if isinstance(v, (list, tuple)):
            if v and all(isinstance(x, dict) for x in v):
                keys = list(dict.fromkeys(k for x in v for k in x))
                v = [{k: x.get(k) for k in keys} for x in v]
            out = self._list([self.value(x) for x in v])
            out.constant = (list(v),)
            return out
        return literal(v)

    def _variable(self, e: A.Variable) -> Typed:
        if e.name in self.local:
            return self.local[e.name]
        return self._of_column(self.frame.symbol(e.name).column)

    # access

    def _property(self, e: A.Property) -> Typed:
        if isinstance(e.target, A.Variable) and e.target.name not in self.local:
            symbol = self.frame.symbol(e.target.name)
            if symbol.kind in ("node", "rel"):
                if e.name in symbol.props:
                    return self._of_column(symbol.props[e.name])
                return literal(None)
        return self._field(self(e.target), e.name)

    def _field(self, value: Typed, name: str) -> Typed:
        if isinstance(value.type, T.StructType):
            if name in value.type.fieldNames():
                return make(lambda c: c[name], value, dtype=value.type[name].dataType)
            return literal(None)
        if isinstance(value.type, T.MapType):
            return make(lambda c: F.try_element_at(c, F.lit(name)), value, dtype=value.type.valueType)
        if value.kind in ("string", "temporal") and name in temporal.FIELDS:
            return temporal.field(value, name)
        if value.kind == "null":
            return literal(None)
        raise CypherSemanticError(f"a value of type {value.type.simpleString()} has no property {name!r}")

    def _index(self, e: A.Index) -> Typed:
        value, at = self(e.target), self(e.at)
        if isinstance(value.type, T.StructType):
            if at.constant is None:
                raise CypherSemanticError("the key of a map literal must be a literal")
            return self._field(value, str(at.constant[0]))
        if isinstance(value.type, T.MapType):
            return make(F.try_element_at, value, at, dtype=value.type.valueType)
        if value.kind == "string":
            return make(lambda s, i: F.nullif(F.substring(s, F.when(i < 0, F.length(s) + i).otherwise(i).cast("int") + 1, F.lit(1)), F.lit("")), value, at, dtype=STRING)
        if value.kind == "null":
            return literal(None)
        place = lambda c, i: F.when(i < 0, F.size(c) + i).otherwise(i).cast("int")
        return make(lambda c, i: F.get(c, place(c, i)), value, at, dtype=value.type.elementType)

    def _slice(self, e: A.Slice) -> Typed:
        value = self(e.target)
        size = F.length if value.kind == "string" else F.size
        zero = literal(0)
        start = self(e.start) if e.start is not None else zero
        stop = self(e.stop) if e.stop is not None else make(lambda c: size(c).cast("long"), value, dtype=LONG)

        def cut(c: Column, a: Column, b: Column) -> Column:
            bound = lambda i: F.greatest(F.lit(0), F.least(size(c), F.when(i < 0, size(c) + i).otherwise(i))).cast("int")
            n = F.greatest(F.lit(0), bound(b) - bound(a))
            part = F.substring(c, bound(a) + 1, n) if value.kind == "string" else F.slice(c, bound(a) + 1, n)
            return F.when(a.isNotNull() & b.isNotNull(), part)

        return make(cut, value, start, stop, dtype=value.type)

    def _haslabel(self, e: A.HasLabel) -> Typed:
        symbol = self.frame.symbol(e.value.name)
        if symbol.label_column is not None:
            wanted = set(e.labels)
            if len(wanted) > 1:
                return literal(False)
            return make(lambda c: c == e.labels[0], self._of_column(symbol.label_column), dtype=BOOLEAN)
        return make(lambda c: F.when(c.isNotNull(), F.lit(symbol.labels == e.labels or set(e.labels) == set(symbol.labels))), self._of_column(symbol.column), dtype=BOOLEAN)

    # operators

    def _unary(self, e: A.Unary) -> Typed:
        value = self(e.value)
        if e.op == "NOT":
            return make(lambda c: ~c, self._truth(value), dtype=BOOLEAN)
        return make(lambda c: -c, value, dtype=value.type) if e.op == "-" else value

    @staticmethod
    def _truth(value: Typed) -> Typed:
        if value.kind == "boolean":
            return value
        if value.kind == "null":
            return make(lambda c: c.cast("boolean"), value, dtype=BOOLEAN)
        raise CypherSemanticError(f"a value of type {value.type.simpleString()} is no condition")

    def _binary(self, e: A.Binary) -> Typed:
        left, right = self(e.left), self(e.right)
        op = e.op
        if op in ("AND", "OR", "XOR"):
            ways = {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b, "XOR": lambda a, b: a != b}
            return make(ways[op], self._truth(left), self._truth(right), dtype=BOOLEAN)
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return self._compare(op, left, right)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            if "string" not in (left.kind, right.kind) or {left.kind, right.kind} - {"string", "null"}:
                raise CypherSemanticError(f"{op} needs strings, not {left.type.simpleString()} and {right.type.simpleString()}")
            ways = {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}
            return make(ways[op], text(left), text(right), dtype=BOOLEAN)
        if op == "=~":
            if right.constant is not None and len(str(right.constant[0])) > MAX_PATTERN_CHARS:
                raise CypherSemanticError(f"a pattern has over {MAX_PATTERN_CHARS} characters")
            return make(lambda s, p: F.call_function("rlike", s, F.concat(F.lit("\\A(?:"), p, F.lit(")\\z"))), text(left), right, dtype=BOOLEAN)
        if op == "IN":
            return self._in(left, right)
        return self._arithmetic(op, left, right)

    @staticmethod
    def _compare(op: str, left: Typed, right: Typed) -> Typed:
        ways = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
        kinds = {"integer": "number", "float": "number"}
        a, b = kinds.get(left.kind, left.kind), kinds.get(right.kind, right.kind)
        if "null" in (a, b):
            return make(lambda x, y: F.lit(None).cast("boolean"), left, right, dtype=BOOLEAN)
        if {a, b} == {"temporal", "string"}:
            moment = lambda t: t if t.kind == "temporal" else make(lambda c: c.try_cast("timestamp"), t)
            return make(ways[op], moment(left), moment(right), dtype=BOOLEAN)
        if a != b and "other" not in (a, b):
            # values of different kinds are never equal and have no order
            fixed = {"=": F.lit(False), "<>": F.lit(True)}.get(op, F.lit(None).cast("boolean"))
            return make(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), fixed), left, right, dtype=BOOLEAN)
        return make(ways[op], left, right, dtype=BOOLEAN)

    def _in(self, left: Typed, right: Typed) -> Typed:
        if right.kind == "null":
            return make(lambda a, b: F.lit(None).cast("boolean"), left, right, dtype=BOOLEAN)
        if right.kind != "list":
            return self._compare("=", left, right)
        if right.constant is not None and right.constant[0] and all(isinstance(v, (int, float, str)) for v in right.constant[0]) and left.kind in ("integer", "float", "string"):
            numbers = left.kind != "string"
            values = [v for v in right.constant[0] if isinstance(v, str) != numbers]
            return make(lambda a: a.isin(*values) if values else F.when(a.isNotNull(), F.lit(False)), left, dtype=BOOLEAN)
        return make(lambda a, b: F.when(F.size(b) == 0, F.lit(False)).otherwise(F.array_contains(b, a)), left, right, dtype=BOOLEAN)

    def _arithmetic(self, op: str, left: Typed, right: Typed) -> Typed:
        kinds = {left.kind, right.kind}
        if "null" in kinds and not (op == "+" and "list" in kinds):
            return literal(None)
        if "duration" in kinds and op in "+-":
            sign = 1 if op == "+" else -1
            if kinds == {"duration"}:
                return temporal.combine(left, right, sign)
            value, by = (right, left) if left.kind == "duration" and op == "+" else (left, right)
            return temporal.shift(value, by, sign)
        if op == "-" and kinds <= {"string", "temporal"}:
            return temporal.between(left, right)
        if op == "+" and "list" in kinds:
            as_list = lambda x: x if x.kind == "list" else make(F.array, x)
            return make(F.concat, as_list(left), as_list(right))
        if op == "+" and "string" in kinds:
            return make(F.concat, text(left), text(right), dtype=STRING)
        if kinds - {"integer", "float", "other"}:
            raise CypherSemanticError(f"can't apply {op} to {left.type.simpleString()} and {right.type.simpleString()}")
        whole = kinds == {"integer"}
        if op == "^":
            out = make(lambda a, b: F.pow(a, b), as_double(left), as_double(right), dtype=DOUBLE)
            if whole and right.constant is not None and right.constant[0] >= 0:
                return as_long(out)
            return out
        if whole:
            a, b = as_long(left), as_long(right)
            ways = {
                "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y,
                "/": lambda x, y: F.call_function("div", x, F.nullif(y, F.lit(0).cast("long"))), "%": lambda x, y: x % F.nullif(y, F.lit(0).cast("long")),
            }
            return make(ways[op], a, b, dtype=LONG)
        inf = float("inf")
        ways = {
            "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "%": lambda x, y: x % F.nullif(y, F.lit(0.0)),
            "/": lambda x, y: F.when(y != 0, x / F.nullif(y, F.lit(0.0))).when(x > 0, inf).when(x < 0, -inf),
        }
        if op == "/" and right.constant is not None and right.constant[0]:
            ways["/"] = lambda x, y: x / y
        return make(ways[op], as_double(left), as_double(right), dtype=DOUBLE)

    def _isnull(self, e: A.IsNull) -> Typed:
        return make((lambda c: c.isNotNull()) if e.negated else (lambda c: c.isNull()), self(e.value), dtype=BOOLEAN)

    # literals of lists and maps

    def _list(self, items: list[Typed]) -> Typed:
        if not items:
            return Typed(F.array(), T.ArrayType(NULL), ask=self.ask, constant=([],))
        known = [i for i in items if i.kind != "null"]
        kinds = {i.kind for i in known}
        if kinds == {"integer", "float"}:
            items = [as_double(i) for i in items]
        elif len(kinds) > 1:
            items = [make(lambda c: c.cast("variant"), i, dtype=T.VariantType()) for i in items]
        element = next((i.type for i in items if i.kind != "null"), NULL)
        dtype = T.ArrayType(element) if len(kinds) <= 1 and "map" not in kinds and "list" not in kinds or kinds == {"integer", "float"} else None
        out = make(F.array, *items, dtype=dtype)
        if all(i.constant is not None for i in items):
            out.constant = ([i.constant[0] for i in items],)
        return out

    def _listliteral(self, e: A.ListLiteral) -> Typed:
        if e.items and all(isinstance(i, A.MapLiteral) for i in e.items):
            keys = list(dict.fromkeys(k for i in e.items for k, _ in i.entries))
            return self._list([self._map([(k, self(dict(i.entries).get(k, A.Literal(None)))) for k in keys]) for i in e.items])
        return self._list([self(i) for i in e.items])

    def _map(self, entries: list[tuple[str, Typed]]) -> Typed:
        if not entries:
            return Typed(F.create_map().cast("map<string,string>"), ask=self.ask)
        dtype = T.StructType([T.StructField(k, v.type) for k, v in entries]) if all(v._type is not None for _, v in entries) else None
        names = [k for k, _ in entries]
        return make(lambda *cols: F.struct(*[c.alias(k) for k, c in zip(names, cols, strict=True)]), *[v for _, v in entries], dtype=dtype)

    def _mapliteral(self, e: A.MapLiteral) -> Typed:
        return self._map([(k, self(v)) for k, v in e.entries])

    def _mapprojection(self, e: A.MapProjection) -> Typed:
        entries: dict[str, Typed] = {}
        for key, value in e.entries:
            if key == ".*":
                whole = self._all_properties(A.Variable(e.name))
                entries |= {n: self._field(whole, n) for n in whole.type.fieldNames()}
            else:
                entries[key] = self(A.Property(A.Variable(e.name), key) if value is None else value)
        return self._map(list(entries.items()))

    # control

    def _case(self, e: A.Case) -> Typed:
        whens = []
        for operands, value in e.whens:
            if e.subject is None:
                condition = self._truth(self(operands[0]))
            else:
                tests = [self._compare("=", self(e.subject), self(o)) for o in operands]
                condition = tests[0]
                for t in tests[1:]:
                    condition = make(lambda a, b: a | b, condition, t, dtype=BOOLEAN)
            whens.append((condition, self(value)))
        default = self(e.default) if e.default is not None else literal(None)
        values = self._unified([v for _, v in whens] + [default])

        def build(*cols: Column) -> Column:
            n = len(whens)
            out = F.when(cols[0], cols[n])
            for k in range(1, n):
                out = out.when(cols[k], cols[n + k])
            return out.otherwise(cols[-1])

        dtype = next((v.type for v in values if v.kind != "null"), NULL)
        return make(build, *[c for c, _ in whens], *values, dtype=dtype)

    @staticmethod
    def _unified(values: list[Typed]) -> list[Typed]:
        kinds = {v.kind for v in values} - {"null"}
        if kinds == {"integer", "float"}:
            return [as_double(v) for v in values]
        if kinds == {"integer"}:
            return [as_long(v) for v in values]
        if len(kinds) > 1:
            return [text(v) for v in values]
        return values

    # lists with a variable

    def _inside(self, name: str, element: T.DataType, build):
        """Compile ``build`` with ``name`` bound to a lambda's column."""

        def run(c: Column) -> Typed:
            before = self.local.get(name)
            self.local[name] = Typed(c, element, F.lit(None).cast(element), self.ask)
            try:
                return build()
            finally:
                if before is None:
                    del self.local[name]
                else:
                    self.local[name] = before

        return run

    def _source(self, e: A.Node) -> Typed:
        value = self(e)
        if value.kind == "null":
            return Typed(F.array().cast("array<string>"), T.ArrayType(STRING), ask=self.ask)
        if value.kind != "list":
            raise CypherSemanticError(f"a value of type {value.type.simpleString()} is no list")
        return value

    def _comprehension(self, e: A.Comprehension) -> Typed:
        source = self._source(e.source)
        element = source.type.elementType
        body = self._inside(e.name, element, lambda: self(e.body)) if e.body is not None else None
        where = self._inside(e.name, element, lambda: self._truth(self(e.where))) if e.where is not None else None
        result = body(F.lit(None).cast(element)).type if body is not None else element

        def build(c: Column, probing: bool = False) -> Column:
            out = F.coalesce(c, F.array().cast(T.ArrayType(element)))
            side = (lambda t: t.probe) if probing else (lambda t: t.col)
            if where is not None:
                out = F.filter(out, lambda x: F.coalesce(side(where(x)), F.lit(False)))
            return F.transform(out, lambda x: side(body(x))) if body is not None else out

        return Typed(build(source.col), T.ArrayType(result), F.lit(None).cast(T.ArrayType(result)) if source.col is not source.probe else build(source.col), self.ask)

    def _quantifier(self, e: A.Quantifier) -> Typed:
        source = self._source(e.source)
        where = self._inside(e.name, source.type.elementType, lambda: self._truth(self(e.where)))
        test = lambda x: F.coalesce(where(x).col, F.lit(False))
        ways = {
            "any": lambda c: F.exists(c, test), "none": lambda c: ~F.exists(c, test), "all": lambda c: F.forall(c, test),
            "single": lambda c: F.size(F.filter(c, test)) == 1,
        }
        col = F.coalesce(ways[e.kind](source.col), F.lit(e.kind in ("all", "none")))
        return Typed(col, BOOLEAN, F.lit(None).cast("boolean") if source.col is not source.probe else None, self.ask)

    def _reduce(self, e: A.Reduce) -> Typed:
        source, init = self._source(e.source), self(e.init)
        element = source.type.elementType

        def body(acc: Column, x: Column, acc_type: T.DataType) -> Typed:
            return self._inside(e.acc, acc_type, lambda: self._inside(e.name, element, lambda: self(e.body))(x))(acc)

        acc_type = LONG if init.kind == "integer" else init.type
        for _ in range(2):  # the accumulator takes the wider of its first and later types
            made = body(F.lit(None).cast(acc_type), F.lit(None).cast(element), acc_type)
            if made.kind == "float" or init.kind == "null" or acc_type == NULL:
                acc_type = made.type if made.kind != "float" else DOUBLE
        none = F.array().cast(T.ArrayType(element))
        col = F.aggregate(F.coalesce(source.col, none), init.col.cast(acc_type), lambda a, x: body(a, x, acc_type).col.cast(acc_type))
        return Typed(col, acc_type, F.lit(None).cast(acc_type) if source.col is not source.probe else None, self.ask)

    # sub-queries are joined before

    def _exists(self, e: A.Exists) -> Typed:
        raise CypherSemanticError("EXISTS can't be used here")

    _patterncomprehension = _exists

    # calls

    def _call(self, e: A.Call) -> Typed:
        name = e.name.lower()
        if e.star:
            if name != "count":
                raise CypherSemanticError(f"{e.name}(*) is not defined")
            if not self.aggregating:
                raise CypherSemanticError("count(*) can't be used here")
            return Typed(F.count(F.lit(1)), LONG)
        if name in self.udfs:
            return self.udfs[name](*[self(a) for a in e.args])
        graph = self._graph_function(name, e)
        if graph is not None:
            return graph
        args = [self(a) for a in e.args]
        if name in aggregates.NAMES:
            of_list = name in ("min", "max") and len(args) == 1 and args[0].kind == "list" and not e.distinct
            if not of_list:
                if not self.aggregating or self.local:
                    raise CypherSemanticError(f"the aggregate {e.name} can't be used here")
                if any(has_aggregate(a) for a in e.args):
                    raise CypherSemanticError(f"the argument of {e.name} holds an aggregate")
                return aggregates.aggregate(name, args, e.distinct)
        return scalar.lookup(e.name, len(args))(*args)

    def _graph_function(self, name: str, e: A.Call) -> Typed | None:
        if len(e.args) != 1 or not isinstance(e.args[0], A.Variable) or e.args[0].name in self.local or e.args[0].name not in self.frame.symbols:
            return None
        symbol = self.frame.symbols[e.args[0].name]
        own = self._of_column(symbol.column)
        if name == "length" and symbol.kind == "path":
            return own
        if name in ("nodes", "relationships") and symbol.kind == "path":
            if name not in symbol.props:
                raise CypherSemanticError(f"a path of variable length keeps its ends and its length, not its {name}")
            return self._of_column(symbol.props[name])
        if symbol.kind not in ("node", "rel"):
            return None
        label = self._of_column(symbol.label_column) if symbol.label_column else make(lambda c: F.when(c.isNotNull(), F.lit(symbol.labels[0] if symbol.labels else None)), own, dtype=STRING)
        if name == "labels" and symbol.kind == "node":
            return make(lambda c, own: F.when(own.isNotNull(), F.array(c)), label, own, dtype=T.ArrayType(STRING))
        if name == "type" and symbol.kind == "rel":
            return label
        if name == "keys":
            return make(lambda c: F.when(c.isNotNull(), F.array(*[F.lit(p) for p in symbol.props])), own, dtype=T.ArrayType(STRING))
        if name == "properties":
            return self._all_properties(e.args[0])
        if name in ("startnode", "endnode") and symbol.kind == "rel" and symbol.source:
            return self._of_column(symbol.source if name == "startnode" else symbol.target)
        return None

    def _all_properties(self, e: A.Variable) -> Typed:
        symbol = self.frame.symbols.get(e.name)
        if symbol is None or symbol.kind not in ("node", "rel"):
            return self(e)
        return self._map([(p, self._of_column(c)) for p, c in symbol.props.items()])
