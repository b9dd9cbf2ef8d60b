"""Query text to syntax tree: a tokenizer and a recursive-descent parser."""

from __future__ import annotations

import re
from functools import lru_cache

from trellis.errors import CypherSyntaxError, LimitExceededError
from trellis.plans import ast as A

MAX_QUERY_CHARS = 1 << 20
MAX_DEPTH = 200

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
  | (?P<float>(?:\d[\d_]*)?\.\d+(?:[eE][+-]?\d+)?[fFdD]?|\d[\d_]*[eE][+-]?\d+[fFdD]?|\d[\d_]*\.(?!\.)(?![A-Za-z_])|\d+[fFdD](?!\w))
  | (?P<int>0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|\d[\d_]*)
  | (?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
  | (?P<name>[A-Za-z_]\w*|`[^`]+`)
  | (?P<op><=|>=|<>|!=|=~|\+=|\.\.|->|<-|[-+*/%^=<>()\[\]{},.:|;$])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_RESERVED = {
    "MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "UNWIND", "CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "FOREACH", "CALL",
    "YIELD", "UNION", "ORDER", "SKIP", "LIMIT", "AS", "AND", "OR", "XOR", "NOT", "IN", "IS", "CASE", "WHEN", "THEN", "ELSE", "END",
    "STARTS", "ENDS", "CONTAINS", "DISTINCT", "ON", "BY", "ASC", "DESC", "ASCENDING", "DESCENDING",
}


class _Tokens:
    def __init__(self, text: str):
        self.text, self.items, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise CypherSyntaxError(f"unexpected character {text[at]!r}", text, at)
            if m.lastgroup != "skip":
                self.items.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.items.append(("end", "", len(text)))


class Parser:
    def __init__(self, text: str):
        if len(text) > MAX_QUERY_CHARS:
            raise LimitExceededError(f"the query has over {MAX_QUERY_CHARS} characters")
        if not text.strip():
            raise CypherSyntaxError("the query is empty")
        self.text, self.tokens, self.i, self.depth, self.unnamed = text, _Tokens(text).items, 0, 0, 0

    # tokens

    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)]

    def at(self, *words: str, ahead: int = 0) -> bool:
        """Whether the next tokens are these words or signs."""
        for k, w in enumerate(words):
            kind, value, _ = self.peek(ahead + k)
            if kind not in ("name", "op") or value.upper() != w or kind == "name" and value[0] == "`":
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            kind, value, at = self.peek()
            raise CypherSyntaxError(f"expected {' '.join(words)}, found {value or 'the end'!r}", self.text, at)

    def name(self) -> str:
        kind, value, at = self.peek()
        if kind != "name":
            raise CypherSyntaxError(f"expected a name, found {value or 'the end'!r}", self.text, at)
        self.i += 1
        return value[1:-1] if value[0] == "`" else value

    def variable(self) -> str:
        kind, value, at = self.peek()
        if kind == "name" and value.upper() in _RESERVED:
            raise CypherSyntaxError(f"{value!r} is a keyword", self.text, at)
        return self.name()

    def many(self, one, separator: str = ",") -> tuple:
        out = [one()]
        while self.take(separator):
            out.append(one())
        return tuple(out)

    # statements

    def query(self) -> A.Query:
        statements, every = [self.statement()], True
        while self.take("UNION"):
            every = self.take("ALL") and every
            statements.append(self.statement())
        self.take(";")
        if self.peek()[0] != "end":
            raise CypherSyntaxError(f"unexpected {self.peek()[1]!r}", self.text, self.peek()[2])
        return A.Query(tuple(statements), every, self.text)

    def statement(self) -> tuple[A.Node, ...]:
        clauses: list[A.Node] = []
        while (clause := self.clause()) is not None:
            if clauses and isinstance(clauses[-1], A.Projection) and clauses[-1].final:
                raise CypherSyntaxError("RETURN must be the last clause", self.text, self.peek()[2])
            clauses.append(clause)
        if not clauses:
            raise CypherSyntaxError(f"expected a clause, found {self.peek()[1] or 'the end'!r}", self.text, self.peek()[2])
        last = clauses[-1]
        if not (isinstance(last, (*A.UPDATES, A.CallProcedure)) or isinstance(last, A.Projection) and last.final):
            if not any(isinstance(c, A.UPDATES) for c in clauses):
                raise CypherSyntaxError("the query returns nothing and changes nothing", self.text, self.peek()[2])
        return tuple(clauses)

    def clause(self) -> A.Node | None:
        if self.take("OPTIONAL", "MATCH"):
            return self.match(True)
        if self.take("MATCH"):
            return self.match(False)
        if self.take("UNWIND"):
            value = self.expression()
            self.need("AS")
            return A.Unwind(value, self.variable())
        if self.take("WITH"):
            return self.projection(False)
        if self.take("RETURN"):
            return self.projection(True)
        if self.take("CALL"):
            return self.call()
        return self.update()

    def update(self) -> A.Node | None:
        if self.take("CREATE"):
            return A.Create(self.many(self.path))
        if self.take("MERGE"):
            path, on = self.path(), {"CREATE": (), "MATCH": ()}
            while self.at("ON"):
                kind = "CREATE" if self.at("ON", "CREATE") else "MATCH"
                self.need("ON", kind)
                self.need("SET")
                on[kind] += self.many(self.set_item)
            return A.Merge(path, on["CREATE"], on["MATCH"])
        if self.take("SET"):
            return A.SetClause(self.many(self.set_item))
        if self.take("REMOVE"):
            return A.Remove(self.many(self.remove_item))
        if self.take("DETACH", "DELETE"):
            return A.Delete(self.many(self.expression), True)
        if self.take("DELETE"):
            return A.Delete(self.many(self.expression))
        if self.take("FOREACH"):
            self.need("(")
            name = self.variable()
            self.need("IN")
            source = self.expression()
            self.need("|")
            updates = []
            while (clause := self.update()) is not None:
                updates.append(clause)
            self.need(")")
            return A.Foreach(name, source, tuple(updates))
        return None

    def match(self, optional: bool) -> A.Match:
        paths = self.many(self.path)
        return A.Match(paths, self.expression() if self.take("WHERE") else None, optional)

    def set_item(self) -> A.SetItem:
        target = self.variable()
        if self.take("+="):
            return A.SetItem("merge", target, None, self.expression())
        if self.take("="):
            return A.SetItem("replace", target, None, self.expression())
        if self.at(":"):
            labels = self.labels()
            return A.SetItem("label", target, labels[0])
        self.need(".")
        name = self.name()
        self.need("=")
        return A.SetItem("property", target, name, self.expression())

    def remove_item(self) -> A.SetItem:
        target = self.variable()
        if self.at(":"):
            return A.SetItem("label", target, self.labels()[0])
        self.need(".")
        return A.SetItem("property", target, self.name(), A.Literal(None))

    def call(self) -> A.CallProcedure:
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        args = self.arguments() if self.take("(") else ()
        yields, where = None, None
        if self.take("YIELD"):
            if not self.take("*"):
                yields = self.many(lambda: (n := self.name(), self.variable() if self.take("AS") else n))
            where = self.expression() if self.take("WHERE") else None
        return A.CallProcedure(name, args, yields, where)

    def arguments(self) -> tuple[A.Node, ...]:
        args = () if self.at(")") else self.many(self.expression)
        self.need(")")
        return args

    def projection(self, final: bool) -> A.Projection:
        distinct = self.take("DISTINCT")
        star = self.take("*")
        items = self.many(self.item) if not star or self.take(",") else ()
        order = self.many(self.sort) if self.take("ORDER", "BY") else ()
        skip = self.expression() if self.take("SKIP") else None
        limit = self.expression() if self.take("LIMIT") else None
        where = self.expression() if not final and self.take("WHERE") else None
        if where is not None and not order and self.take("ORDER", "BY"):
            order = self.many(self.sort)
        if where is not None and skip is None and self.take("SKIP"):
            skip = self.expression()
        if where is not None and limit is None and self.take("LIMIT"):
            limit = self.expression()
        return A.Projection(items, star, distinct, order, skip, limit, where, final)

    def item(self) -> A.Item:
        value = self.expression()
        return A.Item(value, self.name() if self.take("AS") else None)

    def sort(self) -> A.Sort:
        value, nulls = self.expression(), None
        descending = self.take("DESC") or self.take("DESCENDING")
        if not descending and not self.take("ASC"):
            self.take("ASCENDING")
        if self.take("NULLS", "FIRST"):
            nulls = "first"
        elif self.take("NULLS", "LAST"):
            nulls = "last"
        return A.Sort(value, descending, nulls)

    # patterns

    def path(self) -> A.PathPattern:
        name = None
        if self.peek()[0] == "name" and self.peek(1)[1] == "=":
            name = self.variable()
            self.need("=")
        for word, kind in (("SHORTESTPATH", "one"), ("ALLSHORTESTPATHS", "all")):
            if self.take(word, "("):
                nodes, rels = self.element()
                self.need(")")
                return A.PathPattern(name, nodes, rels, kind)
        return A.PathPattern(name, *self.element())

    def element(self) -> tuple[tuple[A.NodePattern, ...], tuple[A.RelPattern, ...]]:
        nodes, rels = [self.node()], []
        while self.at("-") or self.at("<-"):
            rels.append(self.relationship())
            nodes.append(self.node())
        return tuple(nodes), tuple(rels)

    def fresh(self) -> str:
        self.unnamed += 1
        return f"_anon{self.unnamed}"

    def labels(self) -> tuple[str, ...]:
        out = []
        while self.take(":"):
            out.append(self.name())
        return tuple(out)

    def node(self) -> A.NodePattern:
        self.need("(")
        name = self.variable() if self.peek()[0] == "name" and not self.at("WHERE") else self.fresh()
        labels, either = (), False
        if self.take(":"):
            if self.at("!") or self.at("%"):
                raise CypherSyntaxError("label expressions other than A|B are not supported", self.text, self.peek()[2])
            labels = (self.name(),)
            while self.at("|") or self.at(":"):
                either = self.at("|") or either
                self.i += 1
                self.take(":")
                labels += (self.name(),)
        properties = self.properties()
        where = self.expression() if self.take("WHERE") else None
        self.need(")")
        return A.NodePattern(name, labels, either, properties, where)

    def properties(self) -> A.Node | None:
        if self.at("{"):
            return self.map_literal()
        return self.parameter() if self.at("$") else None

    def relationship(self) -> A.RelPattern:
        left = self.take("<-")
        if not left:
            self.need("-")
        name, types, properties, length, where = self.fresh(), (), None, None, None
        if self.take("["):
            if self.peek()[0] == "name":
                name = self.variable()
            if self.take(":"):
                types = (self.name(),)
                while self.take("|"):
                    self.take(":")
                    types += (self.name(),)
            if self.take("*"):
                length = self.length()
            properties = self.properties()
            where = self.expression() if self.take("WHERE") else None
            self.need("]")
        right = self.take("->")
        if not right:
            self.need("-")
        direction = "both" if left == right else "in" if left else "out"
        return A.RelPattern(name, types, direction, properties, length, where)

    def length(self) -> tuple[int, int | None]:
        number = lambda: int(self.tokens[self.next()][1].replace("_", "")) if self.peek()[0] == "int" else None
        kind, value, _ = self.peek()
        if kind == "float" and re.fullmatch(r"\d+\.", value):  # "1." before a dot: 1..3
            raise CypherSyntaxError("bad length", self.text, self.peek()[2])
        low = number()
        if self.take(".."):
            return (1 if low is None else low), number()
        return (1, None) if low is None else (low, low)

    def next(self) -> int:
        self.i += 1
        return self.i - 1

    # expressions, by falling precedence

    def expression(self) -> A.Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise LimitExceededError(f"expressions nest deeper than {MAX_DEPTH}")
        try:
            return self.binary(0)
        finally:
            self.depth -= 1

    _LEVELS = (("OR",), ("XOR",), ("AND",))

    def binary(self, level: int) -> A.Node:
        if level == len(self._LEVELS):
            return self.negation()
        left = self.binary(level + 1)
        for op in self._LEVELS[level]:
            while self.take(op):
                left = A.Binary(op, left, self.binary(level + 1))
        return left

    def negation(self) -> A.Node:
        if self.take("NOT"):
            return A.Unary("NOT", self.negation())
        return self.comparison()

    def comparison(self) -> A.Node:
        first = self.predicate()
        chain, left = [], first
        while self.peek()[0] == "op" and self.peek()[1] in ("=", "<>", "!=", "<", ">", "<=", ">="):
            op = self.tokens[self.next()][1]
            right = self.predicate()
            chain.append(A.Binary("<>" if op == "!=" else op, left, right))
            left = right
        if not chain:
            return first
        out = chain[0]
        for c in chain[1:]:
            out = A.Binary("AND", out, c)
        return out

    def predicate(self) -> A.Node:
        left = self.sum()
        while True:
            if self.take("STARTS", "WITH"):
                left = A.Binary("STARTS WITH", left, self.sum())
            elif self.take("ENDS", "WITH"):
                left = A.Binary("ENDS WITH", left, self.sum())
            elif self.take("CONTAINS"):
                left = A.Binary("CONTAINS", left, self.sum())
            elif self.take("=~"):
                left = A.Binary("=~", left, self.sum())
            elif self.take("NOT", "IN"):
                left = A.Unary("NOT", A.Binary("IN", left, self.sum()))
            elif self.take("IN"):
                left = A.Binary("IN", left, self.sum())
            elif self.take("IS", "NOT", "NULL"):
                left = A.IsNull(left, True)
            elif self.take("IS", "NULL"):
                left = A.IsNull(left, False)
            elif self.at(":") and isinstance(left, A.Variable):
                left = A.HasLabel(left, self.labels())
            else:
                return left

    def sum(self) -> A.Node:
        left = self.product()
        while self.at("+") or self.at("-"):
            op = self.tokens[self.next()][1]
            left = A.Binary(op, left, self.product())
        return left

    def product(self) -> A.Node:
        left = self.power()
        while self.at("*") or self.at("/") or self.at("%"):
            op = self.tokens[self.next()][1]
            left = A.Binary(op, left, self.power())
        return left

    def power(self) -> A.Node:
        left = self.unary()
        while self.take("^"):
            left = A.Binary("^", left, self.unary())
        return left

    def unary(self) -> A.Node:
        if self.at("-") or self.at("+"):
            op = self.tokens[self.next()][1]
            value = self.unary()
            if isinstance(value, A.Literal) and isinstance(value.value, (int, float)) and not isinstance(value.value, bool):
                return A.Literal(-value.value if op == "-" else value.value)
            return A.Unary(op, value)
        return self.postfix()

    def postfix(self) -> A.Node:
        value = self.atom()
        while True:
            if self.at(".") and self.peek(1)[0] == "name":
                self.i += 1
                value = A.Property(value, self.name())
            elif self.take("["):
                start = None if self.at("..") else self.expression()
                if self.take(".."):
                    stop = None if self.at("]") else self.expression()
                    value = A.Slice(value, start, stop)
                else:
                    value = A.Index(value, start)
                self.need("]")
            else:
                return value

    def atom(self) -> A.Node:
        kind, value, at = self.peek()
        if kind == "int":
            self.i += 1
            digits = value.replace("_", "")
            return A.Literal(int(digits, 16) if digits[:2] in ("0x", "0X") else int(digits, 8) if digits[:2] in ("0o", "0O") else int(digits))
        if kind == "float":
            self.i += 1
            return A.Literal(float(value.replace("_", "").rstrip("fFdD")))
        if kind == "string":
            self.i += 1
            return A.Literal(self.unescape(value[1:-1]))
        if self.at("$"):
            return self.parameter()
        if self.at("["):
            return self.bracket()
        if self.at("{"):
            return self.map_literal()
        if self.at("("):
            return self.parenthesis()
        if kind == "name":
            return self.named()
        raise CypherSyntaxError(f"unexpected {value or 'end of the query'!r}", self.text, at)

    @staticmethod
    def unescape(s: str) -> str:
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), s, flags=re.S)

    def parameter(self) -> A.Parameter:
        self.need("$")
        if self.peek()[0] == "int":
            return A.Parameter(self.tokens[self.next()][1])
        return A.Parameter(self.name())

    def map_literal(self) -> A.MapLiteral:
        self.need("{")
        entries = () if self.at("}") else self.many(self.entry)
        self.need("}")
        return A.MapLiteral(entries)

    def entry(self) -> tuple[str, A.Node]:
        key = self.unescape(self.tokens[self.next()][1][1:-1]) if self.peek()[0] == "string" else self.name()
        self.need(":")
        return key, self.expression()

    def attempt(self, parse):
        """The result of ``parse``; None, and nothing taken, where it fails."""
        start, unnamed = self.i, self.unnamed
        try:
            return parse()
        except CypherSyntaxError:
            self.i, self.unnamed = start, unnamed
            return None

    def parenthesis(self) -> A.Node:
        def pattern():
            nodes, rels = self.element()
            if not rels:
                raise CypherSyntaxError("no pattern")
            return A.Exists((A.Match((A.PathPattern(None, nodes, rels),)),))

        def plain():
            self.need("(")
            value = self.expression()
            self.need(")")
            return value

        # (a)-[..]- can only be a pattern where a bracket, an arrow or a node follows
        found = self.attempt(pattern)
        return found if found is not None else plain()

    def bracket(self) -> A.Node:
        def comprehension():
            self.need("[")
            name = self.variable()
            self.need("IN")
            source = self.expression()
            where = self.expression() if self.take("WHERE") else None
            body = self.expression() if self.take("|") else None
            self.need("]")
            return A.Comprehension(name, source, where, body)

        def pattern():
            self.need("[")
            path = self.path()
            if not path.rels:
                raise CypherSyntaxError("no pattern")
            where = self.expression() if self.take("WHERE") else None
            self.need("|")
            body = self.expression()
            self.need("]")
            return A.PatternComprehension(path, where, body)

        if self.peek(1)[0] == "name" and self.at("IN", ahead=2):
            found = self.attempt(comprehension)
            if found is not None:
                return found
        if self.peek(1)[1] == "(" or self.peek(2)[1] == "=":
            found = self.attempt(pattern)
            if found is not None:
                return found
        self.need("[")
        items = () if self.at("]") else self.many(self.expression)
        self.need("]")
        return A.ListLiteral(items)

    def named(self) -> A.Node:
        word = self.peek()[1].upper()
        if word in ("TRUE", "FALSE"):
            self.i += 1
            return A.Literal(word == "TRUE")
        if word == "NULL":
            self.i += 1
            return A.Literal(None)
        if word in ("INF", "INFINITY", "NAN") and self.peek(1)[1] not in ("(", "."):
            self.i += 1
            return A.Literal(float("nan" if word == "NAN" else "inf"))
        if word == "CASE":
            return self.case()
        if word == "EXISTS" and self.peek(1)[1] == "{":
            return self.exists()
        if word in ("ALL", "ANY", "NONE", "SINGLE") and self.peek(1)[1] == "(" and self.at("IN", ahead=3):
            self.i += 2
            name = self.variable()
            self.need("IN")
            source = self.expression()
            self.need("WHERE")
            where = self.expression()
            self.need(")")
            return A.Quantifier(word.lower(), name, source, where)
        if word == "REDUCE" and self.peek(1)[1] == "(" and self.peek(3)[1] == "=":
            self.i += 2
            acc = self.variable()
            self.need("=")
            init = self.expression()
            self.need(",")
            name = self.variable()
            self.need("IN")
            source = self.expression()
            self.need("|")
            body = self.expression()
            self.need(")")
            return A.Reduce(acc, init, name, source, body)
        dotted, k = self.peek()[1], 1
        while self.peek(k)[1] == "." and self.peek(k + 1)[0] == "name":
            dotted += "." + self.peek(k + 1)[1]
            k += 2
        if self.peek(k)[1] == "(" and (k == 1 or dotted.lower() in ("date.truncate", "datetime.truncate", "localdatetime.truncate") or dotted.count(".") > 0):
            self.i += k + 1
            if self.take("*"):
                self.need(")")
                return A.Call(dotted, (), star=True)
            distinct = self.take("DISTINCT")
            return A.Call(dotted, self.arguments(), distinct)
        name = self.variable()
        if self.at("{"):
            found = self.attempt(lambda: self.map_projection(name))
            if found is not None:
                return found
        return A.Variable(name)

    def map_projection(self, name: str) -> A.MapProjection:
        self.need("{")

        def one():
            if self.take(".", "*") or self.at(".") and self.peek(1)[1] == "*":
                return (".*", None)
            if self.take("."):
                return (self.name(), None)
            key = self.name()
            return (key, self.expression()) if self.take(":") else (key, A.Variable(key))

        entries = () if self.at("}") else self.many(one)
        self.need("}")
        return A.MapProjection(name, entries)

    def case(self) -> A.Case:
        self.need("CASE")
        subject = None if self.at("WHEN") else self.expression()
        whens = []
        while self.take("WHEN"):
            operands = self.many(self.expression) if subject is not None else (self.expression(),)
            self.need("THEN")
            whens.append((operands, self.expression()))
        default = self.expression() if self.take("ELSE") else None
        self.need("END")
        if not whens:
            raise CypherSyntaxError("CASE without WHEN", self.text, self.peek()[2])
        return A.Case(subject, tuple(whens), default)

    def exists(self) -> A.Exists:
        self.need("EXISTS")
        self.need("{")
        if self.at("(") or self.peek()[0] == "name" and self.peek(1)[1] == "=":
            clauses: tuple = (self.match(False),)
        else:
            found = []
            while (clause := self.clause()) is not None:
                found.append(clause)
            clauses = tuple(found)
        self.need("}")
        return A.Exists(clauses)


@lru_cache(maxsize=1024)
def parse(text: str) -> A.Query:
    return Parser(text).query()
