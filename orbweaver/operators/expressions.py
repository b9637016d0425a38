"""Rule expressions: a small, safe language compiled to columns once, on the driver.

The grammar is that of Python expressions, cut down by an allow-list. Null follows rules of its own:
ordered comparisons and membership with a null side are false, arithmetic with a null side or of
unfitting types is null, equality treats null as a value, and `and`/`or` yield an operand.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LENGTH = 2000
FUNCTIONS = ("min", "max", "abs", "round", "len", "lower", "upper", "date", "coalesce", "days_until", "days_since", "today", "add_days", "str")
MAX_DAYS = 36_600

_NODES = """Expression IfExp Call Compare BoolOp BinOp UnaryOp Constant Name Subscript Attribute Tuple List Load Or And
 USub Not UAdd Mod FloorDiv Div Mult Sub Add IsNot Is NotIn In GtE Gt LtE Lt NotEq Eq"""
_ALLOWED = tuple(getattr(ast, n) for n in _NODES.split())


class ExpressionError(ValueError):
    """An expression is not of the language."""


@dataclass(frozen=True)
class Typed:
    """A column with what the compiler knows of its type: number, string, boolean, date, list, struct or null."""

    col: Column
    kind: str
    type: T.DataType | None = None
    items: tuple["Typed", ...] | None = None  # of a list written out


def parse(source: str) -> ast.Expression:
    """The checked tree of an expression."""
    if len(source) > MAX_LENGTH:
        raise ExpressionError(f"an expression has {MAX_LENGTH} characters at most")
    try:
        tree = ast.parse("\n".join(source.split("\n")).strip(), "<rule>", "eval")
    except (SyntaxError, ValueError) as e:
        raise ExpressionError(f"not an expression: {e}") from e
    for n in ast.walk(tree):
        if not isinstance(n, _ALLOWED):
            raise ExpressionError(f"{type(n).__name__} is not allowed")
        name = n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else ""
        if name.startswith("_"):
            raise ExpressionError(f"the name {name} is not allowed")
        if isinstance(n, ast.Call) and (not isinstance(n.func, ast.Name) or n.func.id not in FUNCTIONS or n.keywords):
            raise ExpressionError("only the language's own functions may be called, by place")
    return tree


def fields(source: str) -> set[str]:
    """The facts that an expression reads."""
    tree = parse(source)
    every = list(ast.walk(tree))
    called = {id(x.func) for x in every if isinstance(x, ast.Call)}
    return {x.id for x in every if type(x) is ast.Name and id(x) not in called}


def _kind(t: T.DataType | None) -> str:
    if t is None or isinstance(t, T.NullType):
        return "null"
    for kinds, name in (((T.BooleanType,), "boolean"), ((T.NumericType,), "number"), ((T.StringType,), "string"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "date"), ((T.ArrayType,), "list"), ((T.StructType, T.MapType), "struct")):
        if isinstance(t, kinds):
            return name
    return "other"


def null() -> Typed:
    """A fact that is not there. Made on call: a literal needs a session."""
    return Typed(F.lit(None), "null")


def truth(x: Typed) -> Column:
    """Whether a value counts as true: not null, zero, empty or false."""
    if x.kind == "null":
        return F.lit(False)
    if x.kind == "boolean":
        return F.coalesce(x.col, F.lit(False))
    if x.kind == "number":
        return F.coalesce(x.col != 0, F.lit(False))
    if x.kind == "string":
        return F.coalesce(x.col != "", F.lit(False))
    if x.kind == "list":
        return F.coalesce(F.size(x.col) > 0, F.lit(False))
    return x.col.isNotNull()


def _num(x: Typed) -> Column:
    return x.col.cast("double") if x.kind in ("number", "boolean") else F.lit(None).cast("double")


def _whole(t: T.DataType | None) -> bool:
    return isinstance(t, T.IntegralType)


class Compiler:
    """Compiles expressions over the columns of a schema; ``today`` is fixed, so results repeat."""

    def __init__(self, schema: T.StructType, today: date, scope: dict[str, Typed] | None = None) -> None:
        self.schema, self.today, self.scope = schema, today, dict(scope or {})

    def compile(self, source: str) -> Typed:
        return self._node(parse(source).body)

    def condition(self, source: str) -> Column:
        """Whether a rule holds; never null."""
        return truth(self.compile(source))

    def field(self, name: str) -> Typed:
        if name in self.scope:
            return self.scope[name]
        if name in self.schema.names:
            t = self.schema[name].dataType
            return Typed(F.col(f"`{name}`"), _kind(t), t)
        return null()  # a fact that nothing gave

    def _node(self, n: ast.AST) -> Typed:
        return getattr(self, f"_{type(n).__name__.lower()}")(n)

    def _constant(self, n: ast.Constant) -> Typed:
        v = n.value
        if v is None:
            return null()
        if isinstance(v, bool):
            return Typed(F.lit(v), "boolean", T.BooleanType())
        if isinstance(v, int):
            return Typed(F.lit(v).cast("long"), "number", T.LongType())
        if isinstance(v, float):
            return Typed(F.lit(v), "number", T.DoubleType())
        if isinstance(v, str):
            return Typed(F.lit(v), "string", T.StringType())
        raise ExpressionError(f"a constant of type {type(v).__name__} is not allowed")

    def _name(self, n: ast.Name) -> Typed:
        return self.field(n.id)

    def _list(self, n: ast.List | ast.Tuple) -> Typed:
        items = tuple(self._node(e) for e in n.elts)
        real = [i for i in items if i.kind != "null"]
        if not items:
            return Typed(F.array().cast("array<string>"), "list", T.ArrayType(T.StringType()), ())
        t = (T.DoubleType() if real and real[0].kind == "number" else real[0].type) if real else T.StringType()
        return Typed(F.array(*[i.col.cast(t) for i in items]), "list", T.ArrayType(t), items)

    _tuple = _list

    def _get(self, x: Typed, key: str) -> Typed:
        if isinstance(x.type, T.StructType) and key in x.type.names:
            t = x.type[key].dataType
            return Typed(x.col.getField(key), _kind(t), t)
        if isinstance(x.type, T.MapType):
            return Typed(F.try_element_at(x.col, F.lit(key)), _kind(x.type.valueType), x.type.valueType)
        return null()

    def _attribute(self, n: ast.Attribute) -> Typed:
        return self._get(self._node(n.value), n.attr)

    def _subscript(self, n: ast.Subscript) -> Typed:
        x = self._node(n.value)
        key = n.slice
        sign = -1 if isinstance(key, ast.UnaryOp) and isinstance(key.op, ast.USub) else 1
        if sign < 0:
            key = key.operand
        if not isinstance(key, ast.Constant):
            raise ExpressionError("a subscript must be a constant")
        if isinstance(key.value, str):
            return self._get(x, key.value)
        if isinstance(x.type, T.ArrayType) and isinstance(key.value, int):
            i = sign * key.value
            return Typed(F.try_element_at(x.col, F.lit(i + 1 if i >= 0 else i)), _kind(x.type.elementType), x.type.elementType)
        return null()

    def _boolop(self, n: ast.BoolOp) -> Typed:
        parts = [self._node(v) for v in n.values]
        return reduce(lambda a, b: self._pick(truth(a), b, a) if isinstance(n.op, ast.And) else self._pick(truth(a), a, b), parts)

    @staticmethod
    def _pick(test: Column, yes: Typed, no: Typed) -> Typed:
        if yes.kind == no.kind or "null" in (yes.kind, no.kind):
            real = no if yes.kind == "null" else yes
            wide = T.DoubleType() if real.kind == "number" and "null" not in (yes.kind, no.kind) and yes.type != no.type else real.type
            cast = (lambda c: c.cast(wide)) if wide is not None else (lambda c: c)
            return Typed(F.when(test, cast(yes.col)).otherwise(cast(no.col)), real.kind, wide)
        return Typed(F.when(test, truth(yes)).otherwise(truth(no)), "boolean", T.BooleanType())  # of mixed types only the truth is kept

    def _unaryop(self, n: ast.UnaryOp) -> Typed:
        x = self._node(n.operand)
        if isinstance(n.op, ast.Not):
            return Typed(~truth(x), "boolean", T.BooleanType())
        if x.kind not in ("number", "boolean"):
            return null()
        return Typed(-x.col if isinstance(n.op, ast.USub) else x.col, "number", x.type)

    def _binop(self, n: ast.BinOp) -> Typed:
        a, b = self._node(n.left), self._node(n.right)
        if isinstance(n.op, ast.Add) and a.kind == b.kind == "string":
            return Typed(F.concat(a.col, b.col), "string", T.StringType())
        if isinstance(n.op, ast.Sub) and a.kind == b.kind == "date":
            return Typed(F.datediff(a.col, b.col).cast("long"), "number", T.LongType())
        if not {a.kind, b.kind} <= {"number", "boolean"}:
            return null()
        whole = _whole(a.type) and _whole(b.type) and not isinstance(n.op, ast.Div)
        x, y = (a.col.cast("long"), b.col.cast("long")) if whole else (_num(a), _num(b))
        safe = F.when(y != 0, y)
        if isinstance(n.op, ast.FloorDiv):
            c = F.floor(x / safe)
        elif isinstance(n.op, ast.Mod):
            c = x - safe * F.floor(x / safe)  # the sign of the divisor
        elif isinstance(n.op, ast.Div):
            c = x / safe
        else:
            f = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[type(n.op)]
            c = f(x, y)
        t = T.LongType() if whole else T.DoubleType()
        return Typed(c.cast(t), "number", t)

    def _compare(self, n: ast.Compare) -> Typed:
        left, parts = self._node(n.left), []
        for op, right in zip(n.ops, n.comparators, strict=True):
            r = self._node(right)
            parts.append(self._one(op, left, r))
            left = r
        return Typed(reduce(lambda a, b: a & b, parts), "boolean", T.BooleanType())

    def _one(self, op: ast.cmpop, a: Typed, b: Typed) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            inside = self._inside(a, b)
            return inside if isinstance(op, ast.In) else F.coalesce(a.col.isNotNull() & b.col.isNotNull() & ~inside, F.lit(False)) if b.kind != "null" and a.kind != "null" else F.lit(False)
        same_type = a.kind == b.kind or {a.kind, b.kind} <= {"number", "boolean"}
        x, y = (_num(a), _num(b)) if {a.kind, b.kind} <= {"number", "boolean"} and a.kind + b.kind != "booleanboolean" else (a.col, b.col)
        if isinstance(op, (ast.Eq, ast.Is, ast.NotEq, ast.IsNot)):
            if "null" in (a.kind, b.kind):
                equal = a.col.isNull() if b.kind == "null" else b.col.isNull()
            else:
                equal = x.eqNullSafe(y) if same_type else a.col.isNull() & b.col.isNull()
            return equal if isinstance(op, (ast.Eq, ast.Is)) else ~equal
        if not same_type:
            return F.lit(False)
        c = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]
        return F.coalesce(c, F.lit(False))

    def _inside(self, a: Typed, b: Typed) -> Column:
        if "null" in (a.kind, b.kind):
            return F.lit(False)
        if b.items is not None:
            hits = [self._one(ast.Eq(), a, i) for i in b.items if i.kind != "null"]
            return F.coalesce(a.col.isNotNull() & reduce(lambda x, y: x | y, hits, F.lit(False)), F.lit(False))
        if b.kind == "list":
            return F.coalesce(F.exists(b.col, lambda e: e == a.col), F.lit(False))
        if b.kind == a.kind == "string":
            return F.coalesce(F.contains(b.col, a.col), F.lit(False))
        if isinstance(b.type, T.MapType):
            return F.coalesce(F.map_contains_key(b.col, a.col), F.lit(False))
        return F.lit(False)

    def _ifexp(self, n: ast.IfExp) -> Typed:
        return self._pick(truth(self._node(n.test)), self._node(n.body), self._node(n.orelse))

    def _date(self, x: Typed) -> Column:
        if x.kind == "date":
            return x.col.cast("date")
        if x.kind == "string":
            return F.coalesce(F.try_to_date(x.col), F.try_to_date(F.left(x.col, F.lit(10)), "yyyy-MM-dd"))
        return F.lit(None).cast("date")

    def _call(self, n: ast.Call) -> Typed:
        name, args = n.func.id, [self._node(a) for a in n.args]
        number = lambda c, t=None: Typed(c, "number", t or T.DoubleType())
        day = F.lit(self.today).cast("date")
        if name in ("min", "max"):
            if len(args) == 1 and args[0].kind == "list":
                c = F.array_min(args[0].col) if name == "min" else F.array_max(args[0].col)
                t = args[0].type.elementType
                return Typed(c, _kind(t), t)
            real = [a for a in args if a.kind == "number"]
            if not real:
                return null()
            if len(real) == 1:
                return real[0]
            whole = all(_whole(a.type) for a in real)
            cols = [a.col if whole else _num(a) for a in real]
            return number(F.least(*cols) if name == "min" else F.greatest(*cols), T.LongType() if whole else None)
        if name == "coalesce":
            real = [a for a in args if a.kind != "null"]
            if not real:
                return null()
            t = T.DoubleType() if real[0].kind == "number" and len({str(a.type) for a in real}) > 1 else real[0].type
            return Typed(F.coalesce(*[a.col.cast(t) for a in real if a.kind == real[0].kind]), real[0].kind, t)
        if name == "today":
            return Typed(day, "date", T.DateType())
        x = args[0] if args else null()
        if name == "abs":
            return number(F.abs(x.col), x.type) if x.kind == "number" else null()
        if name == "round":
            places = n.args[1].value if len(n.args) > 1 and isinstance(n.args[1], ast.Constant) else 0
            return number(F.bround(_num(x), places)) if x.kind == "number" else null()
        if name == "len":
            return number(F.length(x.col).cast("long") if x.kind == "string" else F.size(x.col).cast("long"), T.LongType()) if x.kind in ("string", "list") else null()
        if name in ("lower", "upper"):
            c = x.col.cast("string")
            return Typed(F.lower(c) if name == "lower" else F.upper(c), "string", T.StringType())
        if name == "date":
            return Typed(self._date(x), "date", T.DateType())
        if name in ("days_until", "days_since"):
            d = self._date(x)
            return number((F.datediff(d, day) if name == "days_until" else F.datediff(day, d)).cast("long"), T.LongType())
        if name == "add_days":
            if len(args) < 2 or not _whole(args[1].type):
                return Typed(F.lit(None).cast("date"), "date", T.DateType())
            days = F.when(F.abs(args[1].col) <= MAX_DAYS, args[1].col.cast("int"))
            return Typed(F.date_add(self._date(x), days), "date", T.DateType())
        return Typed(x.col.cast("string"), "string", T.StringType())


def compile_column(source: str, schema: T.StructType, today: date) -> Column:
    """An expression as a column over a schema."""
    return Compiler(schema, today).compile(source).col
