"""The formula language of a spreadsheet grid: parsed once, evaluated on the driver or compiled to a column.

    formula    = comparison
    comparison = sum (("=" | "==" | ">" | "<" | ">=" | "<=") sum)*
    sum        = product (("+" | "-") product)*
    product    = unary (("*" | "/") unary)*
    unary      = "-" unary | primary
    primary    = number | cell | NAME "(" [argument ("," argument)*] ")" | "(" comparison ")"
    argument   = cell ":" cell | comparison

Values are doubles; what has no value is NaN. A quotient by zero is +Infinity. Comparisons are 1 or 0, NaN compares as
false, equality allows for the machine epsilon. SUM, AVG, MIN and MAX take numbers and ranges (row by row), MIN and MAX skip NaN and are +Infinity and -Infinity over nothing else; IF takes
three arguments and evaluates one branch. An unknown function is NaN.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.graph import Cell, Runtime

NAN, INF, EPSILON = math.nan, math.inf, sys.float_info.epsilon
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z]+\d+)(?![A-Za-z0-9(])|([A-Za-z_][A-Za-z_0-9]*)|(==|>=|<=|[-+*/()=<>,:]))")


class FormulaError(ValueError):
    """Text that is no formula."""


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Ref:
    cell: str


@dataclass(frozen=True)
class Range:
    cells: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    name: str  # "neg", an operator, or a function's name in capitals
    args: tuple


Expr = Number | Ref | Range | Op


def cell_name(column: int, row: int) -> str:
    letters = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        letters = chr(65 + r) + letters
    return f"{letters}{row}"


def cell_place(name: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", name.upper()).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return column - 1, int(digits)


def cell_range(a: str, b: str) -> Range:
    (c1, r1), (c2, r2) = cell_place(a), cell_place(b)
    return Range(tuple(cell_name(c, r) for r in range(min(r1, r2), max(r1, r2) + 1) for c in range(min(c1, c2), max(c1, c2) + 1)))


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(f"unexpected {text[at:].strip()[:1]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[int, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else (0, "")

    def take(self, *texts: str) -> str | None:
        if self.peek()[0] == 4 and self.peek()[1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise FormulaError(f"expected {text!r}")

    def chain(self, below: Callable[[], Expr], *ops: str) -> Expr:
        left = below()
        while op := self.take(*ops):
            left = Op("=" if op == "==" else op, (left, below()))
        return left

    def comparison(self) -> Expr:
        return self.chain(self.sum, "=", "==", ">", "<", ">=", "<=")

    def sum(self) -> Expr:
        return self.chain(self.product, "+", "-")

    def product(self) -> Expr:
        return self.chain(self.unary, "*", "/")

    def unary(self) -> Expr:
        return Op("neg", (self.unary(),)) if self.take("-") else self.primary()

    def primary(self) -> Expr:
        kind, text = self.peek()
        if kind == 1:
            self.at += 1
            return Number(float(text))
        if kind == 2:
            self.at += 1
            return Ref(text.upper())
        if kind == 3:
            self.at += 1
            self.need("(")
            args = []
            if not self.take(")"):
                args.append(self.argument())
                while self.take(","):
                    args.append(self.argument())
                self.need(")")
            return Op(text.upper(), tuple(args))
        self.need("(")
        inner = self.comparison()
        self.need(")")
        return inner

    def argument(self) -> Expr:
        if self.peek()[0] == 2 and self.peek(1) == (4, ":") and self.peek(2)[0] == 2:
            a, b = self.peek()[1], self.peek(2)[1]
            self.at += 3
            return cell_range(a, b)
        return self.comparison()


def parse(text: str) -> Expr:
    """The tree of a formula without its leading "="."""
    p = _Parser(text)
    tree = p.comparison()
    if p.at < len(p.tokens):
        raise FormulaError(f"unexpected {p.peek()[1]!r}")
    return tree


# --- on the driver


def evaluate(tree: Expr, value_of: Callable[[str], float]) -> float:
    """The value of a tree; ``value_of`` gives a cell's value (NaN if unknown)."""
    match tree:
        case Number(v):
            return v
        case Ref(c):
            return value_of(c)
        case Range():
            return NAN
        case Op("neg", (a,)):
            return -evaluate(a, value_of)
        case Op("IF", args):
            if len(args) != 3:
                return NAN
            test = evaluate(args[0], value_of)
            return evaluate(args[1 if test != 0 and not math.isnan(test) else 2], value_of)
        case Op(name, (a, b)) if name in _BINARY:
            return _BINARY[name](evaluate(a, value_of), evaluate(b, value_of))
        case Op(name, args):
            values = [value_of(c) for a in args for c in a.cells] if all(isinstance(a, Range) for a in args) else [
                v for a in args for v in ([value_of(c) for c in a.cells] if isinstance(a, Range) else [evaluate(a, value_of)])]
            real = [v for v in values if not math.isnan(v)]
            if name == "SUM":
                return float(sum(values))
            if name == "AVG":
                return sum(values) / len(values) if values else NAN
            if name in ("MIN", "MAX"):
                none = INF if name == "MIN" else -INF
                return (min if name == "MIN" else max)(real, default=none)
            return NAN
    raise TypeError(tree)


_BINARY: dict[str, Callable[[float, float], float]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: INF if b == 0 else a / b,
    ">": lambda a, b: float(a > b),
    "<": lambda a, b: float(a < b),
    ">=": lambda a, b: float(a >= b),
    "<=": lambda a, b: float(a <= b),
    "=": lambda a, b: float(abs(a - b) < EPSILON),
}


# --- as columns


def compile_formula(tree: Expr | str, columns: Mapping[str, Column | str]) -> Column:
    """A tree as a column of doubles; ``columns`` maps cell names to columns (unknown: NaN; a null value counts as an empty cell, 0)."""
    if isinstance(tree, str):
        tree = parse(tree.removeprefix("="))
    nan = F.lit(NAN)

    def cell(c: str) -> Column:
        if c not in columns:
            return nan
        found = columns[c]
        return F.coalesce((F.col(found) if isinstance(found, str) else found).cast("double"), F.lit(0.0))

    def truth(test: Column) -> Column:
        return F.when(test, 1.0).otherwise(0.0)

    def go(t: Expr) -> Column:
        match t:
            case Number(v):
                return F.lit(v)
            case Ref(c):
                return cell(c)
            case Range():
                return nan
            case Op("neg", (a,)):
                return -go(a)
            case Op("IF", args):
                if len(args) != 3:
                    return nan
                test = go(args[0])
                return F.when((test != 0) & ~F.isnan(test), go(args[1])).otherwise(go(args[2]))
            case Op(name, (a, b)) if name in _BINARY:
                x, y = go(a), go(b)
                real = ~F.isnan(x) & ~F.isnan(y)
                match name:
                    case "+":
                        return x + y
                    case "-":
                        return x - y
                    case "*":
                        return x * y
                    case "/":
                        # the divisor is guarded inside the branch too: a plain zero would raise
                        return F.when(y == 0, F.lit(INF)).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))
                    case "=":
                        return truth(real & (F.abs(x - y) < EPSILON))
                    case ">":
                        return truth(real & (x > y))
                    case "<":
                        return truth(real & (x < y))
                    case ">=":
                        return truth(real & (x >= y))
                    case _:
                        return truth(real & (x <= y))
            case Op(name, args):
                values = [v for a in args for v in ([cell(c) for c in a.cells] if isinstance(a, Range) else [go(a)])]
                if name == "SUM":
                    return sum(values, F.lit(0.0))
                if name == "AVG":
                    return sum(values, F.lit(0.0)) / F.lit(float(len(values))) if values else nan
                if name in ("MIN", "MAX"):
                    if not values:
                        return F.lit(INF if name == "MIN" else -INF)
                    # null for NaN, which least and greatest skip
                    held = [F.when(~F.isnan(v), v) for v in values] + [F.lit(None).cast("double")]
                    return F.coalesce((F.least if name == "MIN" else F.greatest)(*held), F.lit(INF if name == "MIN" else -INF))
                return nan
        raise TypeError(t)

    return go(tree)


class Sheet:
    """A grid of cells on a runtime: contents are inputs, values are queries that parse and read as they need."""

    def __init__(self, runtime: Runtime, columns: int = 10, rows: int = 20):
        self.runtime = runtime
        names = [cell_name(c, r) for r in range(1, rows + 1) for c in range(columns)]
        self.contents: dict[str, Cell] = {n: runtime.create_input("", label=f"{n} content") for n in names}
        self.values: dict[str, Cell] = {n: runtime.create_query(self._compute(n), label=n) for n in names}

    def _compute(self, name: str) -> Callable[[Runtime], float]:
        def compute(rt: Runtime) -> float:
            text = rt.get(self.contents[name]).strip()
            if not text:
                return 0.0
            if not text.startswith("="):
                try:
                    return float(text)
                except ValueError:
                    return NAN
            try:
                tree = parse(text[1:])
            except FormulaError:
                return NAN
            return evaluate(tree, lambda c: rt.get(self.values[c]) if c in self.values else NAN)

        return compute

    def set(self, name: str, content: str) -> None:
        self.runtime.set(self.contents[name.upper()], content)

    def value(self, name: str) -> float:
        """NaN for a cycle or a failure."""
        try:
            return self.runtime.get(self.values[name.upper()])
        except RuntimeError:
            return NAN

    def update(self, name: str, content: str) -> dict[str, float]:
        """Set a cell and give the values that changed by it."""
        before = {n: self.value(n) for n in self.values}
        self.set(name, content)
        after = {n: self.value(n) for n in self.values}
        return {n: v for n, v in after.items() if v != before[n] and not (math.isnan(v) and math.isnan(before[n]))}
