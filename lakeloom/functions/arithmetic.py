"""Arithmetic text evaluated as a column, without evaluating code."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def two_operand(expr: Column) -> Column:
    """The value of ``a op b`` with op one of + - * /, or a lone number; null for any other text or a zero divisor."""
    pattern = rf"^\s*(-?{_NUMBER})\s*(?:([-+*/])\s*(-?{_NUMBER})\s*)?$"
    a, op, b = (F.regexp_extract(expr, pattern, i) for i in (1, 2, 3))
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(op == "+", x + y).when(op == "-", x - y).when(op == "*", x * y).when(op == "/", F.try_divide(x, y)).when(op == "", x)


#: A token of arithmetic: a number, an operator or a bracket.
_TOKEN = rf"{_NUMBER}|//|[-+*/%()]"


def evaluated(text: Column) -> Column:
    """The value of an arithmetic text in a column: numbers, + - * / // %, signs and brackets, in doubles.

    A fold over the text's tokens in the JVM. A bracket's state is what its sum and its product
    have come to and what waits for the next operand; opening one puts it on a stack. Null for
    a null or empty text, for anything that is not such arithmetic, and for a division by
    zero; nothing is evaluated as code. // rounds down, and % has the divisor's sign.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))
    # nothing but tokens and blanks, and no blank inside a number
    proper = F.array_join(tokens, "") == F.regexp_replace(text, r"\s+", "")
    proper &= ~text.rlike(r"[0-9.]\s+[0-9.]|/\s+/")
    zero, one = F.lit(0.0), F.lit(1.0)
    frame = lambda total, minus, product, op, sign: F.struct(total.alias("total"), minus.alias("minus"), product.alias("product"), op.alias("op"), sign.alias("sign"))
    fresh = frame(zero, F.lit(False), zero, F.lit(""), one)
    state = lambda top, below, operand, ok: F.struct(top.alias("top"), below.alias("below"), operand.alias("operand"), ok.alias("ok"))
    value = lambda f: F.when(f["minus"], f["total"] - f["product"]).otherwise(f["total"] + f["product"])

    def taken(f: Column, v: Column) -> Column:
        """The frame after an operand."""
        x = f["sign"] * v
        whole = F.floor(F.try_divide(f["product"], x)).cast("double")
        p = F.when(f["op"] == "*", f["product"] * x).when(f["op"] == "/", F.try_divide(f["product"], x)).when(f["op"] == "//", whole).when(f["op"] == "%", f["product"] - x * whole).otherwise(x)
        return frame(f["total"], f["minus"], p, F.lit(""), one)

    def step(s: Column, t: Column) -> Column:
        f, below, depth = s["top"], s["below"], F.size(s["below"])
        bad = state(f, below, s["operand"], F.lit(False))
        signed = state(frame(f["total"], f["minus"], f["product"], f["op"], F.when(t == "-", -f["sign"]).otherwise(f["sign"])), below, F.lit(True), s["ok"])
        opened = state(fresh, F.concat(below, F.array(f)), F.lit(True), s["ok"])
        number = state(taken(f, t.try_cast("double")), below, F.lit(False), s["ok"])
        added = state(frame(value(f), t == "-", zero, F.lit(""), one), below, F.lit(True), s["ok"])
        scaled = state(frame(f["total"], f["minus"], f["product"], t, one), below, F.lit(True), s["ok"])
        closed = state(taken(F.get(below, depth - 1), value(f)), F.slice(below, F.lit(1), F.greatest(depth - 1, F.lit(0))), F.lit(False), s["ok"])
        first = F.when(t.isin("+", "-"), signed).when(t == "(", opened).when(t.isin("*", "/", "//", "%", ")"), bad).otherwise(number)
        then = F.when(t.isin("+", "-"), added).when(t.isin("*", "/", "//", "%"), scaled).when((t == ")") & (depth > 0), closed).otherwise(bad)
        return F.when(~s["ok"], s).when(s["operand"], first).otherwise(then)

    start = state(fresh, F.array_remove(F.array(fresh), fresh), F.lit(True), F.lit(True))
    done = lambda s: F.when(s["ok"] & ~s["operand"] & (F.size(s["below"]) == 0), value(s["top"]))
    return F.when(proper, F.aggregate(tokens, start, step, done))


_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide,
    ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b)), ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)).cast("double"), ast.Pow: F.pow,
}


def expression(text: str, **names: Column) -> Column:
    """The column that an arithmetic text stands for: numbers, ``names``, + - * / // % **, signs and brackets, in doubles.

    Anything else in the text is an error when the plan is made; nothing is evaluated as
    code. Division by zero gives null.
    """

    def of(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=n) if n in names:
                return names[n].cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -of(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return of(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](of(a), of(b))
        raise ValueError(f"not arithmetic: {text!r}")

    try:
        return of(ast.parse(text.strip(), mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"not arithmetic: {text!r}") from e
