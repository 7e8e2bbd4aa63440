"""Mapping expressions: Python arithmetic source, parsed with ast and compiled to Spark columns. Nothing is evaluated."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from photonflow.sources.shared import shared_dir


def erf(x: Column) -> Column:
    """Error function by Abramowitz and Stegun's approximation 7.1.26; absolute error at most 1.5e-7."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def floored_mod(a: Column, b: Column) -> Column:
    """numpy's %: the sign of the divisor; null where it is zero."""
    return F.when(b != 0, a - b * F.floor(a / F.when(b != 0, b)))


def safe_divide(a: Column, b: Column) -> Column:
    """A quotient that is null, not an error, where the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "exp": F.exp, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arctan2": F.atan2,
    "log": F.ln, "log10": F.log10, "log2": F.log2, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "round": F.bround, "rint": F.bround,
    "minimum": F.least, "maximum": F.greatest, "clip": lambda x, lo, hi: F.least(F.greatest(x, lo), hi), "where": lambda c, a, b: F.when(c.cast("boolean"), a).otherwise(b),
    "isnan": lambda x: F.isnan(x).cast("double"), "erf": erf, "hypot": F.hypot, "sign": F.signum,
}
_BINARY: dict[type, Callable] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: safe_divide,
    ast.FloorDiv: lambda a, b: F.floor(safe_divide(a, b)), ast.Mod: floored_mod, ast.Pow: F.pow,
}
_COMPARE: dict[type, Callable] = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def names(source: str) -> set[str]:
    """The names that an expression reads, functions aside."""
    tree = ast.parse(source.strip(), mode="eval")
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called - {"pi", "numpy", "np"}


#: Functions of a whole column, and of a whole column in the order of rows.
WHOLE: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}
ORDERED = ("cumsum", "diff")


def compile_expression(source: str, look: Callable[[str], Column], whole: Callable[[str, Callable[[], Column]], Column] | None = None) -> Column:
    """The column of an expression; `look` resolves names, `whole` functions of whole columns
    (given what builds their argument). Anything outside arithmetic, comparisons and FUNCTIONS
    raises ValueError, and so do whole columns without `whole`."""

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression():
                return build(node.body)
            case ast.Constant(value=bool() | int() | float()):
                return F.lit(float(node.value) if isinstance(node.value, bool) else node.value)
            case ast.Name(id="pi") | ast.Attribute(value=ast.Name(id="numpy" | "np"), attr="pi"):
                return F.lit(math.pi)
            case ast.Name():
                return look(node.id)
            case ast.UnaryOp(op=ast.USub()):
                return -build(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return build(node.operand)
            case ast.UnaryOp(op=ast.Not() | ast.Invert()):
                return (build(node.operand) == 0).cast("double")
            case ast.BinOp(op=ast.BitAnd() | ast.BitOr() as op):
                a, b = build(node.left) != 0, build(node.right) != 0
                return ((a & b) if isinstance(op, ast.BitAnd) else (a | b)).cast("double")
            case ast.BinOp() if type(node.op) in _BINARY:
                return _BINARY[type(node.op)](build(node.left), build(node.right))
            case ast.Compare():
                parts = [build(x) for x in (node.left, *node.comparators)]
                tests = [_COMPARE[type(op)](a, b) for op, a, b in zip(node.ops, parts, parts[1:], strict=False) if type(op) in _COMPARE]
                if len(tests) < len(node.ops):
                    raise ValueError(f"comparison not allowed in {source!r}")
                out = tests[0]
                for t in tests[1:]:
                    out = out & t
                return out.cast("double")
            case ast.Call(func=ast.Name(id=name) | ast.Attribute(value=ast.Name(id="numpy" | "np"), attr=name), keywords=[]) if name in FUNCTIONS:
                return FUNCTIONS[name](*map(build, node.args))
            case ast.Call(func=ast.Name(id=name) | ast.Attribute(value=ast.Name(id="numpy" | "np"), attr=name), args=[argument], keywords=[]) if whole and (name in WHOLE or name in ORDERED):
                return whole(name, lambda: build(argument))
            case ast.Call(func=ast.Name(id="piecewiseLinear"), keywords=[]) if len(node.args) == 3:
                return piecewise_linear(build(node.args[0]), *(ast.literal_eval(a) for a in node.args[1:]))
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:80]} in {source!r}")

    return build(ast.parse(source.strip(), mode="eval"))


def piecewise_linear(t: Column, knots: list[float], slopes: list[float]) -> Column:
    """Sum of a slope for each stretch between knots, from the first knot on; slopes[k] holds from knots[k]."""
    out = F.lit(0.0)
    for k, slope in enumerate(slopes):
        end = F.least(t, F.lit(float(knots[k + 1]))) if k + 1 < len(knots) else t
        out = out + slope * F.greatest(end - float(knots[k]), F.lit(0.0))
    return out


def with_mappings(df: DataFrame, mappings: Mapping[str, str], variables: Mapping[str, float] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """df with computed columns. A name means the source column, else a variable, else another mapping: so `x` in a new
    `x` is the source's. Circular mappings of any length raise ValueError, unknown names KeyError.

    mean, sum, min, max and std (of the population) of an expression are those of all rows, nulls aside. cumsum and diff go along `order` (columns that
    name each row; without them they raise ValueError): cumsum adds up to the row, nulls counting nothing, diff is the value less that of the row
    before, null in the first row. Each depth of nesting costs one pass, in which only one row, or a row a range of the order, meets in one place.
    """
    variables = variables or {}
    done: dict[str, Column] = {}
    levels: list[dict[str, tuple[str, Column]]] = []  # of whole columns: those of a level may read the ones of the levels before
    level_of: dict[str, int] = {}
    read: list[set[str]] = [set()]  # whole columns that what is being compiled reads, innermost last
    reads: dict[str, set[str]] = {}

    def look(name: str, path: tuple[str, ...]) -> Column:
        if name in df.columns:
            return F.col(f"`{name}`")
        if name in variables:
            return F.lit(float(variables[name]))
        if name not in mappings:
            raise KeyError(name)
        return resolve(name, path)

    def whole(function: str, argument: Callable[[], Column]) -> Column:
        if function in ORDERED and not order:
            raise ValueError(f"{function} needs an order of rows")
        read.append(set())
        column, inner = argument(), read.pop()
        name, level = f"_whole{len(level_of)}", 1 + max((level_of[n] for n in inner), default=-1)
        while len(levels) <= level:
            levels.append({})
        levels[level][name], level_of[name] = (function, column), level
        read[-1].add(name)
        return F.col(name)

    def resolve(name: str, path: tuple[str, ...] = ()) -> Column:
        if name in path:
            raise ValueError(f"circular mapping: {' -> '.join((*path, name))}")
        if name not in done:
            read.append(set())
            done[name] = compile_expression(mappings[name], lambda n: look(n, (*path, name)), whole)
            reads[name] = read.pop()
        read[-1] |= reads[name]
        return done[name]

    found = {name: resolve(name) for name in mappings}
    out = df
    for level in levels:
        out = _with_whole(out, level, order)
    return out.withColumns(found).drop(*(name for level in levels for name in level))


def _with_whole(df: DataFrame, columns: Mapping[str, tuple[str, Column]], order: Sequence[str]) -> DataFrame:
    """df with columns (name: function, argument) of whole columns beside every row."""
    totals = {n: WHOLE[f](a) for n, (f, a) in columns.items() if f in WHOLE}
    if totals:
        df = df.join(F.broadcast(df.agg(*(v.alias(n) for n, v in totals.items()))), how="cross")  # one row
    along = {n: (f, a) for n, (f, a) in columns.items() if f in ORDERED}
    if not along:
        return df
    shared_dir(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.withColumns({f"{n}_v": a for n, (_, a) in along.items()}).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    inside, place = Window.partitionBy("_part").orderBy(*order), F.struct(*(F.col(c) for c in order))
    told = held.groupBy("_part").agg(*(F.sum(f"{n}_v").alias(f"{n}_s") if f == "cumsum" else F.max_by(F.struct(f"{n}_v"), place).alias(f"{n}_s") for n, (f, _) in along.items()))
    ranges = Window.orderBy("_part")  # a row a range
    told = told.select("_part", *((F.sum(f"{n}_s").over(ranges.rowsBetween(Window.unboundedPreceding, -1)) if f == "cumsum" else F.lag(f"{n}_s").over(ranges)).alias(f"{n}_b") for n, (f, _) in along.items()))
    joined, out = held.join(F.broadcast(told), "_part"), {}
    for n, (f, _) in along.items():
        value = F.col(f"{n}_v")
        if f == "cumsum":
            out[n] = F.coalesce(F.col(f"{n}_b"), F.lit(0.0)) + F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
        else:
            out[n] = value - F.coalesce(F.lag(F.struct(value)).over(inside), F.col(f"{n}_b"))[f"{n}_v"]
    return joined.withColumns(out).select(*df.columns, *out)
