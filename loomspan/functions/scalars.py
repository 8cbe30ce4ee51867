"""Small functions of the engine: sizes, times, progress, versions, arithmetic."""

from __future__ import annotations

import ast
import math
import operator
import pprint
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"K": 1024, "M": 1024**2, "G": 1024**3}
_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg}
LONGEST, LARGEST = 30, 1e6


def size_bytes(text: str) -> int:
    """``10G``, ``500M``, ``50K`` in bytes; units are upper case."""
    unit = _UNITS.get(text[-1:])
    try:
        if unit is None:
            raise ValueError
        return int(unit * float(text[:-1]))
    except ValueError:
        raise ValueError(f"not a size such as 10G, 500M or 50K: {text!r}") from None


def size_bytes_col(text: Column) -> Column:
    unit = F.right(text, F.lit(1))
    value = F.left(text, F.char_length(text) - 1).cast("double")
    return (value * F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3)).cast("long")


def disk_used(spark, path: str) -> int:
    """KiB below a path, on any file system that Spark reads; 0 where nothing is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return -(-files.getContentSummary(at).getLength() // 1024) if files.exists(at) else 0


def long_time(seconds: float) -> str:
    return f"{seconds:.1f}s, {seconds / 60:.1f}min"


def short_time(seconds: float) -> str:
    return f"{seconds / 60:4.1f}min" if seconds > 60 else f" {seconds:5.1f}s"


def pretty(value: object, depth: int = 3) -> str:
    return pprint.pformat(value, depth=depth, indent=1)


def is_silent(index: int, verbose: int) -> bool:
    """Whether the progress line of task ``index`` is left out at this verbosity."""
    if not verbose:
        return True
    if verbose > 10 or index == 0:
        return False
    scale = 0.5 * (11 - verbose) ** 2
    return int(math.sqrt(index / scale)) == int(math.sqrt((index + 1) / scale))


def is_silent_col(index: Column, verbose: int) -> Column:
    if not verbose:
        return F.lit(True)
    if verbose > 10:
        return F.lit(False)
    scale = 0.5 * (11 - verbose) ** 2
    return (index != 0) & (F.floor(F.sqrt(index / F.lit(scale))) == F.floor(F.sqrt((index + 1) / F.lit(scale))))


def remaining_time(elapsed: Column, done: Column, dispatched: Column) -> Column:
    return elapsed / F.greatest(done, F.lit(1)) * (dispatched - done)


def version_parts(text: str) -> list:
    """Numbers and words of a version, for comparison."""
    found = re.finditer(r"(?P<number>[0-9]+)|[a-z]+|[^0-9a-z.]+", text)
    return [int(m[0]) if m["number"] else m[0] for m in found]


def version_less(a: str, b: str) -> bool:
    x, y = ([(isinstance(p, int), p) for p in version_parts(v)] for v in (a, b))
    return x < y


def version_key(text: Column) -> Column:
    """Numeric parts of a version as an array that compares like the version."""
    return F.transform(F.split(text, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(-1)))


def stored_first_line(code: Column) -> Column:
    """Line number in the header that stored code begins with; -1 without one."""
    n = F.regexp_extract(code, r"^# first line: (-?\d+)", 1)
    return F.when(n == "", -1).otherwise(n.try_cast("int"))


def arithmetic(text: str) -> float:
    """Value of an arithmetic expression of numbers with + - * / // % ** and minus signs."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            out = node.value
        elif isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            out = _OPERATORS[type(node.op)](value(node.left), value(node.right))
        elif isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            out = _OPERATORS[type(node.op)](value(node.operand))
        else:
            raise ValueError("only numbers and arithmetic signs are allowed")
        if isinstance(out, complex) or abs(out) > LARGEST:
            raise ValueError("a value is too large")
        return out

    if len(text) > LONGEST:
        raise ValueError(f"expression longer than {LONGEST} characters: {text[:LONGEST]}...")
    try:
        return value(ast.parse(text, mode="eval").body)
    except (SyntaxError, ZeroDivisionError, OverflowError, TypeError, ValueError) as e:
        raise ValueError(f"not an arithmetic expression: {text!r} ({e})") from e
