"""Column expressions that Spark has under other rules than the engine needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format3(x: float) -> str:
    """A number with 3 significant digits, in scientific notation where that is shorter: 1e+03."""
    return f"{x:.3g}"


def interval_labels(breaks: list[float]) -> list[str]:
    """Labels of left-closed intervals, the last closed on both sides."""
    last = len(breaks) - 2
    return [f"[{format3(a)},{format3(b)}{']' if i == last else ')'}" for i, (a, b) in enumerate(zip(breaks, breaks[1:]))]


def cut(x: Column, breaks: list[float]) -> Column:
    """The label of the interval that holds x; null outside all."""
    out, last = F.when(F.lit(False), ""), len(breaks) - 2
    for i, (a, b, label) in enumerate(zip(breaks, breaks[1:], interval_labels(breaks))):
        out = out.when((x >= a) & ((x <= b) if i == last else (x < b)), label)
    return out


def concat_skipping_nulls(*parts: Column | str) -> Column:
    """Concatenation in which a null is nothing."""
    return F.concat_ws("", *parts)


def interpolate(x: Column, knots: list[tuple[float, float]], clamp: bool = True) -> Column:
    """Piecewise linear through ``knots`` (ascending in x); outside them the end value, or null."""
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    (x0, y0), (xn, yn) = knots[0], knots[-1]
    out = out.when(x < x0, F.lit(float(y0) if clamp else None).cast("double")).when(x > xn, F.lit(float(yn) if clamp else None).cast("double"))
    for (a, ya), (b, yb) in zip(knots, knots[1:]):
        out = out.when(x <= b, F.lit(float(ya)) + (x - F.lit(float(a))) * F.lit((yb - ya) / (b - a)))
    return out


def score_of(scores: Column, name: str, numeric: bool = True) -> Column:
    """An entry of a map of strings: as a number, or as the string it is (whose order is lexicographic)."""
    value = F.try_element_at(scores, F.lit(name))
    return value.try_cast("double") if numeric else value


def string_map(pairs: Column, kind: T.DataType) -> Column:
    """A map of strings out of a struct (its fields), a map, or an array of structs of two fields; values
    are their strings, a null value stays one."""
    if isinstance(kind, T.StructType):
        pairs = F.array(*[F.struct(F.lit(f.name).alias("key"), pairs[f.name].cast("string").alias("value")) for f in kind])
        return F.map_from_entries(pairs)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and len(kind.elementType) == 2:
        key, value = kind.elementType.names
        return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[key].cast("string").alias("key"), p[value].cast("string").alias("value"))))
    if isinstance(kind, T.MapType):
        return pairs.cast("map<string,string>")
    if isinstance(kind, T.NullType):
        return pairs.cast("map<string,string>")
    raise TypeError(f"{kind.simpleString()} holds no pairs")


def typed(value: str | None) -> object:
    """What a stored string stands for: bool, int, float or itself."""
    if value is None or value in ("NA", ""):
        return None
    if value in ("TRUE", "True", "true", "FALSE", "False", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def typed_map(pairs: dict[str, str] | None) -> dict[str, object] | None:
    """A stored map with its values in the types that they stand for."""
    return None if pairs is None else {k: typed(v) for k, v in pairs.items()}
