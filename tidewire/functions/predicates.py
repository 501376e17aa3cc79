"""Packet predicates as Columns, to be joined with ``& | ~``.

All are two-valued: a packet without the field is false, never null, so ``~`` keeps it. A literal
is read by the field's kind; one that is malformed or too wide for it makes every comparison
false. Repeated fields compare existentially, also for ``!=`` and each end of a range.

A predicate knows what it implies for a packet table's plain columns, and what implies it, through
``& | ~``. Its Column holds the first as a conjunct of its own, which sources push down. Layers of
known protocols, addresses, ports and TCP stream ids are decided by plain columns alone.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import KEYS, NUMERIC_KINDS, flagged, normalised

_WIDTH = {"u8": (0, 2**8 - 1), "u16": (0, 2**16 - 1), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1), "i32": (-(2**31), 2**31 - 1)}
_ORDER = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


# ---------------------------------------------------------------- what plain columns tell


def _both(a: Column | None, b: Column | None) -> Column | None:
    """Both of two conditions, of which a missing one is always true."""
    return b if a is None else a if b is None else a & b


def _either(a: Column | None, b: Column | None) -> Column | None:
    """One of two conditions, of which a missing one is always false."""
    return b if a is None else a if b is None else a | b


def _whole(condition: Column) -> Column:
    """The condition as one value. Else the optimizer draws what it shares with ``must`` out of both, and pushes neither."""
    return F.exists(F.array(condition), lambda x: x)


class _Telling:
    """Mixed into Spark's own Column class: a condition with what it implies (``must``) and what implies it (``enough``).

    Both are conditions on plain columns that are never null. No ``must`` is true, no ``enough`` false.
    """

    must: Column | None = None
    enough: Column | None = None

    @property
    def decided(self) -> bool:
        return self.must is not None and self.must is self.enough

    def __and__(self, other):
        if not isinstance(other, _Telling):
            return predicate(self.plain & other, self.must, None)
        if self.decided and other.decided:
            return _decided(self.must & other.must)
        enough = None if self.enough is None or other.enough is None else self.enough & other.enough
        return predicate(self.plain & other.plain, _both(self.must, other.must), enough)

    def __or__(self, other):
        if not isinstance(other, _Telling):
            return predicate(self.plain | other, None, self.enough)
        must = None if self.must is None or other.must is None else self.must | other.must
        if self.decided and other.decided:
            return _decided(must)
        return predicate(_whole(self.plain | other.plain), must, _either(self.enough, other.enough))

    def __invert__(self):
        if self.decided:
            return _decided(~self.must)
        turned = lambda c: None if c is None else ~c
        return predicate(_whole(~self.plain), turned(self.enough), turned(self.must))


@cache
def _kind(base: type) -> type:
    return type("Predicate", (_Telling, base), {})


def predicate(exact: Column, must: Column | None = None, enough: Column | None = None) -> Column:
    """``exact`` as a Column that has ``must`` as its first conjunct, unless that is all it says."""
    whole = exact if must is None or must is exact else must & exact
    made = object.__new__(_kind(type(whole)))
    made.__dict__.update(whole.__dict__)
    made.plain, made.must, made.enough = whole, must, enough
    return made


def _decided(condition: Column) -> Column:
    return predicate(condition, condition, condition)


def has_layer(protocol: str) -> Column:
    return _decided(flagged(protocol))


def _number(text: str, kind: str) -> int | None:
    if not re.fullmatch(r"[+-]?[0-9]+" if kind == "i32" else r"\+?[0-9]+", text):
        return None
    low, high = _WIDTH[kind]
    return int(text) if low <= int(text) <= high else None


def _address(text: str, kind: str) -> str | None:
    if kind == "macaddr":
        plain = text.lower().replace("-", ":")
        return plain if re.fullmatch(r"[0-9a-f]{2}(:[0-9a-f]{2}){5}", plain) else None
    try:
        return str((ipaddress.IPv4Address if kind == "ipv4addr" else ipaddress.IPv6Address)(text))
    except ValueError:
        return None


def _holds(f: Column, op: str, text: str) -> Column:
    """Whether one field compares to the literal."""
    compare, cases = _ORDER[op], F.when(F.lit(False), False)
    for kind in NUMERIC_KINDS:
        if (value := _number(text, kind)) is not None:
            cases = cases.when(f["kind"] == kind, compare(f["num"], F.lit(value).cast("decimal(20,0)")))
    if op in ("=", "!="):
        # bytes without a text form compare to nothing
        cases = cases.when(f["kind"] == "str", compare(F.lower(f["str"]), F.lit(text.lower())))
        for kind in ("ipv4addr", "ipv6addr", "macaddr"):
            if (value := _address(text, kind)) is not None:
                cases = cases.when(f["kind"] == kind, compare(f["str"], F.lit(value)))
    return F.coalesce(cases, F.lit(False))


def _told(protocol: str, path: str, op: str, text: str) -> Column:
    """A comparison of one of ``KEYS`` by plain columns: the flow columns, or all values where those don't tell."""
    kind, compare = KEYS[protocol][path], _ORDER[op]
    column, is_own = F.col(path), flagged(protocol)
    if kind in NUMERIC_KINDS:
        value = _number(text, kind)
        if path != "stream_id":
            is_own = F.col("transport").eqNullSafe(F.lit(protocol))
    else:
        value = _address(text, kind) if op in ("=", "!=") else None
    single = F.lit(False) if value is None else is_own & column.isNotNull() & compare(column, F.lit(value))
    nested = F.col("nested").eqNullSafe(F.lit(True))
    any_ = F.coalesce(F.exists("further", lambda f: (f["key"] == f"{protocol}.{path}") & _holds(f, op, text)), F.lit(False))
    must = single | nested
    return predicate(~nested | any_, must, single & ~nested)


def _compare(field: str, op: str, literal: object) -> Column:
    protocol, _, path = field.partition(".")
    if not path:
        raise ValueError(f"a field is protocol.name: {field!r}")
    protocol, text = normalised(protocol), str(literal)
    if path in KEYS.get(protocol, ()):
        return _told(protocol, path, op, text)
    return predicate(_in_layers(protocol, path, op, text), flagged(protocol))


def _in_layers(protocol: str, path: str, op: str, text: str) -> Column:

    def within(layer: Column) -> Column:
        # of one name repeated side by side only the first counts; array elements all do
        single = F.get(F.filter(layer["fields"], lambda f: (f["path"] == path) & (F.size(f["elem"]) == 0)), 0)
        found = F.coalesce(_holds(single, op, text), F.lit(False)) | F.exists(layer["fields"], lambda f: (((f["path"] == path) & (F.size(f["elem"]) > 0)) | F.startswith(f["path"], F.lit(path + "."))) & _holds(f, op, text))
        if path.endswith("_name") and op in ("=", "!="):
            labelled = F.exists(layer["fields"], lambda f: (f["path"] == path.removesuffix("_name")) & F.coalesce(_ORDER[op](F.lower(f["name"]), F.lit(text.lower())), F.lit(False)))
            found = found | labelled
        return found

    return F.coalesce(F.exists("layers", lambda x: (x["proto_norm"] == protocol) & within(x)), F.lit(False))


def field_eq(field: str, literal: object) -> Column:
    return _compare(field, "=", literal)


def field_ne(field: str, literal: object) -> Column:
    """Some value of the field differs; a packet without it does not match."""
    return _compare(field, "!=", literal)


def field_lt(field: str, literal: object) -> Column:
    return _compare(field, "<", literal)


def field_le(field: str, literal: object) -> Column:
    return _compare(field, "<=", literal)


def field_gt(field: str, literal: object) -> Column:
    return _compare(field, ">", literal)


def field_ge(field: str, literal: object) -> Column:
    return _compare(field, ">=", literal)


def field_between(field: str, low: object, high: object, negate: bool = False) -> Column:
    """Both ends hold, maybe by different values of a repeated field; ``negate`` turns the whole round."""
    inside = field_ge(field, low) & field_le(field, high)
    return ~inside if negate else inside


def field_in(field: str, literals: Iterable[object], negate: bool = False) -> Column:
    literals = list(literals)
    if not literals:
        raise ValueError("an empty list of values")
    any_ = reduce(lambda a, b: a | b, (field_eq(field, x) for x in literals))
    return ~any_ if negate else any_


def packet_number(op: str, n: int) -> Column:
    """A plain predicate on ``number``, which sources can push down."""
    if op not in _ORDER:
        raise ValueError(f"unknown comparison {op!r}")
    if n < 1 or (op == "<" and n <= 1):
        raise ValueError("packet numbers begin at 1")
    return _decided(_ORDER[op](F.col("number"), F.lit(n)))


def number_between(low: int, high: int) -> Column:
    if low < 1 or high < low:
        raise ValueError("an empty or inverted range")
    return _decided(F.col("number").between(low, high))


def number_in(ranges: Iterable[int | tuple[int, int]]) -> Column:
    """Any of single numbers and ``(first, last)`` ranges."""
    spans = [(r, r) if isinstance(r, int) else tuple(r) for r in ranges]
    if not spans:
        raise ValueError("an empty list of numbers")
    return reduce(lambda a, b: a | b, (number_between(a, b) for a, b in spans))


def parse_numbers(text: str) -> list[tuple[int, int]]:
    """``"1,5,10-20"`` as ranges."""
    out = []
    for part in text.split(","):
        if not (m := re.fullmatch(r"\s*([0-9]+)\s*(?:-\s*([0-9]+)\s*)?", part)):
            raise ValueError(f"not a number or range: {part!r}")
        low, high = int(m[1]), int(m[2] or m[1])
        if low < 1 or high < low:
            raise ValueError(f"an empty or inverted range: {part!r}")
        out.append((low, high))
    return out
