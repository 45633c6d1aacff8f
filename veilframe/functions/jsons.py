"""JSON texts as a whole, and checks of nested values compiled from a description of their shape.

``whole`` parses a text only if all of it is one JSON value. A shape (``Text``, ``Number``, ``Flag``, ``Many``, ``Shape``) becomes
one column expression that lists every fault of a value with its path, and another that makes a typed value of it: the
plan grows with the shape, never with the data, and lists of any length are checked in place. Lenient numbers and flags
take what common web frameworks take for them: texts that spell them, and each other's values.

Null and empty texts are no JSON. Objects that repeat a key are no JSON either, unless the session allows them
(``spark.sql.variant.allowDuplicateKeys``; the last one counts then).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import let

FAULT = "array<struct<path:string,fault:string>>"
# Texts that spell a flag.
TRUE_TEXTS, FALSE_TEXTS = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns that are computed once a row: what follows can't be merged with them, as a generator of one row stands between."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def whole(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value from end to end, or null."""
    # the parser stops behind the first value: what follows the text, its own digest, has to be reached as the second of a list
    def of(t):
        values = F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), F.md5(t), F.lit('"]')))
        whole_list = lambda x: F.when((F.size(x) == 2) & (F.try_variant_get(F.get(x, F.lit(1)), "$", "string") == F.md5(t)), F.get(x, F.lit(0)))
        return let(F.try_variant_get(values, "$", "array<variant>"), whole_list)

    return let(text, of)


def kind(value: Column) -> Column:
    """text, integer, number, flag, null, list or object; SQL's null where there is no value."""
    # the schema of a list or an object is made from all that it holds, so these two are told by what they can be taken for
    plain = lambda v: let(F.schema_of_variant(v), _kind)
    return let(value, lambda v: F.when(_entries(v).isNotNull(), "object").when(items(v).isNotNull(), "list").otherwise(plain(v)))


def _kind(s: Column) -> Column:
    return (
        F.when(s == "STRING", "text")
        .when((s == "BIGINT") | s.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when((s == "DOUBLE") | s.startswith("DECIMAL"), "number")
        .when(s == "BOOLEAN", "flag")
        .when(s == "VOID", "null")
    )


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$['{name}']", "variant")


def _is(value: Column, schema: str) -> Column:
    return F.schema_of_variant(value) == schema


def _text(value: Column) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def as_text(value: Column) -> Column:
    """A text's own characters; null for values of other kinds."""
    return let(value, _text)


def as_number(value: Column) -> Column:
    """A number as double; flags are 0 and 1, all else is null."""
    return let(value, lambda v: F.when(~_is(v, "STRING"), F.try_variant_get(v, "$", "double")))


def items(value: Column) -> Column:
    """A list's values; null for values of other kinds."""
    return F.try_variant_get(value, "$", "array<variant>")


def _entries(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def keys(value: Column) -> Column:
    """An object's names; null for values of other kinds."""
    return F.map_keys(_entries(value))


@dataclass(frozen=True)
class Text:
    """A text of ``least`` to ``most`` code points that fits ``pattern`` or is one of ``among``."""

    least: int | None = None
    most: int | None = None
    pattern: str | None = None
    among: Sequence[str] = ()

    def fault(self, v: Column) -> Column:
        said, checks = F.try_variant_get(v, "$", "string"), [(~_is(v, "STRING"), "not a text")]
        if self.least is not None:
            checks.append((F.length(said) < self.least, f"shorter than {self.least}"))
        if self.most is not None:
            checks.append((F.length(said) > self.most, f"longer than {self.most}"))
        if self.pattern is not None:
            checks.append((~said.rlike(self.pattern), "not of the form"))
        if self.among:
            checks.append((~said.isin(*self.among), "not one of the known"))
        return _first(checks)

    def typed(self, v: Column) -> Column:
        return _text(v)


@dataclass(frozen=True)
class Number:
    """A number of ``least`` to ``most``; ``integer``: without a fraction. ``lenient`` takes texts that spell one, and flags."""

    least: float | None = None
    most: float | None = None
    integer: bool = False
    lenient: bool = True

    def _own(self, v: Column) -> Column:
        own = F.try_variant_get(v, "$", "double")
        if not self.lenient:
            return F.when(~F.schema_of_variant(v).isin("STRING", "BOOLEAN"), own)
        spelled = F.trim(F.translate(F.try_variant_get(v, "$", "string"), "\t\n\r\f\v", "     "))
        form = r"^[+-]?\d+(\.0*)?$" if self.integer else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
        return F.when(_is(v, "STRING"), F.when(spelled.rlike(form), spelled.try_cast("double"))).otherwise(own)

    def fault(self, v: Column) -> Column:
        none = "not an integer" if self.integer else "not a number"

        def judge(n):
            checks = [(n.isNull() | (n != F.floor(n)) if self.integer else n.isNull(), none)]
            if self.least is not None:
                checks.append((n < self.least, f"below {self.least}"))
            if self.most is not None:
                checks.append((n > self.most, f"above {self.most}"))
            return _first(checks)

        bounded = self.integer or self.least is not None or self.most is not None
        return let(self._own(v), judge) if bounded else F.when(self._own(v).isNull(), none)

    def typed(self, v: Column) -> Column:
        return let(self._own(v), lambda n: F.when(n == F.floor(n), n).cast("long")) if self.integer else self._own(v)


@dataclass(frozen=True)
class Flag:
    """True or false. ``lenient`` takes 0, 1 and texts that spell one."""

    lenient: bool = True

    def typed(self, v: Column) -> Column:
        own = F.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean"))
        if not self.lenient:
            return own
        said, n = F.lower(F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$", "double")
        spelled = F.when(said.isin(*TRUE_TEXTS), True).when(said.isin(*FALSE_TEXTS), False)
        return own.when(_is(v, "STRING"), spelled).otherwise(F.when(n.isin(0.0, 1.0), n == 1.0))

    def fault(self, v: Column) -> Column:
        return F.when(self.typed(v).isNull(), "not a flag")


@dataclass(frozen=True)
class Many:
    """A list of ``most`` items at most, all of one kind."""

    item: Text | Number | Flag | Many | Shape
    most: int | None = None

    def fits(self, v: Column) -> Column:
        few = lambda xs: F.size(xs) <= self.most if self.most is not None else F.lit(True)
        return let(items(v), lambda xs: xs.isNotNull() & few(xs) & F.forall(xs, lambda x: fits(self.item, x)))

    def faults(self, v: Column, path: Column) -> Column:
        def of(xs):
            each = F.transform(xs, lambda x, i: F.when(fits(self.item, x), _none()).otherwise(faults(self.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            out = F.when(xs.isNull(), _one(path, F.lit("not a list")))
            if self.most is not None:
                out = out.when(F.size(xs) > self.most, _one(path, F.lit(f"more than {self.most} items")))
            return out.otherwise(F.flatten(each))

        return let(items(v), of)

    def typed(self, v: Column) -> Column:
        return F.transform(items(v), lambda x: self.item.typed(x))


@dataclass(frozen=True)
class Shape:
    """An object. ``optional`` names may be missing, or null; ``nullable`` ones are there, or null. ``closed``: it has no other names."""

    fields: Mapping[str, Text | Number | Flag | Many | Shape]
    optional: frozenset[str] = field(default_factory=frozenset)
    defaulted: frozenset[str] = field(default_factory=frozenset)
    closed: bool = False

    def _members(self, v: Column) -> Column:
        """The members as one STRUCT of VARIANT, taken in one pass; null for values of other kinds."""
        names = ",".join(f"`{n.replace('`', '``')}`:variant" for n in self.fields)
        return F.try_variant_get(v, "$", f"struct<{names}>")

    def _absent(self, name: str, x: Column) -> Column:
        """Whether a member counts as not there, which only ``optional`` and ``defaulted`` ones may be."""
        return x.isNull() | F.is_variant_null(x) if name in self.optional else x.isNull()

    def fits(self, v: Column) -> Column:
        def of(o):
            out = o.isNotNull()
            for name, shape in self.fields.items():
                x = o.getField(name)
                out = out & (self._absent(name, x) | fits(shape, x) if name in self.optional | self.defaulted else x.isNotNull() & fits(shape, x))
            return out & F.forall(keys(v), lambda k: k.isin(*self.fields)) if self.closed else out

        return let(self._members(v), of)

    def faults(self, v: Column, path: Column) -> Column:
        """``defaulted`` names may be missing but not null."""
        start = F.concat(path, F.when(path == "", "").otherwise("."))

        def of(o):
            found = []
            for name, shape in self.fields.items():
                at, x = F.concat(start, F.lit(name)), o.getField(name)
                missing = _none() if name in self.optional | self.defaulted else _one(at, F.lit("missing"))
                found.append(F.when(self._absent(name, x), missing).otherwise(faults(shape, x, at)))
            if self.closed:
                more = F.filter(F.array_sort(keys(v)), lambda k: ~k.isin(*self.fields))
                found.append(F.transform(more, lambda k: F.struct(F.concat(start, k).alias("path"), F.lit("unknown name").alias("fault"))))
            return F.when(o.isNull(), _one(path, F.lit("not an object"))).otherwise(F.concat(*found))

        return let(self._members(v), of)

    def typed(self, v: Column) -> Column:
        return let(self._members(v), lambda o: F.struct(*[shape.typed(o.getField(name)).alias(name) for name, shape in self.fields.items()]))


def _first(checks: list[tuple[Column, str]]) -> Column:
    out = F.when(checks[0][0], checks[0][1])
    for holds, said in checks[1:]:
        out = out.when(holds, said)
    return out


def _none() -> Column:
    return F.array().cast(FAULT)


def _one(path: Column, fault: Column) -> Column:
    return F.array(F.struct(path.alias("path"), fault.alias("fault")))


def fits(shape: Text | Number | Flag | Many | Shape, value: Column) -> Column:
    """Whether ``value`` has no fault, without listing any; never null."""
    return shape.fits(value) if isinstance(shape, (Many, Shape)) else shape.fault(value).isNull()


def faults(shape: Text | Number | Flag | Many | Shape, value: Column, path: Column) -> Column:
    """ARRAY<STRUCT<path, fault>>: every fault of ``value``, in the order of the shape; empty if it fits."""
    if isinstance(shape, (Many, Shape)):
        return shape.faults(value, path)
    return let(shape.fault(value), lambda f: F.when(f.isNull(), _none()).otherwise(_one(path, f)))
