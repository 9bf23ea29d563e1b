"""Field access by dotted names, on JSON records (VARIANT) and on typed columns.

A name is first looked up as one literal key, then as a path. A field can be missing, null or a value; these differ as group
keys ("undefined" and "null") and in predicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def shown_number(x: Column) -> Column:
    """A double as text, without a fraction where it has none."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.floor(x).cast("string")).otherwise(x.cast("string"))


@dataclass(frozen=True)
class Field:
    """All that a field can be asked for. number, text and truth are null where the field is not of that kind.

    plain: a typed column by itself, and its kind. What is said of it directly can be pushed down to the files.
    """

    missing: Column
    null: Column
    number: Column
    text: Column
    truth: Column
    seconds: Column
    plain: tuple[Column, str] | None = None
    shown: Column | None = None  # as text, where there is a simpler way

    def within(self, after: int, before: int) -> Column:
        """Is its time in [after, before), in whole seconds?"""
        if self.plain and self.plain[1] == "time":
            at = lambda s: F.lit((datetime(1970, 1, 1) + timedelta(seconds=s)).isoformat(" ")).cast("timestamp_ntz")
            return (self.plain[0] >= at(after)) & (self.plain[0] < at(before))
        return (self.seconds >= after) & (self.seconds < before)

    @property
    def loose_number(self) -> Column:
        return F.coalesce(self.number, self.text.try_cast("double"), self.truth.cast("int").cast("double"))

    @property
    def key(self) -> Column:
        """As a group key: always a string."""
        if self.shown is not None:
            return F.coalesce(self.shown, F.lit("null"))
        value = F.coalesce(shown_number(self.number), self.text, self.truth.cast("string"))
        return F.when(self.missing, "undefined").when(self.null, "null").otherwise(F.coalesce(value, F.lit("[object Object]")))


def text_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 text, rounded down; UTC where it has no zone, null where it is no date."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_seconds(full.try_cast("timestamp"))


class Records:
    """JSON records in one VARIANT column."""

    def __init__(self, column: Column):
        self.column = column

    def __getitem__(self, name: str) -> Field:
        return self.at(self.column, name)

    @staticmethod
    def at(column: Column, name: str) -> Field:
        step = lambda key: "['" + key.replace("'", "\\'") + "']"
        v = F.try_variant_get(column, "$" + step(name), "variant")
        if "." in name:
            v = F.coalesce(v, F.try_variant_get(column, "$" + "".join(map(step, name.split("."))), "variant"))
        kind = F.schema_of_variant(v)
        number = F.when(kind.rlike(_NUMERIC), F.try_variant_get(v, "$", "double"))
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        truth = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        return Field(v.isNull(), F.coalesce(F.is_variant_null(v), F.lit(False)), number, text, truth, F.coalesce(F.floor(number).cast("long"), text_seconds(text)))


class Columns:
    """Typed columns. A path into a text column reads the text as JSON."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def __getitem__(self, name: str) -> Field:
        no = lambda t: F.lit(None).cast(t)
        found = self._find(self.schema, name, None)
        if found is None:
            return Field(F.lit(True), F.lit(False), no("double"), no("string"), no("boolean"), no("long"))
        column, kind, rest = found
        if rest:
            return Records.at(F.try_parse_json(column), rest)
        number, text, truth, seconds, plain = no("double"), no("string"), no("boolean"), no("long"), None
        if isinstance(kind, T.NumericType):
            number, seconds, plain = column.cast("double"), F.floor(column).cast("long"), (column, "number")
        elif isinstance(kind, T.BooleanType):
            truth = column
        elif isinstance(kind, T.TimestampNTZType):
            # Whole seconds from the epoch, whatever the session's time zone; rounded down before 1970 too.
            text, seconds = column.cast("string"), F.floor(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), column) / 1_000_000).cast("long")
            plain = (column, "time")
        elif isinstance(kind, T.TimestampType):
            text, seconds = column.cast("string"), F.unix_seconds(column)
        elif isinstance(kind, T.DateType):
            text, seconds = column.cast("string"), F.unix_date(column).cast("long") * 86_400
        else:
            text = column if isinstance(kind, T.StringType) else column.cast("string")
            seconds, plain = text_seconds(text), (column, "text") if isinstance(kind, T.StringType) else None
        shown = column.cast("string") if isinstance(kind, (T.IntegralType, T.StringType, T.BooleanType)) else None
        return Field(F.lit(False), column.isNull(), number, text, truth, seconds, plain, shown)

    def _find(self, schema: T.StructType, name: str, parent: Column | None):
        """(column, type, what of the name is left over), or None."""
        for f in schema.fields:
            own = F.col(f"`{f.name}`") if parent is None else parent.getField(f.name)
            if f.name == name:
                return own, f.dataType, ""
        for f in schema.fields:
            if name.startswith(f.name + "."):
                own, rest = F.col(f"`{f.name}`") if parent is None else parent.getField(f.name), name[len(f.name) + 1 :]
                if isinstance(f.dataType, T.StructType):
                    if found := self._find(f.dataType, rest, own):
                        return found
                elif isinstance(f.dataType, T.StringType):
                    return own, f.dataType, rest
                elif isinstance(f.dataType, T.VariantType):
                    return F.to_json(own), f.dataType, rest
        return None


class Stored:
    """Columns of a cube: texts, in which "null" and "undefined" stand for these."""

    def __init__(self, columns: dict[str, Column]):
        self.columns = columns

    def __getitem__(self, name: str) -> Field:
        c = self.columns[name]
        truth = F.when(c.isin("true", "false"), c == "true")
        number = c.try_cast("double")
        return Field(c == "undefined", c == "null", number, F.when(number.isNull(), c), truth, number.cast("long"))
