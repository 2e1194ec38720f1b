"""Values: constants of program text, and columns that hold them.

A column of values has a kind.  Typed kinds are plain Spark columns, so filters on bound tables reach the scan; ``term`` is a
struct for positions that mix families.  Two values are equal if they are of one family and equal in it: texts (entities,
strings, predicate references), numbers (whole or not), dates, moments with a zone, moments without, durations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000
TERM = T.StructType([T.StructField("key", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("txt", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("us", T.LongType())])
#: Kind -> family.  ``num`` is a double that stands for an int where it is whole.
FAMILY = {"str": "s", "int": "n", "float": "n", "num": "n", "date": "d", "datetime": "t", "ntz": "tn", "dur": "u"}
SPARK_TYPE = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "num": T.DoubleType(), "date": T.DateType(), "datetime": T.TimestampType(), "ntz": T.TimestampNTZType(), "dur": T.LongType(), "term": TERM}


@dataclass(frozen=True)
class Const:
    """A ground argument: its Python value and how it is written."""

    value: object
    form: str  # entity, string, ref, int, float, date, datetime, duration

    @property
    def kind(self) -> str:
        if self.form == "datetime":
            return "datetime" if self.value.tzinfo else "ntz"
        return {"entity": "str", "string": "str", "ref": "str", "duration": "dur"}.get(self.form, self.form)

    def render(self) -> str:
        v = self.value
        if self.form == "string":
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
        if self.form in ("date", "datetime", "duration"):
            return render_temporal(v)
        return repr(v) if self.form == "float" else str(v)

    @property
    def py(self) -> object:
        """As a value of its kind's Spark column."""
        return int(self.value / timedelta(microseconds=1)) if self.form == "duration" else self.value


def moment_text(v: datetime) -> str:
    return v.isoformat().replace("+00:00", "Z")


def duration_text(v: timedelta) -> str:
    us = int(v / timedelta(microseconds=1))
    sign, us = ("-", -us) if us < 0 else ("", us)
    days, us = divmod(us, DAY_US)
    hours, us = divmod(us, 3_600_000_000)
    minutes, us = divmod(us, 60_000_000)
    seconds, us = divmod(us, 1_000_000)
    fraction = f".{us:06d}".rstrip("0") if us else ""
    clock = (f"{hours}H" if hours else "") + (f"{minutes}M" if minutes else "") + (f"{seconds}{fraction}S" if seconds or fraction else "")
    out = (f"{days}D" if days else "") + (f"T{clock}" if clock else "")
    return f"{sign}P{out}" if out else "PT0S"


def render_temporal(v: object) -> str:
    if isinstance(v, datetime):
        return f'dt"{moment_text(v)}"'
    return f'd"{v.isoformat()}"' if isinstance(v, date) else f'dur"{duration_text(v)}"'


_DURATION = re.compile(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")


def parse_duration(text: str) -> timedelta:
    """ISO 8601; a year is 365 days and a month 30."""
    m = _DURATION.fullmatch(text)
    if not m or not any(m.groups()[1:]) or text.endswith("T"):
        raise ValueError(f"Invalid duration: {text!r}")
    y, mo, w, d, h, mi, s = (float(x) if x else 0 for x in m.groups()[1:])
    made = timedelta(days=365 * y + 30 * mo + 7 * w + d, hours=h, minutes=mi, seconds=s)
    return -made if m[1] else made


def parse_moment(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def as_utc(v: datetime) -> datetime:
    return v.replace(tzinfo=UTC) if v.tzinfo is None else v.astimezone(UTC)


@dataclass(frozen=True)
class Val:
    col: Column
    kind: str


def literal(c: Const) -> Val:
    if c.form == "duration":
        return Val(F.lit(c.py).cast("long"), "dur")
    if c.kind == "ntz":
        return Val(F.lit(c.value.isoformat(sep=" ")).cast("timestamp_ntz"), "ntz")
    if c.kind == "datetime":
        return Val(F.timestamp_micros(F.lit(int((as_utc(c.value) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)))), "datetime")
    return Val(F.lit(c.value).cast(SPARK_TYPE[c.kind]), c.kind)


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    found = {T.StringType: "str", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "ntz", T.DayTimeIntervalType: "dur"}.get(type(t))
    if t == TERM:
        return "term"
    if found is None:
        raise TypeError(f"no value kind for {t.simpleString()}; cast it to a string first")
    return found


def from_spark(c: Column, t: T.DataType) -> Val:
    """A bound table's column as a value."""
    kind = kind_of_type(t)
    if isinstance(t, T.DayTimeIntervalType):
        whole = c.cast(T.DayTimeIntervalType(0, 3))
        parts = [F.extract(F.lit(u), whole).cast("decimal(20,6)") * F.lit(n) for u, n in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))]
        return Val(((parts[0] + parts[1] + parts[2] + parts[3]) * 1_000_000).cast("long"), "dur")
    return Val(c if kind in ("term", "date", "datetime", "ntz") else c.cast(SPARK_TYPE[kind]), kind)


def micros(v: Val) -> Column:
    if v.kind == "date":
        return F.unix_date(v.col).cast("long") * DAY_US
    if v.kind == "datetime":
        return F.unix_micros(v.col)
    if v.kind == "ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), v.col)
    return v.col


def at_moment(c: Column, t: T.DataType) -> Column:
    """A date or moment as a timestamp; those without a zone are UTC, whatever the session's zone."""
    kind = kind_of_type(t)
    return F.timestamp_micros(micros(Val(c, kind))) if kind in ("date", "ntz") else c.cast("timestamp")


def iso_text(v: Val) -> Column:
    """A temporal column as program text has it: ISO 8601, moments with a zone in UTC."""
    if v.kind == "date":
        return F.date_format(v.col, "yyyy-MM-dd")
    if v.kind in ("datetime", "ntz"):
        clock = F.timestamp_add("MICROSECOND", micros(v), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        return F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + ("'Z'" if v.kind == "datetime" else ""))
    us = F.abs(v.col)
    seconds = (us % DAY_US / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.concat(F.when(v.col < 0, "-").otherwise(""), F.lit("P"), F.floor(us / DAY_US).cast("string"), F.lit("DT"), seconds.cast("string"), F.lit("S"))


def from_text(form: Column, text: Column) -> dict[str, Column]:
    """Of each kind, the column of arguments written as a form and a text; null where the form is another."""
    is_form = lambda *names: F.when(form.isin(*names), text)
    moment = is_form("datetime")
    zoned = F.regexp_like(text, F.lit("(Z|[+-][0-9]{2}:?[0-9]{2})$"))
    number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("decimal(20,6)"), F.lit(0))
    days = number("([0-9.]+)D") + 7 * number("([0-9.]+)W") + 365 * number("([0-9.]+)Y") + 30 * number("^[^T]*?([0-9.]+)M")
    clock = 3600 * number("T.*?([0-9.]+)H") + 60 * number("T.*?([0-9.]+)M") + number("([0-9.]+)S")
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return {
        "str": is_form("entity", "string", "ref"),
        "int": is_form("int").cast("long"),
        "float": is_form("float").cast("double"),
        "date": F.to_date(is_form("date"), "yyyy-MM-dd"),
        "datetime": F.when(zoned, moment).cast("timestamp"),
        "ntz": F.when(~zoned, moment).cast("timestamp_ntz"),
        "dur": F.when(form == "duration", (sign * (86400 * days + clock) * 1_000_000).cast("long")),
    }


def term(tag: Column, txt: Column | None = None, num: Column | None = None, us: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    txt = none("string") if txt is None else txt
    num = none("double") if num is None else num.cast("double") + F.lit(0.0)
    us = none("long") if us is None else us.cast("long")
    key = F.when(tag == "str", F.concat(F.lit("s:"), txt)).when(tag.isin("int", "float"), F.concat(F.lit("n:"), num.cast("string")))
    key = key.otherwise(F.concat(F.when(tag == "date", "d:").when(tag == "datetime", "t:").when(tag == "ntz", "tn:").otherwise("u:"), us.cast("string")))
    made = F.struct(key.alias("key"), tag.alias("tag"), txt.alias("txt"), num.alias("num"), us.alias("us"))
    return F.when(key.isNotNull(), made)


def whole(c: Column) -> Column:
    return c == F.floor(c)


def to_term(v: Val) -> Column:
    if v.kind == "term":
        return v.col
    family = FAMILY[v.kind]
    if family == "s":
        return term(F.lit("str"), txt=v.col)
    if family == "n":
        tag = F.when(whole(v.col), "int").otherwise("float") if v.kind == "num" else F.lit(v.kind)
        return term(tag, num=v.col)
    return term(F.lit(v.kind), us=micros(v))


def merged_kind(a: str | None, b: str | None) -> str | None:
    """The kind that holds values of both; None is of no value yet."""
    if a is None or b is None or a == b:
        return b if a is None else a
    return "num" if {a, b} == {"int", "num"} else "term"


def as_kind(v: Val, kind: str) -> Column:
    if v.kind == kind:
        return v.col
    return to_term(v) if kind == "term" else v.col.cast(SPARK_TYPE[kind])


def equal(a: Val, b: Val) -> Column:
    if "term" in (a.kind, b.kind):
        return to_term(a)["key"] == to_term(b)["key"]
    if FAMILY[a.kind] != FAMILY[b.kind]:
        return F.lit(False)
    if a.kind != b.kind:
        return a.col.cast("double") == b.col.cast("double")
    return a.col == b.col


def group_key(v: Val) -> Column:
    return v.col["key"] if v.kind == "term" else v.col


def python_value(v: object, kind: str) -> object:
    """A collected value as the Python value it stands for."""
    if v is None:
        return None
    if kind == "term":
        tag = v["tag"]
        if tag == "str":
            return v["txt"]
        if tag in ("int", "float"):
            return int(v["num"]) if tag == "int" else v["num"]
        if tag == "date":
            return date(1970, 1, 1) + timedelta(microseconds=v["us"])
        if tag == "dur":
            return timedelta(microseconds=v["us"])
        return datetime(1970, 1, 1, tzinfo=UTC if tag == "datetime" else None) + timedelta(microseconds=v["us"])
    if kind == "dur":
        return timedelta(microseconds=v) if isinstance(v, int) else v
    if kind == "num":
        return int(v) if v == int(v) else v
    if kind == "datetime":
        return v.astimezone(UTC)
    return v
