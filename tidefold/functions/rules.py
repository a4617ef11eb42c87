"""Row rules and coercions as Column builders. NULL passes through all but NULL_TO_VALUE; what cannot be converted raises."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space on both sides, Unicode's own included; trim() takes spaces alone.
_BLANK = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def zero_date(c: Column) -> Column:
    return trim(c).startswith("0000-00-00")


RULES: dict[str, Callable[[Column, str, str], Column]] = {
    "TRIM": lambda c, m, v: trim(c),
    "LOWER": lambda c, m, v: F.lower(c),
    "UPPER": lambda c, m, v: F.upper(c),
    "EMPTY_TO_NULL": lambda c, m, v: F.nullif(c, F.lit("")),
    "NULL_TO_VALUE": lambda c, m, v: F.coalesce(c, F.lit(v)),
    "REPLACE_LITERAL": lambda c, m, v: F.replace(c, F.lit(m), F.lit(v)),
    "ZERO_DATE_TO_NULL": lambda c, m, v: F.when(~zero_date(c), c),
    "ZERO_DATE_TO_VALUE": lambda c, m, v: F.when(zero_date(c), F.lit(v)).otherwise(c),
    "JSON_COMPACT": lambda c, m, v: json_compact(c),
}
_NEEDS_MATCH, _NEEDS_VALUE = {"REPLACE_LITERAL"}, {"NULL_TO_VALUE", "ZERO_DATE_TO_VALUE"}


@dataclass(frozen=True)
class Rule:
    """One transform rule; an empty schema or table fits any."""

    column: str
    action: str
    match: str = ""
    value: str = ""
    schema: str = ""
    table: str = ""

    def fits(self, schema: str, table: str) -> bool:
        return (not self.schema or self.schema.lower() == schema.lower()) and (not self.table or self.table.lower() == table.lower())


def apply_rules(df: DataFrame, rules: Sequence[Rule], schema: str = "", table: str = "") -> DataFrame:
    """All rules that fit, in the order given; column names match whatever their case."""
    names = {c.lower(): c for c in df.columns}
    for r in rules:
        if r.action not in RULES:
            raise ValueError(f"no such rule: {r.action}")
        if r.action in _NEEDS_MATCH and not r.match or r.action in _NEEDS_VALUE and not r.value:
            raise ValueError(f"{r.action} lacks its match or value")
        if r.fits(schema, table):
            if r.column.lower() not in names:
                raise ValueError(f"no such column: {r.column}")
            name = names[r.column.lower()]
            df = df.withColumn(name, RULES[r.action](F.col(name).cast("string"), r.match, r.value))
    return df


def _fail(text: str, c: Column) -> Column:
    return F.raise_error(F.concat(F.lit(text + ": "), c))


#: Accepted spellings, fixed values.
TRUE_WORDS, FALSE_WORDS = ("1", "t", "true", "y", "yes", "on"), ("0", "f", "false", "n", "no", "off")


def to_boolean(c: Column) -> Column:
    t = F.lower(trim(c))
    return F.when(c.isNull(), None).when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False).otherwise(_fail("not a boolean", c).cast("boolean"))


def boolean_to_integer(c: Column) -> Column:
    return to_boolean(c).cast("int")


def integer_to_boolean(c: Column) -> Column:
    return F.when(c.isNull(), None).when(trim(c) == "1", True).when(trim(c) == "0", False).otherwise(_fail("not 0 or 1", c).cast("boolean"))


def is_json(c: Column) -> Column:
    """Whether the whole text is one JSON value. The parser stops after a value, so the text is tried inside an array and inside an object: what follows a value breaks one of them."""
    wrapped = [F.concat(F.lit(a), c, F.lit(b)) for a, b in (("[", "]"), ('{"a":', "}"))]
    return F.try_parse_json(wrapped[0]).isNotNull() & F.try_parse_json(wrapped[1]).isNotNull()


def checked_json(c: Column) -> Column:
    """Trimmed text that is valid JSON, else an error."""
    t = trim(c)
    return F.when(c.isNull(), None).when(is_json(t), t).otherwise(_fail("not JSON", c))


def json_compact(c: Column) -> Column:
    """White space between tokens removed; key order, numbers and strings stay as written. Invalid text is an error."""
    token = r"""("(?:[^"\\]|\\.)*+")|[ \t\r\n]+"""
    return F.when(c.isNull(), None).when(is_json(c), F.regexp_replace(c, token, "$1")).otherwise(_fail("not JSON", c))


def guarded_date(c: Column) -> Column:
    """A date or time column refuses a zero date that no rule took away."""
    return F.when(zero_date(c), _fail("zero date", c)).otherwise(c)


def numeric_literal(c: Column, special: bool = False) -> Column:
    """Whether a text is a plain number of at most 512 characters."""
    pattern = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    ok = c.rlike(pattern)
    if special:
        ok = ok | F.lower(c).rlike(r"^([+-]?infinity|nan)$")
    return ok & (F.length(c) <= 512)


def decode_value(value: Column, encoding: Column) -> Column:
    """Bytes of a change field: text, utf8, json or none are UTF-8, base64 is decoded, others raise."""
    return F.when(F.lower(F.coalesce(encoding, F.lit(""))).isin("", "text", "utf8", "json"), value.cast("binary")).when(F.lower(encoding) == "base64", F.unbase64(value)).otherwise(_fail("no such encoding", encoding).cast("binary"))


def key_fingerprint(keys: Sequence[Column]) -> Column:
    """24 hexadecimal digits of SHA-256 over flag, bytes and a closing 0xff of each key."""
    parts = [F.when(k.isNull(), F.unhex(F.lit("01FF"))).otherwise(F.concat(F.unhex(F.lit("00")), k.cast("string").cast("binary"), F.unhex(F.lit("FF")))) for k in keys]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 24)


def framed(values: Sequence[Column]) -> Column:
    """length:value| of each value, hashed."""
    return F.sha2(F.concat(*(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v, F.lit("|")) for v in values)).cast("binary"), 256)


def tso_millis(tso: Column) -> Column:
    return F.shiftright(tso, 18)


def format_lsn(lsn: Column) -> Column:
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF))))


def parse_lsn(text: Column) -> Column:
    part = lambda i: F.conv(F.element_at(F.split(text, "/"), i), 16, 10).cast("bigint")
    return F.shiftleft(part(1), 32).bitwiseOR(part(2))


def kafka_position(tso: Column, offset: Column) -> Column:
    return F.concat(F.lit("tso="), tso.cast("string"), F.lit(";kafka="), offset.cast("string"))


def parse_kafka_position(text: Column) -> Column:
    return F.struct(F.regexp_extract(text, r"tso=(\d+)", 1).cast("bigint").alias("tso"), F.regexp_extract(text, r"kafka=(\d+)", 1).cast("bigint").alias("kafka"))


def latin1_bytes(c: Column) -> Column:
    """Each character as one byte; characters past U+00FF raise."""
    return F.when(c.rlike(r"[^\x{0}-\x{FF}]"), _fail("not Latin-1", c).cast("binary")).otherwise(F.encode(c, "ISO-8859-1"))


def fault_domain(labels: Column) -> Column:
    """region, region/zone or zone/rack from label aliases."""
    first = lambda *names: F.coalesce(*(F.nullif(F.trim(F.element_at(labels, n)), F.lit("")) for n in names))
    region, zone, rack = first("region", "topology.kubernetes.io/region"), first("zone", "availability_zone", "az", "topology.kubernetes.io/zone"), first("rack")
    return F.when(region.isNotNull() & zone.isNotNull(), F.concat_ws("/", region, zone)).when(zone.isNotNull() & rack.isNotNull(), F.concat_ws("/", zone, rack)).otherwise(F.coalesce(region, zone, rack))


def in_window(minute: Column, start: str, end: str) -> Column:
    """Whether a minute of the day lies in [start, end) given as HH:MM; a window may pass midnight, equal ends are always."""
    a, b = (int(t[:2]) * 60 + int(t[3:]) for t in (start, end))
    if a == b:
        return F.lit(True)
    return (minute >= a) & (minute < b) if a < b else (minute >= a) | (minute < b)


def newer(source: Column, target: Column) -> Column:
    """Whether a source version beats a target's: both as timestamps of one layout, else both as numbers, else as text."""
    layouts = [r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$", r"^\d{4}-\d\d-\d\d$"]
    number = lambda c: c.try_cast("decimal(38,10)")
    out = F.when(number(source).isNotNull() & number(target).isNotNull(), number(source) > number(target)).otherwise(source > target)
    for p in reversed(layouts):
        out = F.when(source.rlike(p) & target.rlike(p), source.try_cast("timestamp") > target.try_cast("timestamp")).otherwise(out)
    return out
