"""Universal types and their spelling in each target dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Source spellings by universal type, fixed values.
SPELLINGS = {
    "STRING": ("char", "character", "varchar", "character varying", "varchar2", "nvarchar", "nvarchar2", "nchar", "bpchar", "citext"),
    "INTEGER": ("tinyint", "smallint", "mediumint", "int", "integer", "int2", "int4", "serial", "smallserial"),
    "BIGINT": ("bigint", "int8", "bigserial"),
    "DECIMAL": ("decimal", "numeric", "dec"),
    "FLOAT": ("float", "real", "float4", "binary_float"),
    "DOUBLE": ("double", "double precision", "float8", "binary_double"),
    "DATE": ("date",),
    "TIME": ("time", "time without time zone", "time with time zone"),
    "TIMESTAMP": ("datetime", "timestamp", "timestamptz", "timestamp without time zone", "timestamp with time zone"),
    "BOOLEAN": ("bool", "boolean", "bit"),
    "BINARY": ("binary", "varbinary", "bytea", "blob", "tinyblob", "mediumblob", "longblob", "raw", "long raw"),
    "TEXT": ("text", "tinytext", "mediumtext", "longtext", "clob", "nclob", "xml", "xmltype"),
    "JSON": ("json", "jsonb"),
    "UUID": ("uuid", "uniqueidentifier"),
}
_KNOWN = {s: u for u, names in SPELLINGS.items() for s in names}
#: What an unknown spelling holds decides, in this order.
_PARTS = (("char", "STRING"), ("string", "STRING"), ("int", "BIGINT"), ("decimal", "DECIMAL"), ("numeric", "DECIMAL"), ("double", "DOUBLE"), ("float", "FLOAT"), ("timestamp", "TIMESTAMP"), ("datetime", "TIMESTAMP"), ("blob", "BINARY"), ("binary", "BINARY"), ("text", "TEXT"), ("clob", "TEXT"))
_NUMBERS = re.compile(r"\((\d+)(?:\s*,\s*(\d+))?\)")


@dataclass(frozen=True)
class Universal:
    kind: str
    length: int = 0
    scale: int = 0
    source: str = ""


def normalise(column_type: str) -> Universal:
    """Universal type of a full source type such as decimal(10,2)."""
    text = column_type.strip().lower()
    m = _NUMBERS.search(text)
    length, scale = int(m[1]) if m else 0, int(m[2] or 0) if m else 0
    base = re.sub(r"\s+", " ", _NUMBERS.sub("", text)).strip()
    base = re.sub(r" (unsigned|signed|zerofill)\b", "", base)
    if base == "number":
        kind = "DECIMAL" if scale > 0 else "BIGINT"
    else:
        kind = _KNOWN.get(base) or next((u for part, u in _PARTS if part in base), "UNKNOWN")
    return Universal(kind, length, scale, column_type)


#: By dialect: longest string, its spelling, the one beyond it; greatest precision and scale, decimal's spelling; then the plain types. Fixed values.
DIALECTS = {
    "postgres": {"string": (10485760, "varchar", "text"), "decimal": (1000, 1000, "numeric"), "INTEGER": "integer", "BIGINT": "bigint", "FLOAT": "real", "DOUBLE": "double precision", "DATE": "date", "TIME": "time", "TIMESTAMP": "timestamp", "BOOLEAN": "boolean", "BINARY": "bytea", "JSON": "jsonb", "UUID": "uuid", "TEXT": "text"},
    "oracle": {"string": (4000, "varchar2", "clob"), "decimal": (38, 38, "number"), "INTEGER": "number(10)", "BIGINT": "number(19)", "FLOAT": "binary_float", "DOUBLE": "binary_double", "DATE": "date", "TIME": "timestamp(6)", "TIMESTAMP": "timestamp(6)", "BOOLEAN": "number(1)", "BINARY": "blob", "JSON": "clob", "UUID": "varchar2(36)", "TEXT": "clob"},
    "sqlserver": {"string": (4000, "nvarchar", "nvarchar(max)"), "decimal": (38, 38, "decimal"), "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "real", "DOUBLE": "float(53)", "DATE": "date", "TIME": "time(7)", "TIMESTAMP": "datetime2(7)", "BOOLEAN": "bit", "BINARY": "varbinary(max)", "JSON": "nvarchar(max)", "UUID": "uniqueidentifier", "TEXT": "nvarchar(max)"},
    "mysql": {"string": (16383, "varchar", "longtext"), "decimal": (65, 30, "decimal"), "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "float", "DOUBLE": "double", "DATE": "date", "TIME": "time(6)", "TIMESTAMP": "datetime(6)", "BOOLEAN": "tinyint(1)", "BINARY": "longblob", "JSON": "json", "UUID": "char(36)", "TEXT": "longtext"},
}


def target_type(u: Universal, dialect: str) -> str:
    """Spelling of a universal type in a dialect, within its limits."""
    d = DIALECTS[dialect]
    if u.kind == "STRING":
        most, name, beyond = d["string"]
        return f"{name}({u.length})" if 0 < u.length <= most else beyond
    if u.kind == "DECIMAL":
        most, most_scale, name = d["decimal"]
        if dialect == "postgres":
            if not 0 < u.length <= most:
                return name
            return f"{name}({u.length},{u.scale})" if u.scale > 0 else f"{name}({u.length})"
        precision = u.length if 0 < u.length <= most else most
        return f"{name}({precision},{min(max(0, u.scale), most_scale, precision)})"
    return d.get(u.kind, d["TEXT"])


#: Spark's own types for universal ones.
SPARK = {"STRING": "string", "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "float", "DOUBLE": "double", "DATE": "date", "TIME": "string", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "BINARY": "binary", "JSON": "string", "UUID": "string", "TEXT": "string", "UNKNOWN": "string"}


def spark_type(u: Universal) -> str:
    if u.kind == "DECIMAL":
        precision = u.length if 0 < u.length <= 38 else 38
        return f"decimal({precision},{min(u.scale, precision)})"
    return SPARK[u.kind]
