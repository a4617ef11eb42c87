"""Table and column mapping: what is read, under which names, and by which key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Column:
    name: str
    nullable: bool = True
    generated: bool = False


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    columns: tuple[Column, ...] = ()
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class TableMapping:
    """An empty target schema or table means the source's own."""

    table: str
    schema: str = ""
    target_schema: str = ""
    target_table: str = ""
    columns: Mapping[str, str] = field(default_factory=dict)


def rename(df: DataFrame, columns: Mapping[str, str], generated: Sequence[str] = ()) -> DataFrame:
    """All columns but generated ones, renamed where mapped, whatever the case of names; unknown sources and double targets raise."""
    own = {c.lower(): c for c in df.columns}
    asked = {k.lower(): v for k, v in columns.items()}
    if unknown := [k for k in columns if k.lower() not in own]:
        raise ValueError(f"no such columns: {unknown}")
    dropped = {g.lower() for g in generated}
    pairs = [(c, asked.get(low, c)) for low, c in own.items() if low not in dropped]
    targets = [t.lower() for _, t in pairs]
    if len(set(targets)) < len(targets):
        raise ValueError("two columns have one target")
    return df.select(*(F.col(s).alias(t) for s, t in pairs))


def align(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Columns in the target's order and types (name to Spark type); one that lacks raises."""
    own = {c.lower(): c for c in df.columns}
    if missing := [c for c in expected if c.lower() not in own]:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*(F.col(own[c.lower()]).cast(t).alias(c) for c, t in expected.items()))


def resolve(tables: Sequence[Table], mappings: Sequence[TableMapping], default_schema: str) -> list[tuple[Table, str, str]]:
    """Tables with their target schema and name; without mappings, all of the default schema."""
    if not mappings:
        return [(t, t.schema, t.name) for t in tables if t.schema == default_schema]
    by = {(t.schema, t.name): t for t in tables}
    out = []
    for m in mappings:
        key = (m.schema or default_schema, m.table)
        if key not in by:
            raise ValueError(f"no such table: {'.'.join(key)}")
        out.append((by[key], m.target_schema or key[0], m.target_table or key[1]))
    return out


def stable_key(table: Table) -> tuple[str, ...]:
    """The primary key, else the first unique index of columns that are neither nullable nor generated; none raises."""
    if table.primary_key:
        return table.primary_key
    firm = {c.name.lower() for c in table.columns if not c.nullable and not c.generated}
    for index in table.unique:
        if index and all(c.lower() in firm for c in index):
            return tuple(index)
    raise ValueError(f"{table.schema}.{table.name} has no stable key")
