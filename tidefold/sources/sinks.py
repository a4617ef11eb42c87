"""Database sinks: statements of idempotent keyed writes by dialect, and their use from each partition."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidefold.functions import types
from tidefold.sources.jdbc import quoted

_KINDS = {"string": "varchar", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "boolean": "boolean", "binary": "bytea", "smallint": "int", "tinyint": "int"}


def create_table(dialect: str, table: str, schema: StructType, keys: Sequence[str] = ()) -> str:
    """CREATE TABLE for a Spark schema; indexes and foreign keys come after the load."""
    columns = []
    for f in schema:
        kind = f.dataType.simpleString()
        spelled = types.target_type(types.normalise(_KINDS.get(kind, kind)), dialect)
        columns.append(f"{quoted(dialect, f.name)} {spelled}" + " NOT NULL" * (f.name in keys))
    if keys:
        columns.append(f"PRIMARY KEY ({', '.join(quoted(dialect, k) for k in keys)})")
    return f"CREATE TABLE {quoted(dialect, table)} ({', '.join(columns)})"


def upsert_statement(dialect: str, table: str, columns: Sequence[str], keys: Sequence[str], bind: str = "?") -> str:
    """Writes one bound row so that a repeat changes nothing; a plain INSERT where there is no key."""
    q = lambda n: quoted(dialect, n)
    names, rest = ", ".join(map(q, columns)), [c for c in columns if c not in keys]
    insert = f"INSERT INTO {q(table)} ({names}) VALUES ({', '.join([bind] * len(columns))})"
    if not keys:
        return insert
    if dialect == "mysql":
        return f"{insert} ON DUPLICATE KEY UPDATE {', '.join(f'{q(c)} = VALUES({q(c)})' for c in columns)}"
    if dialect == "postgres":
        action = f"DO UPDATE SET {', '.join(f'{q(c)} = EXCLUDED.{q(c)}' for c in rest)}" if rest else "DO NOTHING"
        return f"{insert} ON CONFLICT ({', '.join(map(q, keys))}) {action}"
    dual = " FROM DUAL" if dialect == "oracle" else ""
    row = f"SELECT {', '.join(f'{bind} AS {q(c)}' for c in columns)}{dual}"
    match = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
    lock, end = (" WITH (HOLDLOCK) AS", ";") if dialect == "sqlserver" else ("", "")
    alias = " AS s" if dialect == "sqlserver" else " s"
    return f"MERGE INTO {q(table)}{lock} t USING ({row}){alias} ON ({match}){update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{q(c)}' for c in columns)}){end}"


def delete_statement(dialect: str, table: str, keys: Sequence[str], bind: str = "?") -> str:
    return f"DELETE FROM {quoted(dialect, table)} WHERE {' AND '.join(f'{quoted(dialect, k)} = {bind}' for k in keys)}"


def write(df: DataFrame, connect: Callable, statement: str, batch: int = 500) -> None:
    """Runs a bound statement for each row, a transaction a batch; a task that is tried again repeats idempotent writes."""

    def put(rows) -> None:
        connection = connect()
        try:
            held = []
            for r in rows:
                held.append(tuple(r))
                if len(held) >= batch:
                    connection.cursor().executemany(statement, held)
                    connection.commit()
                    held = []
            if held:
                connection.cursor().executemany(statement, held)
                connection.commit()
        finally:
            connection.close()

    df.foreachPartition(put)
