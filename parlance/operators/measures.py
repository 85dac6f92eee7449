"""A hook for measures that the caller supplies: run per session on executors, checked in the task, failures kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .assemble import Field
from .scans import settled


class ContractError(ValueError):
    """Rows of a measure that do not keep to its fields; no value is quoted."""


def checked(rows: pa.Table, fields: Sequence[Field], schema: pa.Schema) -> pa.Table:
    """The rows in the order and types of ``schema``, refused where a column is absent, beyond the contract, or breaks its field."""
    names = {f.name for f in fields}
    if gone := sorted(names - set(rows.column_names)):
        raise ContractError("missing column " + ", ".join(gone))
    if more := sorted(set(rows.column_names) - names):
        raise ContractError("unexpected column " + ", ".join(more))
    columns = []
    for f in fields:
        try:
            c = rows.column(f.name).cast(schema.field(f.name).type)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            raise ContractError(f"{f.name} is no {f.type}") from None
        broken = [
            (not f.nullable and c.null_count > 0, "null"),
            (f.low is not None and pc.any(pc.less(c, f.low)).as_py(), "low"),
            (f.high is not None and pc.any(pc.greater(c, f.high)).as_py(), "high"),
            (bool(f.values) and not pc.all(pc.is_in(c.drop_null(), pa.array(f.values, c.type))).as_py(), "value"),
        ]
        # nothing at all gives null for any and all
        if bad := [name for test, name in broken if test and len(c)]:
            raise ContractError(f"{f.name} {', '.join(bad)}")
        columns.append(c)
    return pa.Table.from_arrays(columns, names=[f.name for f in fields])


def measure(df: DataFrame, key: str, run: Callable[[pa.Table], pa.Table], fields: Sequence[Field], most_rows: int = 5_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes) of ``run`` on the rows of each session: (key, fields), and (key, status, n_rows, message).

    ``run`` is given a session's rows as an Arrow table and returns a table with the columns of ``fields``. What it raises, and rows
    that break the contract, become a 'failed' outcome with the reason; the session then has no row, and the others go on. A session of more than
    ``most_rows`` is failed unread, so a task's memory is bounded; a session without rows in return is 'empty'. Each session is run once.
    """
    if key in {f.name for f in fields}:
        raise ValueError(f"{key} is added to the rows, so no field may have its name")
    kind = df.schema[key]
    inner = T.StructType([T.StructField(f.name, T._parse_datatype_string(f.type)) for f in fields])
    names, arrow = [f.name for f in fields], to_arrow_schema(inner)
    out = T.StructType([kind, T.StructField("__status", T.StringType()), T.StructField("__message", T.StringType()), *inner.fields])
    whole = to_arrow_schema(out)
    sizes = df.groupBy(key).agg(F.count("*").alias("__rows"))
    large = sizes.where(F.col("__rows") > most_rows)
    fit = df.join(F.broadcast(large.select(F.col(key).alias("__large"))), F.col(key).eqNullSafe(F.col("__large")), "left_anti") if not large.isEmpty() else df

    def of_session(session: tuple, rows: pa.Table) -> pa.Table:
        status, message = "ok", None
        try:
            got = checked(run(rows), fields, arrow)
            status = "ok" if got.num_rows else "empty"
        except Exception as problem:  # noqa: BLE001 - whatever it is, it is on record
            status, message = "failed", f"{type(problem).__name__}: {problem}".splitlines()[0][:300]
        if status != "ok":
            got = pa.Table.from_arrays([pa.nulls(1, arrow.field(n).type) for n in names], names=names)
        n = got.num_rows
        head = [pa.array([session[0].as_py()] * n, whole.field(0).type), pa.array([status] * n), pa.array([message] * n, pa.string())]
        return pa.Table.from_arrays([*head, *got.columns], schema=whole)

    made = settled(fit.groupBy(key).applyInArrow(of_session, out))
    rows = made.where("__status = 'ok'").select(key, *names)
    seen = made.groupBy(key, "__status", "__message").agg(F.count_if(F.col("__status") == "ok").alias("n_rows"))
    outcomes = seen.select(key, F.col("__status").alias("status"), "n_rows", F.col("__message").alias("message"))
    over = large.select(key, F.lit("failed").alias("status"), F.lit(0).cast("long").alias("n_rows"), F.lit(f"more than {most_rows} rows").alias("message"))
    return rows, outcomes.unionByName(over)
