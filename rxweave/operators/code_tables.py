"""Code tables kept as tables: names of codes by a join that the table's measured size decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.functions.scalars import lookup

#: Up to so many codes a table becomes a literal of the plan; up to so many bytes of codes and names it is broadcast.
LITERAL_ROWS, BROADCAST_BYTES = 1_000, 32 << 20


def _table(table: DataFrame, code: str, name: str) -> DataFrame:
    return table.select(F.col(code).cast("string").alias("_code"), F.col(name).cast("string").alias("_name")).where("_code IS NOT NULL")


def plan_for(table: DataFrame, code: str = "code", name: str = "name") -> str:
    """``literal``, ``broadcast`` or ``shuffle``, by the rows and bytes of the whole table. A code that is there twice is an error."""
    size = F.sum(F.octet_length("_code") + F.coalesce(F.octet_length("_name"), F.lit(0)) + 32)
    counted = _table(table, code, name).groupBy("_code").agg(F.count("*").alias("n"), size.alias("b"))
    n, most, size_ = counted.agg(F.count("*"), F.max("n"), F.sum("b")).first()
    if (most or 0) > 1:
        raise ValueError("a code is in the table more than once")
    if n <= LITERAL_ROWS and (size_ or 0) <= 1 << 20:
        return "literal"
    return "broadcast" if size_ <= BROADCAST_BYTES else "shuffle"


def with_code_name(rows: DataFrame, column: str, table: DataFrame, to: str, code: str = "code", name: str = "name") -> DataFrame:
    """Add ``to``, the table's name of the code in ``column``, and ``<to>_known``. Every row stays, once; a null code isn't known.

    The table's rows are one for each code (null codes are left out).
    """
    plan, plain = plan_for(table, code, name), _table(table, code, name)
    value = F.col(column).cast("string")
    if plan == "literal":
        names = {r._code: r._name for r in plain.collect()}  # at most LITERAL_ROWS
        if not names:
            return rows.withColumns({to: F.lit(None).cast("string"), f"{to}_known": F.lit(False)})
        return rows.withColumns({to: lookup({k: v for k, v in names.items() if v is not None} or {"": ""}, value), f"{to}_known": F.coalesce(value.isin(*names), F.lit(False))})
    right = F.broadcast(plain) if plan == "broadcast" else plain
    joined = rows.join(right, value == F.col("_code"), "left")
    return joined.withColumns({to: F.col("_name"), f"{to}_known": F.col("_code").isNotNull()}).drop("_code", "_name")


def unknown_codes(rows: DataFrame, column: str, table: DataFrame, code: str = "code") -> DataFrame:
    """(code, n): the codes of ``column`` that the table lacks, counted before the anti-join."""
    counted = rows.select(F.col(column).cast("string").alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))
    listed = table.select(F.col(code).cast("string").alias("code"))
    return counted.join(listed, "code", "left_anti")
