"""Rounding half up, away from zero, that engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What binary fractions may lack of a half, in units of the last digit.
SLACK = 1e-9


def half_up(value: Column | str, digits: int) -> Column:
    """value as a double, rounded half away from zero; 2.675 counts as the tie it was meant to be."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    scale = float(10**digits)
    return F.signum(x) * (F.floor(F.abs(x) * scale + 0.5 + SLACK) / scale)


def half_up_sql(sql: str) -> str:
    """sql with each ROUND(x, digits) written out as half_up() does it."""
    while (at := sql.find("ROUND(")) >= 0:
        depth, comma, k = 1, -1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                comma = k
            k += 1
        if comma < 0:
            sql = sql[:at] + "round(" + sql[at + 6 :]
            continue
        x, scale = f"CAST({sql[at + 6 : comma]} AS DOUBLE)", f"{float(10 ** int(sql[comma + 1 : k - 1]))!r}E0"
        sql = f"{sql[:at]}(SIGN({x}) * (FLOOR(ABS({x}) * {scale} + 0.5E0 + 1E-9) / {scale})){sql[k:]}"
    return sql
