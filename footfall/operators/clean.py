"""Raw text -> typed tables, with rejects kept apart.

Every function is a pure DataFrame transformation (no action), so the same code runs on a batch or
a streaming DataFrame of text lines (column ``value``, as produced by ``spark.read.text``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions import (local_to_epoch, measure_ok, parse_int, parse_measure, parse_wall_epoch,
                                typed_rows_where)

_TAB = "\t"
_N = schemas.N_RAW_READING_FIELDS

# positions of the kept raw fields
_INT_FIELDS = {"measurmentId": 0, "counterId": 1, "seqNumber": 2, "visits": 5, "parkCode": 9,
               "cordNorth": 17, "coordSouth": 18}
_TIME_FIELDS = {"startDate": 3, "endDate": 4, "installationDate": 8}


def _field(f: Column, i: int) -> Column:
    """Field ``i`` (0-based) of a split line; NULL when the line is shorter (never an error)."""
    return F.get(f, i)


def _reading_columns(f: Column, tz_offset: str) -> dict[str, Column]:
    cols = {}
    for name in schemas.READING.names:
        if name in _INT_FIELDS:
            cols[name] = parse_int(_field(f, _INT_FIELDS[name]))
        elif name in _TIME_FIELDS:
            cols[name] = parse_wall_epoch(_field(f, _TIME_FIELDS[name]), tz_offset)
        else:  # counterIdPave: text as is
            cols[name] = _field(f, 6)
    return cols


def _split_lines(raw: DataFrame, value_col: str) -> DataFrame:
    # split with limit -1 keeps trailing empty fields, like str.split
    return raw.select(F.col(value_col).alias("value"), F.split(F.col(value_col), _TAB, -1).alias("_f"))


def clean_readings(raw: DataFrame, tz_offset: str = "+02:00", value_col: str = "value") -> DataFrame:
    """Lines with exactly 19 fields whose typed fields all parse -> READING rows.

    The header line fails the integer parse and is rejected like any other bad line.
    """
    lines = _split_lines(raw, value_col)
    cols = {"_n": F.size("_f"), **_reading_columns(F.col("_f"), tz_offset)}

    def all_parsed(r):
        ok = r["_n"] == _N
        for n in schemas.READING.names:
            ok = ok & r[n].isNotNull()
        return ok

    # the arity test is part of the kept-row predicate, so the line is split once per row
    return typed_rows_where(lines, cols, all_parsed).drop("_n")


def rejected_readings(raw: DataFrame, tz_offset: str = "+02:00", value_col: str = "value") -> DataFrame:
    """(value, reason) for every line ``clean_readings`` drops; reason names the first failing field."""
    lines = _split_lines(raw, value_col)
    cols = _reading_columns(F.col("_f"), tz_offset)
    reason = F.when(F.size("_f") != _N, F.lit("field_count"))
    for n in schemas.READING.names:
        reason = reason.when(cols[n].isNull(), F.lit(n))
    return typed_rows_where(lines, {"value": F.col("value"), "reason": reason},
                            lambda r: r["reason"].isNotNull())


def _weather_parts(raw: DataFrame, value_col: str) -> DataFrame:
    f = F.split(F.col(value_col), ",", -1)
    hm = F.split(_field(f, 3), ":", -1)
    local = F.try_make_timestamp_ntz(parse_int(_field(f, 0)), parse_int(_field(f, 1)), parse_int(_field(f, 2)),
                                     parse_int(_field(hm, 0)), parse_int(_field(hm, 1)), F.lit(0))
    return raw.select(F.col(value_col).alias("value"), f.alias("_f"), local.alias("_local"),
                      F.size(hm).alias("_nhm"))


def _weather_ok(tz_offset: str) -> dict[str, Column]:
    checks = {"field_count": F.size("_f") == 5 + len(schemas.WEATHER_MEASURES),
              "time": F.col("_local").isNotNull() & (F.col("_nhm") >= 2)}
    for i, m in enumerate(schemas.WEATHER_MEASURES):
        checks[m] = measure_ok(_field(F.col("_f"), 5 + i))
    return checks


def clean_weather(raw: DataFrame, tz_offset: str = "+02:00", value_col: str = "value") -> DataFrame:
    """Headerless weather lines ``y,m,d,HH:MM[:SS],<skipped>,<11 measures>`` -> WEATHER rows; what
    follows the minutes is not read.

    A blank measure becomes NULL; a measure that is not a number rejects the whole row, as does a
    time that does not exist.
    """
    parts = _weather_parts(raw, value_col)
    ok = F.lit(True)
    for c in _weather_ok(tz_offset).values():
        ok = ok & F.coalesce(c, F.lit(False))
    fields = {"_ok": ok, "startDate": local_to_epoch(F.col("_local"), tz_offset)}
    fields.update({m: parse_measure(_field(F.col("_f"), 5 + i)) for i, m in enumerate(schemas.WEATHER_MEASURES)})
    return typed_rows_where(parts, fields, lambda r: r["_ok"]).drop("_ok")


def rejected_weather(raw: DataFrame, tz_offset: str = "+02:00", value_col: str = "value") -> DataFrame:
    parts = _weather_parts(raw, value_col)
    checks = _weather_ok(tz_offset)
    reason = F.when(~F.coalesce(checks["field_count"], F.lit(False)), F.lit("field_count"))
    for name, c in checks.items():
        if name != "field_count":
            reason = reason.when(~F.coalesce(c, F.lit(False)), F.lit(name))
    return typed_rows_where(parts, {"value": F.col("value"), "reason": reason},
                            lambda r: r["reason"].isNotNull())


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any of ``cols`` (all columns when omitted)."""
    return df.dropna(how="any", subset=list(cols) if cols else None)
