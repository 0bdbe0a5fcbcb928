"""Column expressions (all JVM-side; no Python UDF).

Time rule: wall-clock values are read at one fixed offset (``tz_offset``), and every expression here
is independent of ``spark.sql.session.timeZone``: instants are epoch seconds (DOUBLE) and local wall
times are TIMESTAMP_NTZ.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.labels import (DAY_PART_LABELS, PARK_MESSAGES, PARK_UNKNOWN_MESSAGE,
                                       ROUTE_COUNT_MESSAGE)

def ntz_epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def offset_seconds(tz_offset: str) -> int:
    m = re.fullmatch(r"([+-])(\d{2}):?(\d{2})", tz_offset)
    if not m:
        raise ValueError(f"bad offset {tz_offset!r}, expected like '+02:00'")
    sign = 1 if m.group(1) == "+" else -1
    return sign * (int(m.group(2)) * 3600 + int(m.group(3)) * 60)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- parsing ---------------------------------------------------------------------------------

def parse_wall_epoch(text, tz_offset: str = "+02:00", pattern: str = "M/d/yyyy H:m") -> Column:
    """Wall-clock text read at ``tz_offset`` -> epoch seconds (DOUBLE); NULL when it does not parse."""
    ts = F.try_to_timestamp(F.concat(col_(text), F.lit(" " + tz_offset)), F.lit(pattern + " XXX"))
    return F.unix_timestamp(ts).cast("double")


def parse_int(text) -> Column:
    """Text -> BIGINT; blanks and non-integers give NULL (surrounding spaces allowed)."""
    return col_(text).try_cast("bigint")


def parse_measure(text) -> Column:
    """Blank -> NULL; otherwise text -> DOUBLE (NULL when it is not a number). 'NaN' becomes NULL
    too, so that means skip it as they skip missing values (Spark's avg would return NaN)."""
    x = F.nullif(col_(text), F.lit("")).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def measure_ok(text) -> Column:
    """True when the measure is blank or parses as a number (a bad measure rejects the row)."""
    c = col_(text)
    return (c == "") | c.try_cast("double").isNotNull()


def decimal_comma(c) -> Column:
    """Text with a decimal comma ('4,6') -> DOUBLE; numbers pass through; NULL stays NULL."""
    return F.regexp_replace(col_(c).cast("string"), ",", ".").try_cast("double")


# ---- time ------------------------------------------------------------------------------------

def epoch_to_local(epoch, tz_offset: str = "+02:00") -> Column:
    """Epoch seconds (fractions count) -> local wall time (TIMESTAMP_NTZ) at a fixed offset."""
    micros = F.round((col_(epoch).cast("double") + F.lit(offset_seconds(tz_offset))) * F.lit(1e6)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, ntz_epoch())


def local_to_epoch(local_ntz, tz_offset: str = "+02:00") -> Column:
    """Local wall time (TIMESTAMP_NTZ) -> epoch seconds (DOUBLE)."""
    return (F.unix_timestamp(col_(local_ntz)) - F.lit(offset_seconds(tz_offset))).cast("double")


def utc_string(epoch) -> Column:
    """Epoch seconds -> 'yyyy-MM-dd HH:mm:ss' in UTC."""
    return F.date_format(F.timestamp_add("SECOND", col_(epoch).cast("bigint"), ntz_epoch()),
                         "yyyy-MM-dd HH:mm:ss")


def weekday_mon0(c) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(col_(c))


def hour_bin2(hour) -> Column:
    """2-hour bin: 8 and 9 -> 8."""
    h = col_(hour)
    return h - h % 2


def day_part(hour) -> Column:
    """hour <= 12 -> 0, <= 16 -> 1, else 2."""
    h = col_(hour)
    return F.when(h <= 12, F.lit(0)).when(h <= 16, F.lit(1)).otherwise(F.lit(2))


def day_part_label(part) -> Column:
    """Day part -> clock label used as the series timestamp of that part."""
    return F.element_at(F.array(*[F.lit(x) for x in DAY_PART_LABELS]), col_(part).cast("int") + 1)


# ---- load answers ----------------------------------------------------------------------------

def clamp_negative(c) -> Column:
    """Negative -> 0; NULL stays NULL (``greatest(0, x)`` would turn NULL into 0)."""
    x = col_(c)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def load_ratio(pred, max_visits) -> Column:
    return col_(pred).cast("double") / (col_(max_visits) + F.lit(1)).cast("double")


def park_class(load) -> Column:
    """Strict thresholds on the unrounded mean load."""
    x = col_(load)
    return (F.when(x > 0.7, F.lit("extremely busy")).when(x > 0.5, F.lit("very busy"))
            .when(x > 0.3, F.lit("moderate")).otherwise(F.lit("almost empty")))


def route_bucket(load) -> Column:
    """Bucket of a route's load; NULL when the load is missing (NULL or NaN)."""
    x = F.nanvl(col_(load).cast("double"), F.lit(None).cast("double"))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(x > 0.7, F.lit("avoid")).when(x > 0.5, F.lit("busy")).otherwise(F.lit("free"))


def load_percent(load) -> Column:
    return F.ceil(col_(load) * 100).cast("bigint")


def park_message(state, percent) -> Column:
    s, p = col_(state), col_(percent).cast("string")
    expr = F.lit(PARK_UNKNOWN_MESSAGE)
    for key, template in reversed(list(PARK_MESSAGES.items())):
        expr = F.when(s == key, F.format_string(template, p)).otherwise(expr)
    return expr


def route_count_message(avoid, busy, free) -> Column:
    return F.format_string(ROUTE_COUNT_MESSAGE, col_(avoid), col_(busy), col_(free))


# ---- aggregation helpers ---------------------------------------------------------------------

def exact_sum(c, scale: int = 12) -> Column:
    """Sum of a DOUBLE column computed on exact decimals, so it does not depend on row order
    (same value after a task is recomputed, and equal across engines).

    Digits beyond ``scale`` are cut. Values from 1e15 on, which could leave the decimal's range in
    a long sum, are summed as doubles beside it."""
    x = col_(c)
    wide = F.abs(x) >= F.lit(1e15)
    exact = F.sum(F.when(~wide, x).cast(f"decimal(38,{scale})")).cast("double")
    rest = F.sum(F.when(wide, x))
    return F.when(exact.isNull(), rest).otherwise(exact + F.coalesce(rest, F.lit(0.0)))


# ---- row selection -----------------------------------------------------------------------------

def typed_rows_where(df, fields: dict, keep) -> "DataFrame":
    """Evaluate the typed ``fields`` once per row and keep the rows where ``keep(row)`` holds.

    A plain ``select(...).where(...)`` lets the optimizer push the predicate below the projection,
    which re-evaluates every parse expression inside the filter. Here the typed values are one
    projection, and the rows to keep come out of a generator (``inline`` of a one-element array,
    NULL when the row is dropped), which predicates cannot be pushed through; all of it stays in
    generated code.
    """
    names = list(fields)
    typed = df.select(*[c.alias(n) for n, c in fields.items()])
    row = F.struct(*[F.col(n) for n in names])
    return typed.select(F.inline(F.when(keep(row), F.array(row))))


def literal_table(spark, rows, ddl: str):
    """A small fixed table built in the JVM (no Python-side RDD to read back): one generated row
    per literal tuple, typed by the DDL schema."""
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], ddl).schema
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
