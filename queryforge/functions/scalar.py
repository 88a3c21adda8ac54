"""Scalar Column helpers (SF1-SF9, SF17-SF26).

Every helper takes and returns a ``Column`` built from JVM-side functions, so
they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: score bounds used by graders and rewards ---
MIN_SCORE = 0.001
MAX_SCORE = 0.999
TASK_SCORE_DIGITS = 3
REWARD_DIGITS = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# dates -------------------------------------------------------------------
def year_of(d) -> Column:
    """SF1: calendar year (as int)."""
    return F.year(_c(d))


def year_month(d) -> Column:
    """SF2: 'yyyy-MM' bucket text."""
    return F.date_format(_c(d), "yyyy-MM")


def calendar_day(d) -> Column:
    """SF3: calendar day of a timestamp."""
    return F.to_date(_c(d))


def day_distance(a, b) -> Column:
    """SF4: fractional days a - b (julian-day difference) for timestamps or dates.

    Computed on microseconds, so the result is exact before the final division.
    """
    return _micros_between(b, a).cast("double") / F.lit(86_400_000_000.0)


def _micros_between(start, end) -> Column:
    """end - start in microseconds; wall-clock difference for timestamp_ntz (no time-zone shifts)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def whole_days(a, b) -> Column:
    """PRJ3: ``CAST(julianday(a) - julianday(b) AS INTEGER)``: truncation toward zero."""
    return day_distance(a, b).cast("long").cast("int")


def within_days(ts, start, days: int) -> Column:
    """PRJ6 (F12 fix): 0 <= ts - start <= days, exact on microseconds."""
    delta = _micros_between(start, ts)
    return (delta >= 0) & (delta <= F.lit(days * 86_400_000_000))


def year_range(d, year: int) -> Column:
    """PRJ4 in push-down form: ``year(d) = y`` as a half-open range on the raw column."""
    c = _c(d)
    # string bounds are coerced to the column's own type (timestamp, timestamp_ntz
    # or date), so the comparison stays on the raw column and is pushed to the scan
    return (c >= F.lit(f"{year}-01-01")) & (c < F.lit(f"{year + 1}-01-01"))


# math / conditional ------------------------------------------------------
def money(x, scale: int = 2) -> Column:
    """Exact money: cast to decimal before summing so sums are order-independent."""
    return _c(x).cast(f"decimal(18,{scale})")


def clamp_round(x, lo: float = MIN_SCORE, hi: float = MAX_SCORE, digits: int = TASK_SCORE_DIGITS) -> Column:
    """SF9: round(min(hi, max(lo, x)), digits)."""
    return F.round(F.least(F.lit(hi), F.greatest(F.lit(lo), _c(x))), digits)


def clamp(x, lo: float = MIN_SCORE, hi: float = MAX_SCORE) -> Column:
    """SF9 without rounding (the agent-side ``strict_score``)."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), _c(x)))


def zero_default(x) -> Column:
    """SF8: ``float(v or 0)``: null, empty or unparsable becomes 0.0."""
    return F.coalesce(_c(x).cast("string").try_cast("double"), F.lit(0.0))


def signed(side, amount, negative_when: str = "BUY") -> Column:
    """SF7/AG8 body: ``CASE WHEN side = x THEN -amount ELSE amount END``."""
    return F.when(_c(side) == F.lit(negative_when), -_c(amount)).otherwise(_c(amount))


def jitter(seed: int = 0, width: float = 1e-6) -> Column:
    """SF19: uniform(-width, width) noise, seeded so reruns agree."""
    return F.rand(seed) * F.lit(2 * width) - F.lit(width)


def session_uuid() -> Column:
    """SF20: a fresh session id per row."""
    return F.expr("uuid()")


def pass_label(reward, threshold: float = 0.5) -> Column:
    """SF23: 'pass' when reward >= threshold else 'check'."""
    return F.when(_c(reward) >= F.lit(threshold), F.lit("pass")).otherwise(F.lit("check"))


def tolerant_equal(actual, expected, tol: float = 1.0) -> Column:
    """SF24: |a - e| < tol; a null expected accepts a null or zero actual."""
    a, e = _c(actual), _c(expected)
    return F.when(e.isNull(), a.isNull() | (a == 0)).otherwise(
        F.coalesce(F.abs(a.cast("double") - e.cast("double")) < F.lit(tol), F.lit(False)))


def step_fraction_tier(steps_taken, max_steps) -> Column:
    """SF26 / RW4 tiers: 0.2 / 0.15 / 0.1 / 0.05 at fraction <= 0.3 / 0.5 / 0.7 / above."""
    frac = _c(steps_taken).cast("double") / _c(max_steps).cast("double")
    return (F.when(frac <= 0.3, F.lit(0.2)).when(frac <= 0.5, F.lit(0.15))
            .when(frac <= 0.7, F.lit(0.1)).otherwise(F.lit(0.05)))


# text formatting ---------------------------------------------------------
def fixed(x, digits: int) -> Column:
    """SF17: ``%.Nf`` text."""
    return F.format_string(f"%.{digits}f", _c(x).cast("double"))


def _units_sql(v: str, digits: int) -> str:
    """SQL text: round-half-even of |v| * 10^d on the exact binary value (see ``py_fixed``)."""
    scale = f"{float(10 ** digits)!r}D"
    a = f"abs(CAST({v} AS DOUBLE))"
    p = f"({a} * {scale})"
    c = f"({a} * 134217729.0D)"
    hi = f"({c} - ({c} - {a}))"
    lo = f"({a} - {hi})"
    err = f"(({hi} * {scale} - {p}) + {lo} * {scale})"
    half = f"(({p} - floor({p})) = 0.5D)"
    return (f"(CASE WHEN {half} AND {err} > 0 THEN floor({p}) + 1 WHEN {half} AND {err} < 0 THEN floor({p}) "
            f"ELSE rint({p}) END)")


def _sql_ref(x) -> str | None:
    """Quoted column reference when ``x`` names a column, else None."""
    return f"`{x}`" if isinstance(x, str) else None


def py_fixed(x, digits: int) -> Column:
    """SF17 with Python's rounding: ``f"{x:.Nf}"`` rounds the exact binary value.

    Java's ``%.Nf`` rounds the shortest decimal form half-up (0.2485 -> 0.249),
    Python rounds the true binary value (0.2485 is 0.24849999.. -> 0.248).  The
    scaled value ``p = x * 10^N`` is formed in double; when ``p`` lands exactly
    on a half, the sign of its exact rounding error (Dekker's two-product,
    plain double arithmetic) decides the side; true ties go to even.  Built as
    one SQL expression (one JVM call) when ``x`` names a column.
    """
    ref = _sql_ref(x)
    if ref is None:
        return _py_fixed_cols(_c(x), digits)
    units = f"CAST({_units_sql(ref, digits)} AS BIGINT)"
    sign = f"CASE WHEN CAST({ref} AS DOUBLE) < 0 AND {units} > 0 THEN '-' ELSE '' END"
    if digits == 0:
        body = f"CAST({units} AS STRING)"
    else:
        m = 10 ** digits
        body = f"format_string('%d.%0{digits}d', CAST({units} DIV {m} AS BIGINT), CAST({units} % {m} AS BIGINT))"
    return F.expr(f"concat({sign}, {body})")


def _py_fixed_cols(v: Column, digits: int) -> Column:
    v = v.cast("double")
    a = F.abs(v)
    scale = float(10 ** digits)
    p = a * F.lit(scale)
    c = a * F.lit(134217729.0)
    hi = c - (c - a)
    lo = a - hi
    err = (hi * F.lit(scale) - p) + lo * F.lit(scale)
    fl = F.floor(p)
    half = (p - fl) == F.lit(0.5)
    units = F.when(half & (err > 0), fl + 1).when(half & (err < 0), fl).otherwise(F.rint(p)).cast("long")
    sign = F.when((v < 0) & (units > 0), F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        body = units.cast("string")
    else:
        body = F.format_string(f"%d.%0{digits}d", (units / F.lit(10 ** digits)).cast("long"),
                               (units % F.lit(10 ** digits)).cast("long"))
    return F.concat(sign, body)


def py_round(x, digits: int) -> Column:
    """Python's ``round(x, N)`` on floats (exact binary value, ties to even), as double."""
    ref = _sql_ref(x)
    if ref is not None:
        return F.expr(f"CASE WHEN {ref} IS NULL THEN CAST(NULL AS DOUBLE) ELSE signum(CAST({ref} AS DOUBLE)) * "
                      f"({_units_sql(ref, digits)} / {float(10 ** digits)!r}D) END")
    v = _c(x).cast("double")
    a = F.abs(v)
    scale = float(10 ** digits)
    p = a * F.lit(scale)
    c = a * F.lit(134217729.0)
    hi = c - (c - a)
    lo = a - hi
    err = (hi * F.lit(scale) - p) + lo * F.lit(scale)
    fl = F.floor(p)
    half = (p - fl) == F.lit(0.5)
    units = F.when(half & (err > 0), fl + 1).when(half & (err < 0), fl).otherwise(F.rint(p))
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(F.signum(v) * (units / F.lit(scale)))


def py_clamp_round(x, lo: float = MIN_SCORE, hi: float = MAX_SCORE, digits: int = TASK_SCORE_DIGITS) -> Column:
    """SF9 with Python rounding: ``round(min(hi, max(lo, x)), digits)``."""
    return py_round(F.least(F.lit(hi), F.greatest(F.lit(lo), _c(x))), digits)


def bool_text(x) -> Column:
    """SF17: lower-case boolean text."""
    return F.when(_c(x), F.lit("true")).otherwise(F.lit("false"))


def one_line(x, width: int = 200) -> Column:
    """SF16: escape newlines and double quotes, then keep the first ``width`` characters."""
    esc = F.regexp_replace(F.regexp_replace(_c(x), "\n", "\\\\n"), '"', '\\\\"')
    return F.substring(esc, 1, width)


def first_rows(arr, n: int = 3) -> Column:
    """SF25: first n elements of an array."""
    return F.slice(_c(arr), 1, n)


def first_present(columns: Sequence[str], candidates: Iterable[str], contains: str | None = None) -> Column:
    """SF21: value of the first candidate key present (non-null) in a row, else the
    first column whose name holds ``contains`` (case-blind), as double."""
    cols = list(columns)
    picked = [F.col(f"`{c}`") for c in candidates if c in cols]
    if contains:
        picked += [F.col(f"`{c}`") for c in cols if contains.lower() in c.lower() and c not in candidates]
    if not picked:
        return F.lit(None).cast("double")
    return F.coalesce(*[p.cast("double") for p in picked])


def first_step(columns: Sequence[str], keys: Sequence[str] = ("step", "global_step", "epoch")) -> Column:
    """SF22: ``row.get(step) or row.get(global_step) or row.get(epoch)``: zero counts as absent
    except for the last key."""
    present = [k for k in keys if k in columns]
    if not present:
        return F.lit(None).cast("double")
    parts = [F.col(f"`{k}`").cast("double") if k == keys[-1]
             else F.nullif(F.col(f"`{k}`").cast("double"), F.lit(0.0)) for k in present]
    return F.coalesce(*parts)


def wall_micros(df, ts: str) -> Column:
    """Microseconds of a time column; wall-clock values (no time zone) field by field, so that no time zone moves them."""
    if df.schema[ts].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(ts)
    return F.expr(f"unix_date(to_date(`{ts}`)) * 86400000000L + hour(`{ts}`) * 3600000000L + minute(`{ts}`) * 60000000L"
                  f" + cast(extract(SECOND FROM `{ts}`) * 1000000 AS bigint)")
