"""Scalar columns: cleaning, guarded arithmetic, time units, calendar, loose number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def clean(x: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b where b is over 0."""
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(otherwise))


def epoch_seconds(x: Column) -> Column:
    """Seconds of an epoch number whose unit (ns, us, ms or s) shows in its size, row by row."""
    n = F.abs(x)
    return F.when(n >= 10**18, F.floor(x / 10**9)).when(n >= 10**15, F.floor(x / 10**6)).when(n >= 10**12, F.floor(x / 10**3)).otherwise(x).cast("long")


def third_friday(day: Column) -> Column:
    """Third Friday of the day's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "FR"), 14)


def days_to_monthly_expiry(day: Column, cap: int = 30) -> Column:
    here, after = third_friday(day), third_friday(F.add_months(F.trunc(day, "MM"), 1))
    return F.least(F.datediff(F.when(day <= here, here).otherwise(after), day), F.lit(cap))


def days_to_friday(day: Column) -> Column:
    """0 on Friday and, as the weekday arithmetic has it, counted over five-day weeks."""
    return F.pmod(4 - F.weekday(day), F.lit(5))


def minute_of_session(ts: Column) -> Column:
    """Minutes since 9:30."""
    return F.hour(ts) * 60 + F.minute(ts) - 570


def parse_value(text: Column) -> Column:
    """'0.3%', '120K', '-785M', '3.94|1.8' (the first) to a number; blank or unreadable to null."""
    first = F.trim(F.split(text, r"\|").getItem(0))
    mark = F.upper(F.right(first, F.lit(1)))
    number = F.regexp_replace(first, "[%KkMmBbTt]$", "").try_cast("double")
    return number * F.when(mark == "K", 1e3).when(mark == "M", 1e6).when(mark == "B", 1e9).when(mark == "T", 1e12).otherwise(1.0)


def huber(error: Column, delta: float = 0.25) -> Column:
    e = F.abs(error)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def spike_weight(target: Column) -> Column:
    return F.when(F.abs(target) >= 4, 5.0).when(F.abs(target) >= 2, 3.0).otherwise(1.0)


def path_year(path: Column) -> Column:
    """Year of a path: a folder of four digits, else the start of the file name before - or _; null where there is none."""
    folder = F.regexp_extract(path, r"(?:^|/)(\d{4})/", 1)
    name = F.regexp_extract(path, r"(?:^|/)(\d{4})[-_][^/]*$", 1)
    return F.when(folder != "", folder).when(name != "", name).cast("int")


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column, low: float, high: float) -> Column:
    """x held between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def from_epoch_ns(x: Column) -> Column:
    """Timestamp of whole nanoseconds since 1970, cut to microseconds without going through a double."""
    micros = F.call_function("div", x - F.pmod(x, F.lit(1000)), F.lit(1000))
    return F.timestamp_micros(micros)


def time_of_day(ts: Column) -> Column:
    """Minutes of the day over 1440."""
    return (F.hour(ts) * 60 + F.minute(ts)) / 1440.0


def day_share(x: Column) -> Column:
    """A time of day as a share of the day: what is over 1 was in hours."""
    return F.when(x > 1, x / 24.0).otherwise(x)


def parse_time(day: Column, time: Column) -> Column:
    """'2024/01/05' and '13:30' to a timestamp, or one ISO 8601 text in `day`; unreadable to null."""
    both = F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("yyyy/MM/dd HH:mm"))
    return F.coalesce(both, F.try_to_timestamp(day))


def fiscal_year(day: Column) -> Column:
    """Until March the year before."""
    return F.year(day) - (F.month(day) <= 3).cast("int")


def fiscal_quarter(day: Column) -> Column:
    """The quarter whose figures are out: January to March Q4, then Q1, Q2 and Q3."""
    return F.concat(F.lit("Q"), F.when(F.month(day) <= 3, 4).otherwise(F.quarter(day) - 1).cast("string"))


def filed_at(day: Column) -> Column:
    """Filings count from four in the afternoon of their day, UTC."""
    return day.cast("timestamp_ntz") + F.expr("INTERVAL 16 HOURS")


def parse_list(text: Column) -> Column:
    """"['A', 'B']" to an array; blank to an empty one."""
    inside = F.trim(F.regexp_replace(text, r"[\[\]'\"]", ""))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inside, ","), lambda x: F.trim(x)))


def zero_pad(x: Column, width: int = 10) -> Column:
    """At least `width` characters, zeros in front; longer ones stay whole."""
    text = x.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def short_name(name: Column, width: int = 8) -> Column:
    return F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("_")), 1, width)


def ordinal(x: Column, levels: str = "NLMH") -> Column:
    """Place of a one-letter level, 0 for others."""
    return F.greatest(F.instr(F.lit(levels), F.when(F.length(x) == 1, x)) - 1, F.lit(0))


def surprise(actual: Column, expected: Column) -> Column:
    """Percent of the expected value, 0 where that is 0."""
    return F.when(expected == 0, 0.0).otherwise((actual - expected) / F.abs(expected) * 100)


def annualised(rv: Column, bars_a_day: int, days: int = 252) -> Column:
    """Realised volatility of a bar as percent a year."""
    return rv * float((days * bars_a_day) ** 0.5) * 100


def time_encoding(seconds: Column, width: int) -> Column:
    """Sines, then cosines, of the seconds of the day at width / 2 falling frequencies."""
    half, of_day = width // 2, F.pmod(seconds, F.lit(86400))
    angle = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: of_day * F.exp(-i * F.log(F.lit(10000.0)) / half))
    return F.concat(F.transform(angle, F.sin), F.transform(angle, F.cos))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def film(x: Column, gamma: Column, beta: Column) -> Column:
    """A feature scaled and moved by what conditions it."""
    return gamma * x + beta


def gated(gate: Column, a: Column, b: Column) -> Column:
    return gate * a + (1 - gate) * b


def first_range(x: Column, ranges: list[tuple[int, int, str]], otherwise: str) -> Column:
    """Name of the first range [low, high) that has x."""
    out = F.lit(otherwise)
    for low, high, name in reversed(ranges):
        out = F.when((x >= low) & (x < high), name).otherwise(out)
    return out


def exact_mean(x: Column) -> Column:
    """Aggregate: the mean from a sum in decimals of ten places, so that no order of summation shows at a rounding tie; the usual mean where a value has no such decimal."""
    d = x.try_cast("decimal(28,10)")
    return F.when(F.count(d) == F.count(x), (F.sum(d) / F.count(d)).cast("double")).otherwise(F.avg(x))
