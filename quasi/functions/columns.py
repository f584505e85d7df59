"""Scalar column expressions for survey cleaning, recoding, dates, text and effects.

All of them are compositions of built-in functions and stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- missing values, bounds, bins


def sentinel_to_null(c: ColumnLike, codes: Sequence[int] = (-9, -8)) -> Column:
    """Null where the value is one of the sentinel codes."""
    c = as_col(c)
    return F.when(~c.isin(list(codes)), c)


def clip_floor(c: ColumnLike, floor: float = 0.0) -> Column:
    """Values below the floor become the floor; null stays null."""
    c = as_col(c)
    return F.when(c < floor, F.lit(floor)).otherwise(c)


def null_to_zero(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c), F.lit(0.0))


def topcode(c: ColumnLike, cap: float) -> dict[str, Column]:
    """Capped value with its three indicators: zero, at the cap, and the value where not capped."""
    c = as_col(c)
    value = F.when(c > cap, F.lit(cap)).otherwise(c)
    at_cap = (value == F.lit(cap)).cast("double")
    return {
        "income": value,
        "i_0": (value == F.lit(0.0)).cast("double"),
        "i_m": at_cap,
        "i_l": value * (1.0 - at_cap),
    }


def _edge(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def interval_labels(breaks: Sequence[float], right: bool, include_lowest: bool) -> list[str]:
    """Interval labels; with include_lowest the first (or last) one is closed on both sides."""
    n = len(breaks) - 1
    out = []
    for i in range(n):
        left = "(" if right and not (include_lowest and i == 0) else "["
        end = "]" if right or (include_lowest and i == n - 1) else ")"
        out.append(f"{left}{_edge(breaks[i])},{_edge(breaks[i + 1])}{end}")
    return out


def cut(
    c: ColumnLike,
    breaks: Sequence[float],
    right: bool = True,
    include_lowest: bool = False,
    labels: Sequence[str] | None = None,
) -> Column:
    """Interval binning with either closure; values outside the breaks become null.

    right=True gives (a, b], right=False gives [a, b). include_lowest closes the otherwise open outer
    end. ``labels`` may be strings or numbers, one per interval.
    """
    c = as_col(c)
    n = len(breaks) - 1
    names = list(labels) if labels is not None else interval_labels(breaks, right, include_lowest)
    if len(names) != n:
        raise ValueError(f"{n} intervals need {n} labels, got {len(names)}")
    out = None
    for i in range(n):
        lo, hi = F.lit(breaks[i]), F.lit(breaks[i + 1])
        if right:
            low_ok = c >= lo if (include_lowest and i == 0) else c > lo
            high_ok = c <= hi
        else:
            low_ok = c >= lo
            high_ok = c <= hi if (include_lowest and i == n - 1) else c < hi
        out = (F if out is None else out).when(low_ok & high_ok, F.lit(names[i]))
    return out


# ---------------------------------------------------------------- recodes and factors


def recode(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First matching rule wins; a rule whose condition is null does not match."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = (F if out is None else out).when(condition, value)
    return out if default is None else out.otherwise(F.lit(default))


def rule_usage(df, rules: Sequence[tuple[Column, object]]):
    """Per rule: rows it matches and rows it is the first to match; 0 first matches is unreachable."""
    first = recode([(c, i + 1) for i, (c, _) in enumerate(rules)])
    counts = df.agg(
        *[F.count(F.when(c, 1)).alias(f"m{i}") for i, (c, _) in enumerate(rules)],
        *[F.count(F.when(first == i + 1, 1)).alias(f"f{i}") for i in range(len(rules))],
    )
    entries = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("rule"), F.lit(str(label)).alias("label"),
            F.col(f"m{i}").alias("matches"), F.col(f"f{i}").alias("first_matches"),
        )
        for i, (_, label) in enumerate(rules)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def any_match(columns: Sequence[str], value: object) -> Column:
    """True when any of the columns equals the value; nulls never match."""
    return reduce(or_, [F.coalesce(F.col(c) == F.lit(value), F.lit(False)) for c in columns])


def label_levels(c: ColumnLike, labels: Mapping[object, str]) -> Column:
    """Codes to labels; codes without a label become null."""
    c = as_col(c)
    return recode([(c == F.lit(code), label) for code, label in labels.items()])


def lump_other(c: ColumnLike, keep: Sequence[str], other: str = "Other") -> Column:
    """Keep the named levels and put every other non-null level under one label."""
    c = as_col(c).cast("string")
    return F.when(c.isin(list(keep)), c).when(c.isNotNull(), F.lit(other))


def collapse_levels(c: ColumnLike, groups: Mapping[str, Sequence[str]]) -> Column:
    """Many-to-one level mapping; levels in no group keep their own name."""
    c = as_col(c).cast("string")
    out = None
    for label, members in groups.items():
        out = (F if out is None else out).when(c.isin(list(members)), F.lit(label))
    return out.otherwise(c)


def level_order(c: ColumnLike, levels: Sequence[str]) -> Column:
    """Position of a level in an explicit order, for sorting labelled results."""
    return F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))


def letter_region(code: ColumnLike) -> Column:
    """Region code to letter: codes below 3 shift by two letters, the rest by one, so 2 and 3 share D."""
    code = as_col(code)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    index = F.when(code < 3, code + 2).otherwise(code + 1)
    return F.substring(F.lit(letters), index.cast("int"), F.lit(1))


# ---------------------------------------------------------------- dates and periods


def parse_survey_date(c: ColumnLike) -> Column:
    """Undelimited ddmmyyyy, possibly a number without its leading zero, to a date; null if invalid."""
    text = F.lpad(F.trim(as_col(c).cast("string")), 8, "0")
    return F.try_to_timestamp(text, F.lit("ddMMyyyy")).cast("date")


def month_start(c: ColumnLike) -> Column:
    return F.trunc(as_col(c), "MM")


def period_index(c: ColumnLike, origin_year: int, unit: str = "month") -> Column:
    """1-based month or quarter number counted from January of the origin year."""
    c = as_col(c)
    within, per_year = {"month": (F.month(c), 12), "quarter": (F.quarter(c), 4)}[unit]
    return within + (F.year(c) - origin_year) * per_year


# ---------------------------------------------------------------- repeated-answer columns


def count_code(columns: Sequence[str], code: int) -> Column:
    """How many of the repeated-answer columns carry the code."""
    return reduce(add, [F.when(F.col(c) == code, 1).otherwise(0) for c in columns])


def count_codes(columns: Sequence[str], codes: Mapping[str, int]) -> dict[str, Column]:
    """A count and a 0/1 flag per named code."""
    out: dict[str, Column] = {}
    for name, code in codes.items():
        n = count_code(columns, code)
        out[name] = n
        out[f"{name}_flag"] = (n > 0).cast("int")
    return out


def claim_type(
    new: ColumnLike,
    legacy: ColumnLike,
    labels: tuple[str, str, str] = ("Combination", "New", "Legacy"),
) -> Column:
    """Both benefits, only the new one, only a legacy one; null when neither is claimed."""
    new, legacy = as_col(new) > 0, as_col(legacy) > 0
    return recode([(new & legacy, labels[0]), (new, labels[1]), (legacy, labels[2])])


# ---------------------------------------------------------------- text

# Patterns of the published effect sentences "<est> ... (<low> to <high>)".
ESTIMATE_PATTERN = r"(-?0\.\d*)"
LOWER_PATTERN = r"\((-?0\.\d*)"
UPPER_PATTERN = r"to (-?0\.\d*)"


def extract_numbers(text: ColumnLike, patterns: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Numbers out of prose: first capture group of each pattern, null when absent."""
    text = as_col(text)
    patterns = patterns or {
        "estimate": ESTIMATE_PATTERN,
        "cl": LOWER_PATTERN,
        "cu": UPPER_PATTERN,
    }
    return {
        name: F.regexp_extract(text, pattern, 1).try_cast("double")
        for name, pattern in patterns.items()
    }


def split_column(c: ColumnLike, separator: str, into: Mapping[str, str]) -> dict[str, Column]:
    """One string into named, typed columns; missing or unparsable pieces become null."""
    pieces = F.split(as_col(c), F.lit("\\Q" + separator + "\\E"))
    return {
        name: F.get(pieces, i).try_cast(dtype) for i, (name, dtype) in enumerate(into.items())
    }


def format_effect(est: ColumnLike, lo: ColumnLike, hi: ColumnLike) -> Column:
    return F.format_string("%.2f (%.2f, %.2f)", as_col(est), as_col(lo), as_col(hi))


def format_percent(share: ColumnLike, dp: int = 1) -> Column:
    return F.format_string(f"%.{dp}f%%", as_col(share) * 100.0)


# ---------------------------------------------------------------- effects and treatment


def composite(plus: Sequence[str], minus: Sequence[str] = ()) -> Column:
    """Sum of components less reductions; null if any component is null."""
    total = reduce(add, [F.col(c) for c in plus])
    for c in minus:
        total = total - F.col(c)
    return total


def effect_from_ci(est: ColumnLike, lo: ColumnLike, hi: ColumnLike, alpha: float = 0.05) -> dict[str, Column]:
    """Standard error, two-sided p and significance from a 95 % interval."""
    from quasi.functions.special import normal_cdf

    se = (as_col(hi) - as_col(lo)) / (2 * 1.96)
    p = 2.0 * normal_cdf(-F.abs(as_col(est)) / se)
    return {"se": se, "p": p, "signif": (p < alpha).cast("int")}


def treated(time: ColumnLike, timing: ColumnLike) -> Column:
    """1 from the treatment period on; timing 0 or null means never treated."""
    time, timing = as_col(time), as_col(timing)
    return F.when((timing != 0) & (time >= timing), 1).otherwise(0)


def relative_time(time: ColumnLike, timing: ColumnLike) -> Column:
    """Periods since treatment; null for the never treated."""
    time, timing = as_col(time), as_col(timing)
    return F.when(timing != 0, time - timing)


def inject_effect(y: ColumnLike, time: ColumnLike, timing: ColumnLike, effect: ColumnLike) -> Column:
    """Outcome plus (time - timing) * effect after treatment."""
    y = as_col(y)
    gap = as_col(time) - as_col(timing)
    return F.when(treated(time, timing) == 1, y + gap * as_col(effect)).otherwise(y)


def scale_effect(est: ColumnLike, share: ColumnLike) -> Column:
    """Effect per exposed person; null when nobody is exposed."""
    return F.try_divide(as_col(est), as_col(share))


def benefit_change_class(new: ColumnLike, old: ColumnLike, band: float = 0.02) -> Column:
    """Decrease / No change / Increase by relative change.

    Both amounts zero is no change; any gain from a zero base counts as an increase.
    """
    new, old = as_col(new), as_col(old)
    change = new - old
    ratio = F.try_divide(change, old)
    return recode(
        [
            ((new == 0) & (old == 0), "No change"),
            (F.when(old == 0, change > 0).otherwise(ratio >= band), "Increase"),
            (F.abs(ratio) < band, "No change"),
        ],
        default="Decrease",
    )


def unit_hash(key: ColumnLike, seed: object) -> Column:
    """md5 of key and seed, the repeatable random order used by every sampling operator."""
    return F.md5(F.concat_ws("|", as_col(key).cast("string"), F.lit(str(seed))))


def unit_uniform(key: ColumnLike, seed: object) -> Column:
    """Uniform number in [0, 1) from the first eight hex digits of the unit hash."""
    return F.conv(F.substring(unit_hash(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0
