"""Three-valued predicates as columns.

A condition on a missing value is accepted (1), rejected (0) or ignored (-1);
ignored conditions are left out of the conjunction or disjunction they are in.
A condition is a pair: the predicate, and what it says of missing values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import class_column

ACCEPT, REJECT, IGNORE = 1, 0, -1


@dataclass(frozen=True)
class Condition:
    holds: Column
    missing: Column
    unknown: int = REJECT

    def alone(self) -> Column:
        return F.when(self.missing, F.lit(self.unknown != REJECT)).otherwise(self.holds)

    def inside(self, neutral: bool) -> Column:
        return F.when(self.missing, F.lit(neutral if self.unknown == IGNORE else self.unknown == ACCEPT)).otherwise(self.holds)


def continuous(name: str, op: str, low, high=None, unknown: int = REJECT) -> Condition:
    c = F.col(name)
    holds = {
        "equal": lambda: c == low, "not_equal": lambda: c != low, "less": lambda: c < low, "less_equal": lambda: c <= low,
        "greater": lambda: c > low, "greater_equal": lambda: c >= low, "between": lambda: c.between(low, high), "outside": lambda: (c < low) | (c > high),
    }[op]()
    return Condition(holds, c.isNull(), unknown)


def discrete(name: str, values: list[str], negate: bool = False, unknown: int = REJECT) -> Condition:
    """Negation turns what is said of missing values, too, unless they are ignored."""
    inside = F.col(name).isin(*values)
    return Condition(~inside if negate else inside, F.col(name).isNull(), 1 - unknown if negate and unknown != IGNORE else unknown)


def string(name: str, op: str, low: str, high: str | None = None, case_sensitive: bool = True, unknown: int = REJECT) -> Condition:
    c = F.col(name) if case_sensitive else F.lower(F.col(name))
    a, b = (x if case_sensitive or x is None else x.lower() for x in (low, high))
    holds = {
        "equal": lambda: c == a, "not_equal": lambda: c != a, "less": lambda: c < a, "less_equal": lambda: c <= a, "greater": lambda: c > a, "greater_equal": lambda: c >= a,
        "between": lambda: c.between(a, b), "outside": lambda: (c < a) | (c > b), "contains": lambda: c.contains(a), "not_contains": lambda: ~c.contains(a),
        "begins": lambda: c.startswith(a), "ends": lambda: c.endswith(a),
    }[op]()
    return Condition(holds, F.col(name).isNull(), unknown)


def string_list(name: str, values: list[str], negate: bool = False, case_sensitive: bool = True, unknown: int = REJECT) -> Condition:
    c = F.col(name) if case_sensitive else F.lower(F.col(name))
    inside = c.isin(*(values if case_sensitive else [v.lower() for v in values]))
    return Condition(~inside if negate else inside, F.col(name).isNull(), unknown)


def is_defined(name: str) -> Condition:
    return Condition(F.col(name).isNotNull(), F.lit(False))


def conjunction(conditions: list[Condition], negate: bool = False) -> Column:
    out = reduce(and_, (c.inside(True) for c in conditions), F.lit(True))
    return ~out if negate else out


def disjunction(conditions: list[Condition], negate: bool = False) -> Column:
    out = reduce(or_, (c.inside(False) for c in conditions), F.lit(False))
    return ~out if negate else out


def any_of_all(groups: list[list[Condition]]) -> Column:
    """A disjunction of conjunctions."""
    return reduce(or_, (conjunction(g) for g in groups), F.lit(False))


def split(df: DataFrame, holds: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that match, and all others."""
    known = F.coalesce(holds, F.lit(False))
    return df.where(known), df.where(~known)


def has_missing(columns: list[str]) -> Column:
    return reduce(or_, (F.col(c).isNull() for c in columns), F.lit(False))


def all_defined(columns: list[str]) -> Column:
    return ~has_missing(columns)


def has_class_value(df: DataFrame) -> Column:
    return F.col(class_column(df)).isNotNull()


def has_item(basket: str, item: str) -> Column:
    """A row's basket or map of optional metas has the item."""
    return F.coalesce(F.map_contains_key(basket, item), F.lit(False))


def same_value(name: str, value, negate: bool = False) -> Column:
    """Numbers agree within 1e-6; a missing value agrees with nothing."""
    c = F.col(name)
    equal = F.abs(c - value) < 1e-6 if isinstance(value, (int, float)) else c == value
    out = F.coalesce(equal, F.lit(False))
    return ~out if negate else out


def same_row(reference: dict, negate: bool = False) -> Column:
    out = reduce(and_, (F.col(k).eqNullSafe(F.lit(v)) for k, v in reference.items()), F.lit(True))
    return ~out if negate else out


def compatible_row(reference: dict, negate: bool = False) -> Column:
    """Each value equals that of the reference, or one of the two is missing."""
    pairs = [(F.col(k), v) for k, v in reference.items() if v is not None]
    out = reduce(and_, (c.isNull() | (F.abs(c - v) < 1e-6 if isinstance(v, (int, float)) else c == v) for c, v in pairs), F.lit(True))
    return ~out if negate else out


def random_rows(p: float = 0.5, seed: int = 0) -> Column:
    return F.rand(seed) < p


def quick_select(df: DataFrame, column: str, values: list) -> tuple[DataFrame, DataFrame]:
    """Rows with one of some values, and all others."""
    holds = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return df.where(holds), df.where(~holds)
