"""Column roles and value lists, kept in the metadata of a DataFrame's schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

ATTRIBUTE, CLASS, META, WEIGHT = "attribute", "class", "meta", "weight"
DISCRETE, CONTINUOUS, STRING, BASKET = "discrete", "continuous", "string", "basket"
#: Cells that stand for a missing value.
MISSING = ("", "?", ".", "~", "*", "NA")


@dataclass(frozen=True)
class Variable:
    """One column: its kind, role and, if discrete, its ordered values."""

    name: str
    kind: str = CONTINUOUS
    role: str = ATTRIBUTE
    values: tuple[str, ...] = ()
    ordered: bool = False
    flags: dict[str, str] = field(default_factory=dict)

    def metadata(self) -> dict:
        return {"kind": self.kind, "role": self.role, "values": list(self.values), "ordered": self.ordered, "flags": dict(self.flags)}


def with_roles(df: DataFrame, variables: list[Variable]) -> DataFrame:
    """The listed columns, in order, with their metadata; other columns go."""
    return df.select([F.col(f"`{v.name}`").alias(v.name, metadata=v.metadata()) for v in variables])


def domain(df: DataFrame) -> list[Variable]:
    """The variables of a table; columns without metadata get a kind from their type."""
    out = []
    for f in df.schema.fields:
        m = f.metadata or {}
        if "kind" in m:
            out.append(Variable(f.name, m["kind"], m.get("role", ATTRIBUTE), tuple(m.get("values", ())), m.get("ordered", False), m.get("flags", {})))
        elif isinstance(f.dataType, T.NumericType):
            out.append(Variable(f.name))
        else:
            out.append(Variable(f.name, STRING, META))
    return out


def of_role(df: DataFrame, role: str) -> list[str]:
    return [v.name for v in domain(df) if v.role == role]


def of_kind(df: DataFrame, kind: str) -> list[str]:
    return [v.name for v in domain(df) if v.kind == kind]


def class_column(df: DataFrame) -> str | None:
    return next(iter(of_role(df, CLASS)), None)


def weight(df: DataFrame) -> Column:
    """The weight of a row, 1 where there is none."""
    names = of_role(df, WEIGHT)
    return F.coalesce(F.col(f"`{names[0]}`").cast("double"), F.lit(1.0)) if names else F.lit(1.0)


def code(df: DataFrame, name: str) -> Column:
    """Place of a discrete value in its list, from 0; null where missing or unknown."""
    values = next(v.values for v in domain(df) if v.name == name)
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in values]), F.col(f"`{name}`")), F.lit(0)) - 1 if values else F.lit(None).cast("long")


def label(values: tuple[str, ...] | list[str], at: Column) -> Column:
    """The value at a code."""
    return F.get(F.array(*[F.lit(x) for x in values]), at.cast("int"))


def same_domain(a: DataFrame, b: DataFrame) -> bool:
    return domain(a) == domain(b)


def value_order(values) -> list[str]:
    """Alphabetic, except that a denial precedes its assertion."""
    first = {"no": 0, "none": 0, "absent": 0, "normal": 0, "false": 0, "yes": 1, "present": 1, "abnormal": 1, "true": 1}
    values = sorted(values)
    return sorted(values, key=lambda v: first.get(v.lower(), 0)) if len(values) == 2 and all(v.lower() in first for v in values) else values
