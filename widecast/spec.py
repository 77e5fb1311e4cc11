"""Typed description of a wide table: which column is what, and what it is for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T

KINDS = ("real", "integral", "picklist", "text")
ROLES = ("predictor", "response", "key", "ignored")


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str
    role: str = "predictor"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind!r}, expected one of {KINDS}")
        if self.role not in ROLES:
            raise ValueError(f"{self.name}: unknown role {self.role!r}, expected one of {ROLES}")


@dataclass(frozen=True)
class TableSpec:
    """An ordered set of features with at most one key and one response."""

    features: tuple[FeatureSpec, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        names = [f.name for f in self.features]
        repeated = sorted({n for n in names if names.count(n) > 1})
        if repeated:
            raise ValueError(f"columns declared twice: {repeated}")
        for role in ("key", "response"):
            if sum(f.role == role for f in self.features) > 1:
                raise ValueError(f"more than one {role} column")

    @classmethod
    def build(
        cls,
        key: str,
        label: str,
        real: Iterable[str] = (),
        integral: Iterable[str] = (),
        picklist: Iterable[str] = (),
        ignored: Iterable[str] = (),
    ) -> TableSpec:
        return cls(
            (
                FeatureSpec(key, "text", "key"),
                *(FeatureSpec(c, "real") for c in real),
                *(FeatureSpec(c, "integral") for c in integral),
                *(FeatureSpec(c, "picklist") for c in picklist),
                *(FeatureSpec(c, "text", "ignored") for c in ignored),
                FeatureSpec(label, "text", "response"),
            )
        )

    @classmethod
    def infer(
        cls,
        df: DataFrame,
        key: str,
        label: str,
        categories: Iterable[str] = (),
        ignored: Iterable[str] = (),
    ) -> TableSpec:
        """Kinds from the column types: strings and ``categories`` are pick lists, whole numbers
        integral, other numbers real."""
        categories, ignored = set(categories), set(ignored)
        absent = sorted((categories | ignored | {key, label}) - set(df.columns))
        if absent:
            raise ValueError(f"columns not in the table: {absent}")
        features = []
        for f in df.schema.fields:
            if f.name == key:
                features.append(FeatureSpec(f.name, "text", "key"))
            elif f.name == label:
                features.append(FeatureSpec(f.name, "text", "response"))
            elif f.name in ignored:
                features.append(FeatureSpec(f.name, "text", "ignored"))
            elif f.name in categories or isinstance(f.dataType, T.StringType):
                features.append(FeatureSpec(f.name, "picklist"))
            elif isinstance(f.dataType, T.IntegralType):
                features.append(FeatureSpec(f.name, "integral"))
            elif isinstance(f.dataType, T.NumericType):
                features.append(FeatureSpec(f.name, "real"))
            else:
                features.append(FeatureSpec(f.name, "text", "ignored"))
        return cls(tuple(features))

    def names(self, kind: str | None = None, role: str = "predictor") -> list[str]:
        return [f.name for f in self.features if f.role == role and kind in (None, f.kind)]

    @property
    def key(self) -> str:
        return self.names(role="key")[0]

    @property
    def label(self) -> str:
        return self.names(role="response")[0]

    @property
    def numeric(self) -> list[str]:
        return [f.name for f in self.features if f.role == "predictor" and f.kind in ("real", "integral")]

    @property
    def categorical(self) -> list[str]:
        return self.names("picklist")

    @property
    def predictors(self) -> list[str]:
        return self.names()

    def with_role(self, role: str, *columns: str) -> TableSpec:
        """The same table with the role of ``columns`` changed."""
        chosen = set(columns)
        return TableSpec(
            tuple(FeatureSpec(f.name, f.kind, role if f.name in chosen else f.role) for f in self.features)
        )

    def to_rows(self) -> list[tuple[str, str, str]]:
        return [(f.name, f.kind, f.role) for f in self.features]

    @classmethod
    def from_rows(cls, rows: Iterable[Iterable[str]]) -> TableSpec:
        return cls(tuple(FeatureSpec(*r) for r in rows))
