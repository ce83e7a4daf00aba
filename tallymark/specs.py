"""Typed settings shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal


@dataclass(frozen=True)
class CompareSpec:
    """How two datasets are compared.

    ``keys`` empty means a multiset comparison over all common columns.
    ``tolerance`` is an absolute tolerance for every numeric non-key column.
    """

    keys: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    tolerance: Decimal | float | str = Decimal(0)
    sample: int = 20

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "ignore", tuple(self.ignore))
        object.__setattr__(self, "tolerance", Decimal(str(self.tolerance)))
        if self.tolerance < 0:
            raise ValueError("tolerance must not be negative")


RULE_KINDS = ("exact-match", "range", "format", "custom", "null-check", "type-check")
SEVERITIES = ("critical", "warning", "info")


@dataclass(frozen=True)
class Rule:
    """One row rule.

    ``range`` uses ``minimum``/``maximum``, or ``target`` with ``tolerance``;
    ``exact-match`` compares with ``target`` (a column name);
    ``format`` uses ``pattern``; ``custom`` a boolean SQL expression that is
    true for good rows; ``type-check`` a SQL type in ``type_name``.
    """

    name: str
    column: str
    kind: str
    minimum: float | int | Decimal | None = None
    maximum: float | int | Decimal | None = None
    target: str | None = None
    tolerance: float | Decimal | None = None
    pattern: str | None = None
    expression: str | None = None
    type_name: str | None = None
    allow_null: bool = True
    severity: str = "critical"
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.kind not in RULE_KINDS:
            raise ValueError(f"unknown rule kind {self.kind!r}; expected one of {RULE_KINDS}")
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.severity!r}; expected one of {SEVERITIES}")


@dataclass(frozen=True)
class FilterSpec:
    """Business filters of the loan jobs."""

    closed_statuses: tuple[str, ...] = ("10", "40", "45")
    min_date: date = date(1899, 12, 31)
    max_date: date = date(2999, 12, 31)
    latest_flag: str = "Y"
    balance_table_id: int = 2


@dataclass(frozen=True)
class RateLimit:
    """``per_minute`` tokens flow into a bucket that holds ``burst`` of them."""

    per_minute: int
    burst: int

    @property
    def interval_us(self) -> int:
        if 60_000_000 % self.per_minute:
            raise ValueError("60 s must be a whole number of microseconds per token")
        return 60_000_000 // self.per_minute


# Requests per minute and burst by priority; no entry means no limit.
DEFAULT_LIMITS = {1: RateLimit(10, 5), 2: RateLimit(30, 10), 3: RateLimit(100, 20)}

# Penalty per finding kind in the confidence score.
PENALTIES = {
    "table_missing": 15,
    "schema_drift": 15,
    "count_mismatch": 15,
    "key_skew": 5,
    "empty_dataset": 3,
    "no_tables": 2,
}


@dataclass(frozen=True)
class TextRule:
    """A named regular expression applied to whole statements or files."""

    name: str
    pattern: str
    severity: str = "WARNING"
    message: str | None = None


@dataclass(frozen=True)
class SourceSpec:
    """Where a dataset lives: a path with its format, or a table name."""

    format: str = "parquet"
    path: str | None = None
    table: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, uri: str) -> "SourceSpec":
        fmt, sep, path = uri.partition(":")
        if not sep or not path:
            raise ValueError("expected a dataset address like 'parquet:/path' or 'csv:/path'")
        fmt = fmt.lower()
        if fmt == "table":
            return cls(table=path)
        if fmt not in ("parquet", "csv", "delta", "json", "orc"):
            raise ValueError(f"unsupported format: {fmt}")
        return cls(format=fmt, path=path)
