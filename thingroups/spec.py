"""Declarations: tables, predicates, queries and run settings.

Everything here is plain description; no Spark job starts from this module.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# The comparison operators a predicate may use, the column
# kinds a table may declare and the aggregates a query may ask for.
OPERATORS = ("=", ">", ">=", "<", "<=")
KINDS = ("int", "str", "num")
AGGREGATES = ("AVG", "SUM", "COUNT")


@dataclass(frozen=True)
class TableSpec:
    """A table: its columns with their kind, and how its rows are identified.

    ``int`` and ``str`` columns are categorical, ``num`` columns continuous.
    ``scales`` gives the number of decimal places of a ``num`` column; sums of
    such a column are taken in decimal, so that they do not depend on the order
    in which tasks deliver their parts. A generated value counts with as many
    decimals as a stored one.
    """

    name: str
    kinds: Mapping[str, str]
    row_key: tuple[str, ...] = ()
    is_fact: bool = False
    rows: int | None = None
    index_rate: float = 1.0
    scales: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for column, kind in self.kinds.items():
            if kind not in KINDS:
                raise ValueError(f"column '{column}' of '{self.name}' has unknown kind '{kind}'")
        if not 0 < self.index_rate <= 1:
            raise ValueError(f"index rate of '{self.name}' must lie in (0, 1]")

    @property
    def columns(self) -> list[str]:
        return list(self.kinds)

    @property
    def categorical(self) -> list[str]:
        return [c for c, kind in self.kinds.items() if kind != "num"]

    @property
    def numeric(self) -> list[str]:
        return [c for c, kind in self.kinds.items() if kind == "num"]

    @property
    def stored_columns(self) -> list[str]:
        """Declared columns plus the row key, each once."""
        return list(dict.fromkeys([*self.row_key, *self.kinds]))


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: object

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unsupported operator '{self.op}' on '{self.column}'")

    @property
    def is_range(self) -> bool:
        return self.op != "="


@dataclass(frozen=True)
class JoinSpec:
    """Inner equi-join of the fact table with one dimension."""

    dimension: str
    fact_key: str
    dim_key: str


@dataclass(frozen=True)
class AggQuery:
    """``SELECT group, AGG(measure) FROM table [JOIN ..] WHERE .. GROUP BY group``."""

    func: str
    measure: str
    table: str
    group: str
    predicates: tuple[Predicate, ...] = ()
    join: JoinSpec | None = None

    def __post_init__(self):
        if self.func not in AGGREGATES:
            raise ValueError(f"unsupported aggregate '{self.func}'")

    def with_func(self, func: str) -> "AggQuery":
        return AggQuery(func, self.measure, self.table, self.group, self.predicates, self.join)


@dataclass(frozen=True)
class RunConfig:
    """Settings of a staged run; the defaults are the documented ones."""

    sample_rate: float = 0.1
    topup_rows: int = 100
    max_batches: int = 10
    batch_rows: int = 10
    epsilon: float = 0.5
    bins: int = 100
    seed: int = 42
    repair: str = "topup"          # or "generate"
    topup_source: str = "rows"     # or "index": rows are chosen on the bitmap index
    count_mode: str = "interpolate"  # or "reference" / "exact" / "tight" (with a packed index)
    allow_duplicates: bool = False
    null_share: bool = True

    def __post_init__(self):
        if self.repair not in ("topup", "generate"):
            raise ValueError(f"unknown repair '{self.repair}'")
        if self.topup_source not in ("rows", "index"):
            raise ValueError(f"unknown source of top-up rows '{self.topup_source}'")
        if self.count_mode not in ("interpolate", "reference", "exact", "tight"):
            raise ValueError(f"unknown count mode '{self.count_mode}'")


@dataclass(frozen=True)
class Between:
    """Closed interval a generated numeric cell is drawn from."""

    column: str
    lo: float
    hi: float
