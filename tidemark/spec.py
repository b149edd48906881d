"""What to monitor: frozen descriptions without any execution of their own."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Union

BASELINE = "BASELINE"
INPUT = "INPUT"
CONSECUTIVE = "CONSECUTIVE"
TABLE = ":table"
ALL_STAGES = "*"


@dataclass(frozen=True)
class GenericTable:
    """A table without a time column; every refresh is its own window."""


@dataclass(frozen=True)
class TimeSeries:
    timestamp_col: str


@dataclass(frozen=True)
class InferenceLog:
    timestamp_col: str
    prediction_col: str
    model_version_col: str
    problem_type: str  # "classification" or "regression"
    label_col: str | None = None
    example_id_col: str | None = None
    model_stage_col: str | None = None


Analysis = Union[GenericTable, TimeSeries, InferenceLog]


@dataclass(frozen=True)
class Metric:
    """A user metric given as SQL text.

    ``aggregate`` definitions may use ``{{column_name}}``; ``derived`` ones refer to
    metrics of the same row; ``drift`` ones to ``{{current_df}}`` and ``{{base_df}}``.
    """

    metric_type: str
    metric_name: str
    input_columns: tuple[str, ...]
    metric_definition: str
    output_type: str = "double"

    def __post_init__(self):
        if self.metric_type not in ("aggregate", "derived", "drift"):
            raise ValueError(f"unknown metric type {self.metric_type!r}")
        object.__setattr__(self, "input_columns", tuple(self.input_columns))


@dataclass(frozen=True)
class MonitorSpec:
    analysis: Analysis = field(default_factory=GenericTable)
    granularities: tuple[str, ...] = ()
    slicing_exprs: tuple[str, ...] = ()
    custom_metrics: tuple[Metric, ...] = ()
    columns: tuple[str, ...] | None = None
    # Distinct counts, medians and Kolmogorov-Smirnov distances are estimates from mergeable
    # sketches, in the same single pass as the other metrics, and categories are compared by
    # counts of at most ``category_classes`` classes of values per group and column; exact
    # ones take value counts of every column.
    exact: bool = False
    category_classes: int = 4096

    def __post_init__(self):
        for name in ("granularities", "slicing_exprs", "custom_metrics"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.columns is not None:
            object.__setattr__(self, "columns", tuple(self.columns))
        if self.category_classes < 1:
            raise ValueError("category_classes must be at least 1")
        if isinstance(self.analysis, GenericTable):
            if self.granularities:
                raise ValueError("a generic table has no time column to cut into windows")
        elif not self.granularities:
            raise ValueError("at least one granularity is needed")
        if isinstance(self.analysis, InferenceLog) and self.analysis.problem_type not in (
            "classification",
            "regression",
        ):
            raise ValueError(f"unknown problem type {self.analysis.problem_type!r}")

    def with_params(self, **params: Any) -> "MonitorSpec":
        return replace(self, **params)

    @property
    def timestamp_col(self) -> str | None:
        return getattr(self.analysis, "timestamp_col", None)

    def metrics_of(self, metric_type: str) -> list[Metric]:
        return [m for m in self.custom_metrics if m.metric_type == metric_type]
