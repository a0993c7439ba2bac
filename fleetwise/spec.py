"""The table contract: which columns are keys, signals and labels, and the fixed thresholds."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The signal channels, in their fixed order.
SIGNALS = (
    "engine_speed_rpm",
    "coolant_temp_c",
    "oil_pressure_kpa",
    "engine_load_pct",
    "fuel_rate_lph",
    "boost_pressure_kpa",
    "egt_c",
    "def_level_pct",
    "vibration_mms",
)

# Failure modes and anomaly families.
FAILURE_MODES = ("overheat", "oil_starve", "bearing")
OBVIOUS_FAMILIES = ("obvious_outlier",)
SUBTLE_FAMILIES = ("joint_outlier", "sensor_stuck", "sensor_drift")
FAMILIES = OBVIOUS_FAMILIES + SUBTLE_FAMILIES

# Plausible range of each signal, (low, high).
SIGNAL_BOUNDS = {
    "engine_speed_rpm": (600.0, 2500.0),
    "coolant_temp_c": (60.0, 160.0),
    "oil_pressure_kpa": (0.0, 550.0),
    "engine_load_pct": (0.0, 100.0),
    "fuel_rate_lph": (0.0, 220.0),
    "boost_pressure_kpa": (0.0, 300.0),
    "egt_c": (200.0, 760.0),
    "def_level_pct": (0.0, 100.0),
    "vibration_mms": (0.0, 30.0),
}

# Thresholds and budgets.
SEED = 42
TEST_SHARE = 0.25
FOLDS = 5
ALARM_BUDGET = 0.02
SUSPECT_FLAG = 0.5
SUSPECT_SPIKE = 3.0
HIGH_RISK = 0.5
FLAG_RISK = 0.70
REPEAT_MAX = 0.01
STUCK_MIN_RUN = 4
DRIFT_WINDOW = 12
DRIFT_SHARE_OF_STEPS = 0.9
MONOTONE_MAX = 0.15
HORIZON_EDGES_H = (0.0, 6.0, 24.0, 72.0, 168.0)  # the last band is open
OVERFIT_GAP = 0.15
TRIVIAL_AUC = 0.5
TRIVIAL_MARGIN = 0.005
DRIFTED_SHARE = 1.0 / 3.0
ROW_BUDGET = 200_000


@dataclass(frozen=True)
class TelemetrySpec:
    """Names the columns of a readings table and how its rows are ordered.

    ``position`` names a column holding 0, 1, 2, ... per unit with no gap and no repeat. Windows cut
    a unit into blocks of ``block_rows`` positions, so that a unit holding a large share of the
    table is spread over many tasks. When ``position`` is None the windows number the rows first.
    """

    unit: str = "unit_id"
    time: str = "t_index"
    clock: str = "timestamp_h"
    position: str | None = "t_index"
    signals: tuple[str, ...] = SIGNALS
    target: str = "failure_within_h"
    mode: str = "failure_mode"
    family: str = "anomaly_type"
    outlier: str = "is_outlier"
    window_rows: int = 24
    rollup_rows: int = 12
    block_rows: int = 4096

    @property
    def label_side(self) -> tuple[str, ...]:
        return (self.target, self.mode, self.family, self.outlier)

    @property
    def key(self) -> tuple[str, str]:
        return (self.unit, self.time)

    def but(self, **changes) -> "TelemetrySpec":
        return replace(self, **changes)


DEFAULT = TelemetrySpec()
