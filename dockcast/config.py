"""City rules and run parameters.

Everything that decides *what* a request means lives here as plain data, so
the operators stay generic and a new city is one more entry.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values that must equal the reference's behaviour -----------------
# Valid ranges of a request (inclusive), per city.
HOUR_RANGE = (0, 23)
WEEKDAY_RANGE = (1, 7)  # 1 = Sunday ... 7 = Saturday
MONTH_RANGE = (1, 12)

# Barcelona: stations 1..519 (Q12: the code's 519, not the documented 505);
# "latest" looked back 9 h; earliest readings after now-3h, now-6h, now-9h
# (Q3: the 3 h lag is read, not left at 0); recursion step 3 h, at most 9 steps.
# Santander: stations 1..17; "latest" looked back 15 h; earliest readings after
# now-5h, now-10h, now-15h; recursion step 5 h, at most 5 steps.  Q16: its
# model does not use the hour, so only the step count moves its forecast.
# Q13: month is never a feature and weekday only for Malaga; both still pass
# through to the response.
# Malaga: stations 0..9; no history lookups (lags are zero); one step;
# output is the predicted occupancy class times 10.
# Malaga station numbers are positions in this list of car-park names:
MALAGA_STATION_NAMES = [
    "Salitre", "Cervantes", "El_Palo", "Av._de_Andalucia", "Camas",
    "Cruz_De_Humilladero", "Alcazaba", "San_Juan_De_La_Cruz",
    "Pz._de_la_Marina", "Tejon_y_Rodriguez",
]
# Response entity attributes are wrapped as {"value": ..., "type": "Property"}.
PROPERTY_TYPE = "Property"
# Sentinel answer for a request that cannot be scored.
UNAVAILABLE = -1
# History is kept for the last 24 h at a 30 minute cadence.
RETENTION_HOURS = 24
CADENCE_MINUTES = 30
# ---------------------------------------------------------------------------

# Request status values (one column instead of the reference's shared flag).
OK = "ok"
MALFORMED = "malformed"
UNKNOWN_CITY = "unknown_city"
INVALID = "invalid_request"
NO_HISTORY = "no_history"


@dataclass(frozen=True)
class Lookup:
    """One lag slot: the reading picked from the window (now - k units, now]."""

    slot: int  # 1..4 -> last / two_last / three_last / four_last measure
    kind: str  # "latest" (newest in window) or "earliest" (oldest in window)
    k: int  # window length in lag units


@dataclass(frozen=True)
class CityRule:
    city: str
    station_min: int
    station_max: int
    lookups: tuple[Lookup, ...]
    # model feature name of each lag slot (P7 renames)
    slot_features: dict[int, str]
    features: tuple[str, ...]
    step: int | None  # recursion step in hours; None = single step
    max_steps: int  # guard: more steps than this (or <= 1) -> one step
    output_scale: int  # 1 for counts, 10 for occupancy class -> percent
    label: str
    task: str  # "regression" | "classification"
    tree_depth: int = 5
    num_trees: int = 1
    train_lags: dict[str, int] = field(default_factory=dict)

    @property
    def lookback(self) -> int:
        return max((lk.k for lk in self.lookups), default=0)

    @property
    def unrolled_steps(self) -> int:
        """Most model applications a valid request can need (hour in 0..23)."""
        if self.step is None:
            return 1
        return min(self.max_steps, (HOUR_RANGE[1] - HOUR_RANGE[0]) // self.step + 1)


BARCELONA = CityRule(
    city="Barcelona",
    station_min=1,
    station_max=519,
    lookups=(
        Lookup(1, "latest", 9),
        Lookup(2, "earliest", 3),
        Lookup(3, "earliest", 6),
        Lookup(4, "earliest", 9),
    ),
    slot_features={1: "three_before", 2: "six_before", 3: "nine_before"},
    features=("id_station", "three_before", "six_before", "nine_before", "hour"),
    step=3,
    max_steps=9,
    output_scale=1,
    label="available_bikes",
    task="regression",
    tree_depth=10,
    train_lags={"three_before": 3, "six_before": 6, "nine_before": 9},
)

SANTANDER = CityRule(
    city="Santander",
    station_min=1,
    station_max=17,
    lookups=(
        Lookup(1, "latest", 15),
        Lookup(2, "earliest", 5),
        Lookup(3, "earliest", 10),
        Lookup(4, "earliest", 15),
    ),
    slot_features={1: "five_before", 2: "ten_before", 3: "fifteen_before", 4: "twenty_before"},
    features=("id_station", "five_before", "ten_before", "fifteen_before", "twenty_before"),
    step=5,
    max_steps=5,
    output_scale=1,
    label="available_bikes",
    task="regression",
    tree_depth=8,
    train_lags={"five_before": 5, "ten_before": 10, "fifteen_before": 15, "twenty_before": 20},
)

MALAGA = CityRule(
    city="Malaga",
    station_min=0,
    station_max=9,
    lookups=(),
    slot_features={},
    features=("name", "weekday", "hour"),
    step=None,
    max_steps=1,
    output_scale=10,
    label="occupation",
    task="classification",
    num_trees=100,
)

CITY_RULES: dict[str, CityRule] = {r.city: r for r in (BARCELONA, SANTANDER, MALAGA)}

# Driver tables stand in for the live feeds: event_type -> city.  Types
# without a city exercise the unknown-city rule.
EVENT_TYPE_CITY = {"click": "Barcelona", "view": "Santander", "purchase": "Malaga"}
OTHER_CITY = "Other"

HOUR = 3600
DAY = 86400


@dataclass(frozen=True)
class RunParams:
    """Knobs of one scoring run.

    ``lag_unit`` is the length of one lag unit in seconds: 3600 gives the
    reference's hour-based windows; a larger unit stretches every window
    (the synthetic history is sparse, so tests also run with days).
    ``bucket_units`` is the time-bucket width of the as-of lookup shuffle, in
    lag units; it bounds how much of one station's history a single task
    sees, so a hot station is spread over many tasks.
    ``lookup_plan``: "two_level" (readings are first reduced to the first/last
    reading per ``slot_seconds`` slot, so per-task work is bounded by the slot
    count however dense a station's readings are; one more shuffle, of slot
    summaries), "auto" (the same) or "window" (one shuffle of raw readings;
    per-task work is the readings of one station within ``bucket + lookback``).
    """

    lag_unit: int = HOUR
    bucket_units: int = 60
    lookup_plan: str = "two_level"
    slot_seconds: int = 60
    # restrict the history to [min(now) - lookback, max(now)] of the probed
    # requests (one small aggregate), as literal bounds the scan can use
    bound_history: bool = True
