"""Column-level functions shared by every operator."""

from dockcast.functions.scalar import (  # noqa: F401
    ISO_UTC,
    epoch_micros,
    horizon_guard,
    iso_utc,
    minus_seconds,
    ntz_literal,
    occupancy_decile,
    parse_int,
    property_attr,
    round_half_up_float,
    steps_to_target,
)
