"""dockcast: short-term availability forecasting for city mobility stations, on Spark."""

__version__ = "0.1.0"
