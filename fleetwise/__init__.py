"""Fleet telemetry analytics expressed as Spark jobs."""

from fleetwise.spec import DEFAULT, TelemetrySpec

__all__ = ["DEFAULT", "TelemetrySpec"]
