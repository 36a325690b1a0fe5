"""fleetstream: equipment-telemetry analytics as PySpark DataFrame operators."""

from fleetstream.config import Config

__all__ = ["Config"]
