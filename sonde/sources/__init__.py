"""Telemetry readers, sinks and the relations derived from the driver tables."""
