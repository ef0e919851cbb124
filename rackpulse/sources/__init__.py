"""Readers and writers: telemetry feeds, star-schema exports, the model registry."""
