"""Reading telemetry and writing reports."""
