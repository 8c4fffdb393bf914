"""Continuous forms of the telemetry and ledger queries."""
