"""Operators on tables: matching, ingest, scoring, alerts, registries, usage."""
