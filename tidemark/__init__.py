"""Tidemark: event-calendar, entity-resolution and content-pipeline operators on Spark."""
