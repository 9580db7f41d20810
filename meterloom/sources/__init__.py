"""Readers of telemetry, transcripts and price lists, and writers of exports."""
