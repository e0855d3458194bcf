"""Find unusual records in tables and streams of flat, mostly numeric events."""
