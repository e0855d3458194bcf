"""Micro-batch scoring, landing and replay."""
