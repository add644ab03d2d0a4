"""Distributed operators: skew handling, sessions, references, packed values, change replay."""
