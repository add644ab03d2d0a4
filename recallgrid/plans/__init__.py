"""Named query plans over the study tables."""
