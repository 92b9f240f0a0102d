"""Column functions and contractions of long tables."""
