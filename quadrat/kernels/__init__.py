"""NumPy conditional updates of one chain."""
