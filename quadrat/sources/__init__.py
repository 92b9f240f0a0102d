"""Reading models and writing draws."""
