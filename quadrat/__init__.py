"""Hierarchical community models on Spark: tables, designs, statistics, grids and chains."""
