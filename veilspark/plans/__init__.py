"""Whole procedures: synthesis, evaluation reports and experiment grids."""
