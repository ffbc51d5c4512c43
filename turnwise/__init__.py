"""Instruction and preference data on Spark: shaping, labelling, splitting, scoring and reporting."""
