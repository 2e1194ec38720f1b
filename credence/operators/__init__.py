"""Rule bodies, fixpoints, constraints and answers as DataFrames."""
