"""Values, their arithmetic and comparison, and the algebra of belief, as Spark columns."""
