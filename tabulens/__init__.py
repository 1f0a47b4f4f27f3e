"""tabulens: tabular profiling, feature ranking and model evaluation as Spark jobs."""
