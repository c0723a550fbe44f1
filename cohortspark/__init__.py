"""cohortspark: cohort selection, wave normalisation and outcome models on Spark."""

__all__ = ["functions", "operators", "plans", "sources"]
