"""paysift: PySpark-native profiling, cleaning, feature building and
regression for survey-style tables."""

__version__ = "0.1.0"
