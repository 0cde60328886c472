"""talklake: Spark-native operators for timestamped text (transcripts, subtitle tracks, intervals)."""

__version__ = "0.1.0"
