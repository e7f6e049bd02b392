"""Timeline analytics on Spark: scoring, sessions, peaks, cuts and reports for many recordings at once."""
