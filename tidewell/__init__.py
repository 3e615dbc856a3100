"""tidewell: a compact streaming-and-files SQL engine and corpus operators on PySpark."""
