"""Program facts as DataFrames, analyses as Spark jobs."""
