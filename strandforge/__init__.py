"""A Spark-first engine for sequence search, alignment, clustering and taxonomy."""
