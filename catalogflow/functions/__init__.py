"""Column -> Column helpers; all built from pyspark.sql.functions (JVM side)."""
