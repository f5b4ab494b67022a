"""deltaloom: join views and their change logs on Spark, and corpus operators."""
