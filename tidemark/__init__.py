"""tidemark: point-in-time market analytics and corpus preparation as PySpark DataFrame operators."""
