"""Media-library analytics and large-corpus processing as PySpark DataFrame plans."""
