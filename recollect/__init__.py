"""recollect: memory-store analytics expressed as PySpark DataFrame plans."""
