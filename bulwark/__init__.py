"""bulwark: robust statistics as Spark DataFrame plans."""
