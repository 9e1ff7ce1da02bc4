"""Card text to clean, evaluated metadata, as Spark DataFrames."""
