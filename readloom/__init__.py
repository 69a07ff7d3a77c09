"""Sequencing-read analytics on PySpark: every operator is a DataFrame -> DataFrame or Column -> Column function."""
