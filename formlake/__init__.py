"""Document field analytics as Spark DataFrame transformations."""
