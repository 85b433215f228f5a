"""Knowledge-base analytics as Spark DataFrame transformations."""
