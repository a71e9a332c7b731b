"""Page audit and citation analytics as Spark DataFrame operators."""
