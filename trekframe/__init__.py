"""trekframe: journey analytics and corpus processing as Spark DataFrame operators."""
