"""lodestone: relational operators and training-data operators as Spark DataFrame programs."""
