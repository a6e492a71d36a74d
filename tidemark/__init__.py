"""Event-market analytics and point-in-time panels as Spark DataFrame operators."""
