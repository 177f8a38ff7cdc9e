"""marketloom: price-intelligence analytics as composable Spark DataFrame functions."""
