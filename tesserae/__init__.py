"""Analytics over software-engineering data, as Spark DataFrame operators."""
