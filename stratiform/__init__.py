"""Analytics over atlas-registered point data on Spark."""
