"""Event-time bars, labels, weights, validation and model selection for trade data, on Spark."""
