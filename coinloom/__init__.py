"""Analytics for bank and card statements on Spark."""
