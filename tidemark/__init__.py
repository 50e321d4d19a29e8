"""Spark-native signal engine: news, filings, attention and prices to ranked, tracked candidates."""
