"""Tidewire: news-flow analytics as Spark DataFrame operators."""
