"""Marketplace listing analytics and corpus preparation on Spark."""
