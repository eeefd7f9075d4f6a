"""Tidemark: corpus analytics as composable Spark DataFrame transforms."""
