"""Spark jobs that find software projects moving from one language to another."""
