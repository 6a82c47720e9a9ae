"""Strandloom: read-level modification analytics and bulk table operators on Spark."""
