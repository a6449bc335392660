"""Larger plans: charts, profiles, lineage and reports."""
