"""Temporal, namespace-scoped graph analytics and corpus preparation on PySpark."""
