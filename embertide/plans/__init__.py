"""Query registry: one module per workload, with SQL to compare with."""
