"""DataFrame operators of the replay workloads."""
