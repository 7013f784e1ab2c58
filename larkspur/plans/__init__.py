"""Multi-step plans: snapshot reconciliation, authority merges, grouping, publication."""
