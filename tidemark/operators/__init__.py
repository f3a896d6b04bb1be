"""DataFrame operators over tiered tables, requests, lifecycle windows and run metrics."""
