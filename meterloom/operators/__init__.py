"""DataFrame operators: filters, rollups, pricing, reconciliation, conversations, budgets and alerts."""
