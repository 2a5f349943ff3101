"""tidemark: reliable processing of partitioned logs, and analytics over its ledger, on Spark."""
