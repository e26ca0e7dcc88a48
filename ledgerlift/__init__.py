"""Text documents to a checked ledger of records and line items, on Spark."""
