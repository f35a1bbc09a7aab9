"""Receipt analytics as Spark jobs: extraction, deduplication, ledger queries and keyed state."""
