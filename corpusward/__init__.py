"""Rule checks over large text corpora, and a ledger of decisions about their findings, on Spark."""
