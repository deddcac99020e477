"""Detection, scoring, masking and restoring of personal data in tables of documents, on Spark."""
