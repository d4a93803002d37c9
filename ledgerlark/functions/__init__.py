"""Rules and expressions over columns."""
