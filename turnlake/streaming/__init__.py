"""Live ingestion."""
