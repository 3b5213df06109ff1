"""Table schemas, ingest, derived-table maintenance and the driver-table adapter."""
