"""Writers of records and reports."""
