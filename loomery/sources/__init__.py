"""Sources of records, evidence and pages."""
