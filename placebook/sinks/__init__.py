"""Reply tables, CSV and JSON exports."""
