"""The same directory, kept up to date as replies arrive."""
