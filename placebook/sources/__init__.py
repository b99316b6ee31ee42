"""Reading documents, raw replies and target definitions."""
