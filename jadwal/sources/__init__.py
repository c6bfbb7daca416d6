"""Sources: stored reader responses, cell reads and saved states."""
