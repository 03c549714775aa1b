"""Column functions: season dates, hash draws, names and labels."""
