"""Journey planning: scans of a day's connections for many queries at once."""
