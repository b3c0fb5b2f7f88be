"""Tables: reading, writing, retention, and the domain's roles for stored tables."""
