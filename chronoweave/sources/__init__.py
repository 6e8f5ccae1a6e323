"""Reading and writing episodes and graphs."""
