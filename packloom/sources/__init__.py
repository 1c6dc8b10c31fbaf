"""packloom: sources."""
