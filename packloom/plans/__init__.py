"""packloom: plans."""
