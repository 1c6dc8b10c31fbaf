"""packloom: streaming."""
