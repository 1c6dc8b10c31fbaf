"""packloom: operators."""
