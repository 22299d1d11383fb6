"""Training-data operators. Nothing else in the package imports this
subpackage; its queries are listed in ``queries.py``."""
