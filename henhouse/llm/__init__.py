"""Operators for preparing language-model training data: HTML extraction, exact and
near de-duplication, substring removal, quality rules, tokenisation, sharding and
packing. Nothing else in the package imports this subpackage; its queries are listed
in ``registry``."""
