"""Operators for training-data pipelines over text, pages and tokens.

Nothing else in the package imports this subpackage. Each module is one operator; ``queries``
registers them for the driver contract.
"""
