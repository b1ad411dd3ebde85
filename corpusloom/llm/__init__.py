"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it. Each module holds one operator; ``queries``
binds them to the driver's tables.
"""
