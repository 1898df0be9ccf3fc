"""Operators that prepare training text: quality, copies, leaks, packing, sharding, licences."""
