"""Operators for preparing training text, independent of the ledger library.

Each module holds one operator with a general interface; ``queries`` registers
one query per operator for the driver.
"""
