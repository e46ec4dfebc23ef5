"""Intermediate tables in the folder that all executors share."""

from starcheck.session import CLEAN_UP, Scratch

__all__ = ["CLEAN_UP", "Scratch"]
