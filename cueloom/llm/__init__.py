"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from cueloom.session import ship_package

ship_package()
