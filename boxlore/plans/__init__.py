"""The engine's queries over the driver's tables."""

from . import boxes, files, records, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
