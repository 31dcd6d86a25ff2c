"""Named queries over the driver's tables, with the SQL that states their results."""

from . import judged
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "judged"]
