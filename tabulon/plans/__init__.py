"""The registered queries: importing this package fills the registry."""

from . import assembly, documents, formulas, layouts, maps, preflight, profiling, repeats, sheets, snapshots, structure
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "assembly", "documents", "formulas", "layouts", "maps", "preflight", "profiling", "repeats", "sheets", "snapshots", "structure"]
