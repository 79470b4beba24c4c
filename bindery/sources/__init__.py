"""Tables as graphs, readers and writers."""

from .catalog import Catalog, ClassMap, EdgeMap, Prop

__all__ = ["Catalog", "ClassMap", "EdgeMap", "Prop"]
