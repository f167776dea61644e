"""News-and-price signal analytics expressed as Spark DataFrame transformations."""

from .settings import Settings, apply_profile, from_mapping, load

__all__ = ["Settings", "apply_profile", "from_mapping", "load"]
