"""obsguard: finding wrong values in wide observation tables, as Spark DataFrame plans."""

from .schema import DEFAULT_SCHEMA, ObsSchema
from .session import build_session, ensure_checkpoint_dir

__all__ = ["ObsSchema", "DEFAULT_SCHEMA", "build_session", "ensure_checkpoint_dir"]
