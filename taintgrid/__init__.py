"""Code-security analytics on Spark: fact tables in, findings and history answers out."""

from taintgrid.session import KEYS, checkpoint, get_session

__all__ = ["KEYS", "checkpoint", "get_session"]
