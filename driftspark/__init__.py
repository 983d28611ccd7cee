"""API contracts and schema drift as Spark tables and streams."""

from driftspark.model import Contract
from driftspark.session import build_session, configure

__all__ = ["Contract", "build_session", "configure"]
