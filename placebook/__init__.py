"""Build clean business directories from semi-structured search replies, on Spark."""

from placebook.session import prepare, shared_folder

__all__ = ["prepare", "shared_folder"]
