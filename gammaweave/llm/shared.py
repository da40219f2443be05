"""Intermediate tables in the folder that the driver and all executors share."""

from ..plans.store import Scratch, scratch, shared_folder

__all__ = ["Scratch", "scratch", "shared_folder"]
