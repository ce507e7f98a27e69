"""Intermediate tables in the folder that the driver and all executors share."""

from ..storage import LIVE, Scratch, filtered_scans, release, settings, shared_dir, shuffled_joins

__all__ = ["LIVE", "Scratch", "filtered_scans", "release", "settings", "shared_dir", "shuffled_joins"]
