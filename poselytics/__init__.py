"""PySpark analytics over exercise-session pose frames."""

from poselytics.session import configure

__all__ = ["configure"]
