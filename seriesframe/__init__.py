"""Survey and monitoring analytics as lazy PySpark DataFrame operators."""

from seriesframe.session import local_session

__all__ = ["local_session"]
