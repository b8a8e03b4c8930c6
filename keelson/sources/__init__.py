"""Sources, sinks and table operations."""

from keelson.sources.tables import *  # noqa: F401,F403
