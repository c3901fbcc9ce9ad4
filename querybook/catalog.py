"""All queries."""

from querybook import detection, parsing, reporting, streams  # noqa: F401
