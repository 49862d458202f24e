"""The queries: catalog first, then the modules that add to it."""

from . import catalog, attributes, calendar, frames, more, motion  # noqa: F401,I001
