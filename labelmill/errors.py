"""Exceptions raised by labelmill."""

from __future__ import annotations


class LabelError(Exception):
    """A labelling job cannot go on, or finished with failed rows."""


class SpecError(LabelError, ValueError):
    """A spec, template or column list is not usable."""
