"""Registered queries: each module adds its own to the registry."""

from . import change_capture, checks_and_audience, decisions, documents_and_cards, laws, line_history, operations, text_and_dates, trees_and_schedules  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
