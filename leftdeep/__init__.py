"""Declare a left-deep chain of joins once; let Catalyst plan and run it."""

from leftdeep.functions.conditions import Condition, col
from leftdeep.plans.model import TableRef
from leftdeep.plans.plan import JoinPlan
from leftdeep.sources.json_lines import read_json_lines

__all__ = ["Condition", "JoinPlan", "TableRef", "col", "read_json_lines"]
