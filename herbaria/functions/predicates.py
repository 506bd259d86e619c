"""Claim predicates shared by all operators.

Fixed values: the four action spellings and the bot ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Action spellings and reserved people.
RECORDED = "recorded"
IDENTIFIED = "identified"
RECORDED_IDENTIFIED = "recorded,identified"
IDENTIFIED_RECORDED = "identified,recorded"
REC_ACTIONS = [RECORDED, RECORDED_IDENTIFIED, IDENTIFIED_RECORDED]
IDN_ACTIONS = [IDENTIFIED, RECORDED_IDENTIFIED, IDENTIFIED_RECORDED]
BOTH_ACTIONS = [RECORDED_IDENTIFIED, IDENTIFIED_RECORDED]
ALL_ACTIONS = [RECORDED, IDENTIFIED, RECORDED_IDENTIFIED, IDENTIFIED_RECORDED]
BOT_IDS = [1, 2]
SOURCE_AGENT_ID = 2


def rec(action: str | Column = "action") -> Column:
    """Claim says the person collected the specimen."""
    return F.col(action).isin(REC_ACTIONS) if isinstance(action, str) else action.isin(REC_ACTIONS)


def idn(action: str | Column = "action") -> Column:
    """Claim says the person identified the specimen."""
    return F.col(action).isin(IDN_ACTIONS) if isinstance(action, str) else action.isin(IDN_ACTIONS)


def both(action: str | Column = "action") -> Column:
    return F.col(action).isin(BOTH_ACTIONS) if isinstance(action, str) else action.isin(BOTH_ACTIONS)


def any_role(action: str | Column = "action") -> Column:
    return F.col(action).isNotNull() if isinstance(action, str) else action.isNotNull()


def role(kind: str, action: str | Column = "action") -> Column:
    """``kind`` in recorded / identified / both / any."""
    return {"recorded": rec, "identified": idn, "both": both, "any": any_role}[kind](action)


def vis(visible: str = "visible") -> Column:
    return F.col(visible) == F.lit(True)


def is_bot(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isin(BOT_IDS)
