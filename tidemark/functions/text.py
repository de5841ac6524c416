"""Column functions for time codes, colours and comment fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ms_to_timecode(ms: Column) -> Column:
    """``hh:mm:ss.fff``, with a sign for negative times."""
    a = F.abs(ms)
    return F.format_string("%s%02d:%02d:%02d.%03d", F.when(ms < 0, "-").otherwise(""), F.floor(a / 3_600_000), F.floor(a / 60_000) % 60, F.floor(a / 1000) % 60, a % 1000)


def rgb_to_bgr_hex(color: Column) -> Column:
    """The six hexadecimal digits of a 24-bit colour in blue-green-red order."""
    return F.lpad(F.hex(F.shiftleft(color.bitwiseAND(255), 16).bitwiseOR(color.bitwiseAND(0xFF00)).bitwiseOR(F.shiftright(color, 16).bitwiseAND(255))), 6, "0")


#: How long a comment stays, by mode (fixed values).
STANDING_MODES, STANDING_MS, MOVING_MS = (4, 5), 4500, 8000


def display_ms(mode: Column) -> Column:
    """How long a comment stays on the screen."""
    return F.when(mode.isin(*STANDING_MODES), STANDING_MS).otherwise(MOVING_MS)
