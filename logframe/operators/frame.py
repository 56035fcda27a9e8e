"""Line framing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import stripped_lines


def frame_lines(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """Split texts at every line break, strip each piece and drop the blank ones.

    ``part`` tells the pieces of one text apart; the other columns are kept.
    """
    others = [c for c in lines.columns if c not in (text_col, "part")]
    pieces = lines.select(*others, F.posexplode(stripped_lines(F.col(text_col))).alias("part", text_col))
    return pieces.filter(F.col(text_col) != "")
