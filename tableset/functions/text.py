"""Text expansion pieces: comments and include references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The include action and the block comment.
INCLUDE_PATTERN = r'\{\{\{\s*include\s+"([^"]*)"\s*\}\}\}'
ACTION_OPEN = "{{{"
COMMENT_PATTERN = r"(?s)/\*.*?\*/"


def strip_comments(text: Column | str) -> Column:
    """Remove ``/* ... */`` blocks, across lines and also inside strings.

    Texts without a comment, the usual case, are only searched for its two first bytes.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.contains("/*"), F.regexp_replace(c, COMMENT_PATTERN, "")).otherwise(c)


def include_names(text: Column | str) -> Column:
    """Names of the include actions of a text, in order."""
    return F.regexp_extract_all(text, F.lit(INCLUDE_PATTERN), 1)


def include_segments(text: Column | str) -> Column:
    """The pieces of text around the include actions (one more than there are actions)."""
    return F.split(text, INCLUDE_PATTERN, -1)
