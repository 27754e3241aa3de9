"""Lenient JSON read of free text (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import utrim

# Fixed pattern: an opening ``` fence (optionally tagged json) or a closing one.
FENCE_PATTERN = r"(?i)^```(?:json)?\s*|\s*```$"
# Fixed pattern: outermost {...} across lines.
OBJECT_PATTERN = r"(?s)\{.*\}"


def is_json(t: Column) -> Column:
    """Whether a text is one JSON object or array and nothing else.

    Spark's JSON functions stop at the end of the first value, so the text is
    tried as the only element of an array and as the only value of an object.
    """
    element = F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1
    value = F.size(F.json_object_keys(F.concat(F.lit('{"k":'), t, F.lit("}")))) == 1
    return F.coalesce(element & value, F.lit(False)) & t.rlike(r"(?s)^\s*[{\[]")


def lenient_json(c) -> Column:
    """JSON object text of a reply: fences stripped; if that is no valid
    JSON, the outermost ``{...}`` if that is valid; else null.
    """
    col = F.col(c) if isinstance(c, str) else c
    t = utrim(F.regexp_replace(utrim(col), FENCE_PATTERN, ""))
    inner = F.regexp_extract(t, OBJECT_PATTERN, 0)
    return F.when(is_json(t), t).when(is_json(inner), inner)
