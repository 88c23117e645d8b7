"""Images named by JSON-LD blocks; the order of keys matters, which no built-in function keeps."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

_IMAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("url", T.StringType()),
            T.StructField("width", T.LongType()),
            T.StructField("height", T.LongType()),
        ]
    )
)
# Ship this small module with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _dimension(v) -> int | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return int(v + 0.5) if 0 < v < 2.0**63 else None
    if isinstance(v, str):
        digits = ""
        for ch in v.lstrip():
            if ch not in "0123456789":
                break
            digits += ch
        n = int(digits or 0)
        return n if 0 < n < 2**63 else None
    return None


def _reject_constant(name: str):
    raise ValueError(name)


def structured_images(text: str, max_depth: int | None = None) -> list[tuple[str, int | None, int | None]]:
    """Images of one JSON-LD text, in document order; malformed text has none."""
    try:
        root = json.loads(text, parse_constant=_reject_constant)
    except (ValueError, RecursionError):
        return []
    found = []
    # Explicit stack, children pushed in reverse, so the visit order is the document's.
    stack = [(root, 0, False)]
    while stack:
        node, depth, is_image = stack.pop()
        if max_depth is not None and depth > max_depth:
            continue
        if isinstance(node, list):
            stack.extend((item, depth + 1, is_image) for item in reversed(node))
        elif is_image and isinstance(node, str):
            found.append((node, None, None))
        elif is_image and isinstance(node, dict):
            size = (_dimension(node.get("width")), _dimension(node.get("height")))
            found.extend((node[k], *size) for k in ("url", "contentUrl") if isinstance(node.get(k), str))
        elif isinstance(node, dict):
            stack.extend((v, depth + 1, k == "image") for k, v in reversed(node.items()))
    return found


@F.pandas_udf(_IMAGES)
def json_ld_images(texts: pd.Series) -> pd.Series:
    """Arrow-batched: order of keys matters, which no built-in JSON function keeps."""
    return texts.map(lambda t: None if t is None else [dict(zip(("url", "width", "height"), i)) for i in structured_images(t)])
