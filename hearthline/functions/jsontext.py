"""The first valid JSON object inside free text."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# Worker functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Balanced braces down to two inner levels; possessive, so it never backtracks.
_SHALLOW = r"\{[^{}]*+(?:\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}[^{}]*+)*+\}"
_SHALLOW_ARRAY = r"\[[^\[\]]*+(?:\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+\][^\[\]]*+)*+\]"


@F.pandas_udf(T.StringType())
def _first_valid(texts: pd.Series) -> pd.Series:
    """First substring with balanced braces, any depth, that is a JSON object; balanced spans are found in one pass."""

    def scan(text: str | None) -> str | None:
        if text is None:
            return None
        opened: list[int] = []
        closed: dict[int, int] = {}
        for i, ch in enumerate(text):
            if ch == "{":
                opened.append(i)
            elif ch == "}" and opened:
                closed[opened.pop()] = i
        after = 0
        for begin in sorted(closed):  # outer spans first; a failed span leaves what follows it
            if begin < after:
                continue
            end = closed[begin] + 1
            try:
                json.loads(text[begin:end])
                return text[begin:end]
            except (ValueError, RecursionError):
                after = end
        return None

    return texts.map(scan)


def json_in_text(c: Column) -> Column:
    """First balanced {...} that is valid JSON (else the first valid [...]) as text, else null.

    Text whose braces are all shallow is settled in the JVM: its candidates are tried in order. Deeper nesting or a stray
    brace before the first valid candidate goes to the Python matcher; the other texts pass null to it.
    """
    valid = lambda x: F.get_json_object(x, "$").isNotNull()
    candidates = F.regexp_extract_all(c, F.lit(_SHALLOW), F.lit(0))
    # What is left without the shallow objects has a brace only where they are nested deeper or stray.
    settled = ~F.contains(F.regexp_replace(c, _SHALLOW, ""), F.lit("{"))
    shallow = F.get(F.filter(candidates, valid), F.lit(0))
    deep = _first_valid(F.when(~settled, c))
    array = F.get(F.filter(F.regexp_extract_all(c, F.lit(_SHALLOW_ARRAY), F.lit(0)), valid), F.lit(0))
    return F.coalesce(F.when(settled, shallow), deep, array)
