"""Text lines out of OCR containers."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCKS = "array<struct<BlockType:string,Text:string>>"
_SCHEMA = f"LINE {_BLOCKS}, Blocks {_BLOCKS}, blocks {_BLOCKS}"


def lines_native(payload: Column) -> Column:
    """Lines of a plain JSON container, joined by newlines, in the JVM; '' if it is anything else.

    The blocks are those under LINE, else Blocks, else blocks; of these, lines with a text, in order.
    """
    d = F.from_json(payload, "LINE string, Blocks string, blocks string", {"mode": "PERMISSIVE"})
    raw = F.coalesce(F.get_json_object(payload, "$.LINE"), F.get_json_object(payload, "$.Blocks"), F.get_json_object(payload, "$.blocks"))
    del d
    found = F.filter(F.from_json(raw, _BLOCKS), lambda b: (b["BlockType"] == "LINE") & F.coalesce(b["Text"] != "", F.lit(False)))
    return F.coalesce(F.array_join(F.transform(found, lambda b: b["Text"]), "\n"), F.lit(""))


def parse(payload: str | None) -> str:
    """Lines of a container in any of the shipped forms; whatever fails gives ''.

    The container is JSON, or a Python literal; a list holds one JSON document as text.
    """
    try:
        try:
            value = json.loads(payload or "")
        except ValueError:
            value = ast.literal_eval(payload or "")
        while isinstance(value, list):
            value = value[0]
            value = json.loads(value) if isinstance(value, str) else value
        blocks = next((value[k] for k in ("LINE", "Blocks", "blocks") if value.get(k)), [])
        return "\n".join(b["Text"] for b in blocks if b.get("BlockType") == "LINE" and b.get("Text"))
    except Exception:  # noqa: BLE001  a container of any other form has no text
        return ""


def lines(payload: Column) -> Column:
    """parse() as an Arrow-batched function, for containers that the JVM form cannot read."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: parse(x if isinstance(x, str) else None))

    return of(payload)
