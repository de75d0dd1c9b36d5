"""Scalar functions as Column expressions; all run inside the JVM, but for anls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Bytes of an element by type; element widths in bits by name.
DTYPE_BYTES = {"float32": 4, "float16": 2, "bfloat16": 2, "int8": 1, "uint8": 1}
DTYPE_BITS = {"fp16": 16, "int8": 8, "int4": 4}
#: Characters of a document that a prompt shows.
PROMPT_CHARS = 1500
#: Similarity below which an answer counts as wrong.
ANLS_THRESHOLD = 0.5


def doc_key(source: Column, doc_id: Column, page_no: Column) -> Column:
    """source:doc_id:page_no."""
    return F.concat_ws(":", source, doc_id.cast("string"), page_no.cast("string"))


def truncated(text: Column, chars: int = PROMPT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def ascii_folded(text: Column) -> Column:
    """Every character outside space to tilde as '?', so that characters are bytes."""
    return F.regexp_replace(text, "[^ -~]", "?")


def bounded_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance of two strings if it is at most `most`, else -1.

    The columns of the table of distances are differences by bit, of all rows at once, in whole numbers of as many bits as the shorter string has characters.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return -1
    if a in b:  # what is left out is all that differs
        return len(b) - len(a)
    m, left, at = len(a), len(b), {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << m - 1
    up, down, distance = full, 0, m
    for x in b:
        eq = at.get(x, 0)
        v = eq | down
        h = ((eq & up) + up ^ up) | eq
        plus, minus = down | full & ~(h | up), up & h
        if plus & last:
            distance += 1
        elif minus & last:
            distance -= 1
        left -= 1
        if distance - left > most:
            return -1
        plus, minus = plus << 1 | 1, minus << 1
        up, down = minus | full & ~(v | plus), plus & v
        up &= full
    return distance if distance <= most else -1


def _best_similarity(prediction: Iterator[str | None], golds: Iterator[list[str | None]]) -> Iterator[float]:
    """The best similarity of each prediction to its golds; what is further away than the threshold scores 0, and is not measured."""
    for p, gold in zip(prediction, golds, strict=True):
        best = 0.0
        for g in gold if gold is not None else ():
            if g is None:
                continue
            longest = max(len(p or ""), len(g))
            distance = bounded_distance(p, g, math.floor(longest * (1 - ANLS_THRESHOLD))) if p is not None and longest else -1
            best = max(best, 1.0 if not longest else 1.0 - distance / longest if distance >= 0 else 0.0)
        yield best


def anls(prediction: Column, golds: Column) -> Column:
    """Best 1 - distance / longer length over the gold answers, trimmed and lower-cased; below the threshold 0, and without golds 0."""

    @F.pandas_udf(DoubleType())
    def similarity(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(list(_best_similarity(p, g)), dtype=float)

    best = similarity(F.lower(F.trim(prediction)), F.transform(golds, lambda g: F.lower(F.trim(g))))
    return F.when(best >= ANLS_THRESHOLD, best).otherwise(F.lit(0.0))


def ceil_div(n: Column, size: Column | int) -> Column:
    """Blocks that hold n tokens; a negative count is an error."""
    size = F.lit(size).cast("long") if isinstance(size, int) else size.cast("long")
    return F.when(n < 0, F.raise_error(F.lit("negative token count")).cast("long")).otherwise(F.floor((n + size - 1) / size).cast("long"))


def block_of(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("long")


def offset_in(position: Column, size: int) -> Column:
    return (position % size).cast("long")


def kv_bytes_per_token(layers: Column, kv_heads: Column, head_dim: Column, element_bytes: Column | int = 2) -> Column:
    """Keys and values of one token over all layers."""
    width = F.lit(element_bytes) if isinstance(element_bytes, int) else element_bytes
    return (2 * layers * kv_heads * head_dim * width).cast("long")


def visual_tokens_per_tile(image: Column, patch: Column, scale: Column) -> Column:
    side = F.floor(image / patch)
    return F.floor(side * side / (scale * scale)).cast("long")


def heads_per_group(heads: Column, kv_heads: Column) -> Column:
    """Query heads of each key-value head; an uneven split is an error."""
    return F.when(heads % kv_heads == 0, F.floor(heads / kv_heads).cast("long")).otherwise(F.raise_error(F.lit("heads do not divide")).cast("long"))


def weight_bytes(n: Column, bits: Column) -> Column:
    """Bytes of n weights; of four bits, two share a byte."""
    return F.when(bits == 4, F.floor((n + 1) / 2)).otherwise(n * F.floor(bits / 8)).cast("long")


def arm_label(arm: Column, bits: Column) -> Column:
    return F.when(bits == 16, F.lit("fp16")).otherwise(F.concat(arm, F.lit("@int"), bits.cast("string")))


def label_bits(label: Column) -> Column:
    return F.when(label == "fp16", F.lit(16)).otherwise(F.element_at(F.split(label, "@int"), -1).cast("int"))


def label_arm(label: Column) -> Column:
    return F.element_at(F.split(label, "@"), 1)


def cell_name(load: Column, chunk: Column) -> Column:
    """loadX-chunkN, or loadX-unchunked where chunk is null; X without trailing zeros."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", load.cast("double")), "0+$", ""), "\\.$", "")
    return F.concat(F.lit("load"), shown, F.lit("-"), F.when(chunk.isNull(), F.lit("unchunked")).otherwise(F.concat(F.lit("chunk"), chunk.cast("string"))))


def name_matches(name: Column, parts: list[str]) -> Column:
    """Whether the name has any of the parts in it, whatever their case."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(F.lower(name), F.lit(p.lower()))
    return found


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9._-]", "_")


def gib(n: Column) -> Column:
    return n / float(1 << 30)


def mib(n: Column) -> Column:
    return n / float(1 << 20)


def finish_reason(tokens: Column, eos: Column) -> Column:
    """'stop' if the last token is the end token, else 'length'."""
    return F.when(F.try_element_at(tokens, F.lit(-1)) == eos, "stop").otherwise("length")


def text_delta(text: Column, before: Column) -> Column:
    """What text adds to what was shown before."""
    return F.substring(text, F.length(F.coalesce(before, F.lit(""))) + 1, F.length(text))


def prompt(question: Column, texts: Column) -> Column:
    """A prompt as flat text: 'Document i:' and the truncated text of each document that has one, then the question."""
    parts = F.transform(texts, lambda t, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":"), F.when(t != "", F.concat(F.lit("\n"), F.substring(t, 1, PROMPT_CHARS))).otherwise("")))
    return F.concat(F.array_join(parts, "\n"), F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))


def prompt_parts(question: Column, keys: Column, texts: Column) -> Column:
    """A prompt as parts (type, text): for each document its heading, its image, and its text if there is one; then the question."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    pairs = F.arrays_zip(keys.alias("k"), texts.alias("t"))
    each = F.transform(pairs, lambda p, i: F.filter(F.array(part("text", F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":"))), part("image", p["k"].cast("string")), part("text", F.substring(p["t"], 1, PROMPT_CHARS))), lambda x: x["text"] != ""))
    return F.array_append(F.flatten(each), part("text", F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))))


def required(name: str, *sources: Column) -> Column:
    """The first value that is set; without any an error, never a default."""
    return F.coalesce(*sources, F.raise_error(F.lit(f"missing value: {name}")))
