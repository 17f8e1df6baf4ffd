"""Configuration, dictionaries and vocabularies as lines of text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lexivane.operators.lexical import dictionary


def read_config(text: str) -> dict[str, str]:
    """``key: value`` lines, split at the first colon; # starts a comment; of a repeated key the last holds."""
    out = {}
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        if colon and key.strip():
            out[key.strip()] = value.strip()
    return out


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return dictionary(spark.read.text(path))


def read_vocabulary(text: str) -> tuple[dict[str, int], dict]:
    """token -> id of a tokenizer's JSON, and its settings: unknown token, longest word in bytes, special tokens."""
    data = json.loads(text)
    model = data["model"]
    special = [t["content"] for t in data.get("added_tokens", []) if t.get("special")]
    return dict(model["vocab"]), {"unknown": model.get("unk_token", "[UNK]"), "longest": int(model.get("max_input_chars_per_word", 100)), "special": special}
