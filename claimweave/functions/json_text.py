"""Strict JSON of model replies, and typed access to metadata."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType


@F.pandas_udf(StructType().add("ok", BooleanType()).add("json", StringType()).add("error", StringType()))
def json_strict(text: pd.Series) -> pd.DataFrame:
    """Whether a strict parser takes the text whole, its canonical form, and else bad_json or, for no object, bad_shape."""

    def one(value: str | None) -> tuple:
        try:
            found = json.loads(value or "")
        except ValueError:
            return False, None, "bad_json"
        return (True, json.dumps(found, sort_keys=False), None) if isinstance(found, dict) else (False, None, "bad_shape")

    return pd.DataFrame([one(v) for v in text], columns=["ok", "json", "error"])


@F.arrow_udf(BooleanType())
def json_object(text: pa.Array) -> pa.Array:
    """Whether a strict parser takes the text whole as an object. A text is held while it is parsed, and no other is."""

    def one(value: str | None) -> bool:
        try:
            return isinstance(json.loads(value or ""), dict)
        except ValueError:
            return False

    return pa.array((one(value.as_py()) for value in text), pa.bool_())


def metadata_value(metadata: Column, key: str, like: object = "") -> Column:
    """The value under a key, typed as the Python value that it is compared with; null if it is missing or of another kind."""
    kind = "boolean" if isinstance(like, bool) else "double" if isinstance(like, (int, float)) else "string"
    return F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", kind)


def has_key(variant: Column, key: str) -> Column:
    """Whether the key is there, be it with null."""
    return F.try_variant_get(variant, f"$.{key}", "variant").isNotNull()
