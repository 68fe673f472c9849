"""Vector functions: Arrow where arithmetic is heavy, columns elsewhere."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.config import Preset
from loomseek.errors import CapabilityError

#: Tokens of a text that an embedding reads.
MOST_TOKENS = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _values(v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All values of a batch of arrays one after another, and the place at which each array ends."""
    ends = np.cumsum([0 if x is None else len(x) for x in v])
    return (np.concatenate([x for x in v if x is not None]) if len(ends) and ends[-1] else np.empty(0)).astype("<f4"), ends


@F.pandas_udf(T.StringType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Little-endian float32 in base64. The batch's values become bytes at once."""
    values, ends = _values(v)
    data = memoryview(values.tobytes())
    return pd.Series([None if x is None else base64.b64encode(data[4 * (e - len(x)) : 4 * e]).decode() for x, e in zip(v, ends)], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(s: pd.Series) -> pd.Series:
    raw = [None if x is None else base64.b64decode(x) for x in s]
    values = np.frombuffer(b"".join(x for x in raw if x is not None), "<f4")
    ends = np.cumsum([0 if x is None else len(x) // 4 for x in raw])
    return pd.Series([None if x is None else values[e - len(x) // 4 : e] for x, e in zip(raw, ends)], dtype=object)


def bucket(token: str, dimension: int) -> int:
    """Place of a token: the first 32 bits of its MD5."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimension


def embed_text(text: str, dimension: int) -> np.ndarray:
    """Normalised counts of hashed lower-case tokens. Stands for a model in tests and oracles."""
    v = np.zeros(dimension)
    for token in (text or "").lower().split()[:MOST_TOKENS]:
        v[bucket(token, dimension)] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def hash_embedder(dimension: int):
    """Column function text -> array<float>, one Arrow batch at a time."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([embed_text(t, dimension).astype(np.float32) for t in s])

    return embed


def onnx_embedder(model_path: str, tokenizer_path: str, pooling: str = "mean", prefix: str = "", most: int = 512):
    """Column function text -> array<float> by an ONNX model, loaded once in a worker."""
    try:
        import onnxruntime  # noqa: F401
        import tokenizers  # noqa: F401
    except ImportError as e:
        raise CapabilityError("onnxruntime and tokenizers are needed") from e

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(most)
        tokenizer.enable_padding()
        session = onnxruntime.InferenceSession(model_path)
        names = {i.name for i in session.get_inputs()}
        for s in texts:
            got = tokenizer.encode_batch([prefix + (t or "") for t in s])
            feed = {"input_ids": [g.ids for g in got], "attention_mask": [g.attention_mask for g in got], "token_type_ids": [g.type_ids for g in got]}
            feed = {k: np.array(v, np.int64) for k, v in feed.items() if k in names}
            out = session.run(None, feed)[0]
            if pooling == "cls":
                pooled = out[:, 0]
            else:
                mask = np.array([g.attention_mask for g in got])[..., None]
                pooled = (out * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
            n = np.linalg.norm(pooled, axis=1, keepdims=True)
            yield pd.Series(list((pooled / np.where(n > 0, n, 1)).astype(np.float32)))

    return embed


def model_info(preset: Preset) -> dict:
    """What a model says about itself."""
    return {
        "model_id": preset.model_id or preset.name, "preset": preset.name, "dimension": preset.dimension, "max_tokens": preset.most_tokens,
        "query_prefix": preset.query_prefix, "passage_prefix": preset.passage_prefix,
    }
