"""Models behind one protocol, and reading of the loose JSON that they reply with.

A client is any picklable object with ``generate(prompts) -> replies`` or ``embed(texts) ->
vectors``; it is called with Arrow batches on the executors. A failing batch gives nulls
and the error, so that a fallback can be taken with ``coalesce``.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Client(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Offline:
    """A deterministic stand-in: replies repeat the prompt's first line, vectors hash its words."""

    dim = 64

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.split("\n", 1)[0] for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % self.dim] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def _called(df: DataFrame, column: str, out: str, kind: str, arrow: pa.DataType, call, batch: int) -> DataFrame:
    schema = df.withColumn(out, F.lit(None).cast(kind)).withColumn("error", F.lit(None).cast("string")).schema

    def go(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [x or "" for x in part[column].to_pylist()]
                try:
                    values, error = call(texts), None
                except Exception as e:  # noqa: BLE001  a client may fail in any way
                    values, error = [None] * len(texts), f"{type(e).__name__}: {e}"[:300]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, arrow), pa.array([error] * len(texts), pa.string())], schema.fieldNames())

    return df.mapInArrow(go, schema)


def generated(df: DataFrame, client: Client, column: str = "prompt", batch: int = 16) -> DataFrame:
    """``df`` with ``reply`` and ``error``."""
    return _called(df, column, "reply", "string", pa.string(), client.generate, batch)


def embedded(df: DataFrame, client: Client, column: str = "text", batch: int = 16) -> DataFrame:
    """``df`` with ``embedding`` and ``error``."""
    return _called(df, column, "embedding", "array<float>", pa.list_(pa.float32()), client.embed, batch)


def loose_json(text: str | None) -> str | None:
    """A reply's first JSON value, in strict form: fences, bare keys, single quotes, trailing
    commas and a cut-off end are mended; null where nothing can be read."""
    t = re.sub(r"```(?:json)?", "", text or "")
    starts = [i for i in (t.find("{"), t.find("[")) if i >= 0]
    if not starts:
        return None
    t = t[min(starts) :]
    try:
        return json.dumps(json.JSONDecoder().raw_decode(t)[0])
    except ValueError:
        pass
    mended, closing, quote, i = [], [], "", 0
    while i < len(t):
        c = t[i]
        if quote:
            if c == "\\" and i + 1 < len(t):
                mended.append(t[i : i + 2])
                i += 2
                continue
            mended.append('"' if c == quote else '\\"' if c == '"' else "\\n" if c == "\n" else c)
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
            mended.append('"')
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
            mended.append(c)
        elif c in "}]":
            if not closing or closing.pop() != c:
                return None
            mended.append(c)
            if not closing:
                break
        else:
            mended.append(c)
        i += 1
    s = "".join(mended) + ('"' if quote else "")
    tail = "".join(reversed(closing))
    s = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', s)
    while s:
        try:
            return json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", s + tail)))
        except ValueError:
            if not tail:
                return None
            cut = max(s.rfind(","), s.rfind("{"), s.rfind("["))
            if cut <= 0:
                return None
            dropped, s = s[cut], s[:cut]
            if dropped in "{[":
                tail = tail[1:]
    return None


def parsed_reply(reply: Column, schema: str) -> Column:
    """A reply as ``schema``: Spark's own parser where it can, else the mended text."""
    strict = F.from_json(reply, schema)
    mended = F.from_json(F.udf(loose_json, "string", useArrow=True)(reply), schema)
    return F.when(F.try_parse_json(reply).isNotNull(), strict).otherwise(mended)


def data_url(url: Column) -> Column:
    """``struct<mime, content>`` of a data URL."""
    return F.struct(F.regexp_extract(url, r"^data:([^;,]+)", 1).alias("mime"), F.unbase64(F.regexp_extract(url, r"base64,(.*)$", 1)).alias("content"))
