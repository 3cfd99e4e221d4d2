"""Records that differ only in dress, collapsed into one each with their number of copies."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import attach_first
from ..session import cut


def _letters(text: str) -> str:
    """The letters and digits of a text, composed and without case; accents count, everything else is dress."""
    if text.isascii():
        return "".join(filter(str.isalnum, text)).lower()
    out = []
    for c in unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()):
        kind = unicodedata.category(c)
        # a mark belongs to the letter before it; variation selectors (of symbols) don't
        if kind[0] in "LN" or (kind in ("Mn", "Mc") and out and not "︀" <= c <= "️" and not "\U000e0100" <= c <= "\U000e01ef"):
            out.append(c)
    return "".join(out)


def _content(value: object) -> str:
    """Canonical text of a JSON value: a list's parts in their order, an object's by canonical key."""
    if value is None:
        return ""
    if isinstance(value, str):
        return _letters(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value)).lstrip("-")
    if isinstance(value, (int, float)):
        return _letters(str(value))
    if isinstance(value, list):
        return "".join(map(_content, value))
    return _fields(value)


def _fields(record: dict) -> str:
    parts = sorted((_letters(str(k)), c) for k, v in record.items() if (c := _content(v)))
    return "".join(f"{k}={c}\n" for k, c in parts)


def canonical(body: str | None) -> str | None:
    """The canonical text of one record, or null for a null body.

    A field without letters and digits counts as absent. A body that isn't a JSON object stands for itself: its own
    letters and digits, apart from all objects.
    """
    if body is None:
        return None
    try:
        record = json.loads(body)
    except ValueError:
        record = None
    if isinstance(record, dict):
        return "{" + _fields(record)
    return "?" + _letters(body)


def fingerprints(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """``key``, ``hi``, ``lo`` (the 128-bit hash of the canonical record) and ``proof`` (another 64-bit hash and the length).

    Rows with a null body have null hashes.
    """
    schema = T.StructType([df.schema[key]] + [T.StructField(c, T.LongType()) for c in ("hi", "lo", "proof", "size")])

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for t in b.column(1):
                c = canonical(t.as_py())
                if c is None:
                    cells: tuple = (None,) * 4
                else:
                    raw = c.encode("utf-8", "surrogatepass")
                    h = xxhash.xxh3_128_intdigest(raw)
                    cells = signed(h >> 64), signed(h & (2**64 - 1)), signed(xxhash.xxh64_intdigest(raw, 0x9E3779B9)), len(raw)
                for o, x in zip(out, cells):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.int64()) for o in out)], names=[key, "hi", "lo", "proof", "size"])

    return df.select(key, body).mapInArrow(run, schema)


def _grouped(df: DataFrame, key: str, body: str) -> DataFrame:
    """``record_id``, ``hash`` and ``proof`` of every row with a body; the table is written once and read twice."""
    slim = fingerprints(df, key, body).where("hi is not null")
    return cut(slim.select(F.col(key).alias("record_id"), F.struct("hi", "lo").alias("hash"), F.struct("proof", "size").alias("proof")))


def copy_groups(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """One row per distinct record: ``keep_id`` (its smallest id), ``n_copies``, ``n_texts`` (bodies' different proofs).

    Counts are combined map-side. ``n_texts`` above 1 means that two different records share all 128 bits; such groups
    are split by the proof, so a collision can't join them. Null bodies are records of their own. An empty table gives
    no rows.
    """
    slim = _grouped(df, key, body)
    per = slim.groupBy("hash", "proof").agg(F.min("record_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    clash = per.groupBy("hash").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    groups = per.join(clash, "hash", "left").select("keep_id", "n_copies", F.coalesce("n_texts", F.lit(1)).alias("n_texts"))
    alone = df.where(F.col(body).isNull()).select(F.col(key).alias("keep_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(1).cast("bigint").alias("n_texts"))
    return groups.unionByName(alone)


def copies(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """``keep_id``, ``copy_id``: the smallest id of each set of copies with each other id of the set.

    Groups are by hash and proof together (see ``copy_groups``). A record that holds a third of all rows is attached to
    its smallest id apart from the rest, without a shuffle of its rows. Null bodies are in no set; a repeated id is one
    record.
    """
    slim = _grouped(df, key, body).select("record_id", F.struct("hash", "proof").alias("same"))
    return attach_first(slim, "same", "record_id", "keep_id").where("record_id > keep_id").select("keep_id", F.col("record_id").alias("copy_id"))
