"""Oversized texts cut into pieces of at most a number of tokens, at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import TOKENIZER_DIR, VOCABULARY, Vocabulary, encode, slices, vocabulary

LIMIT, OVERLAP = 1024, 64
#: Kinds of boundary, best first; a cut is "hard" where the reach holds none of them, "end" at the end of the text.
KINDS = ("paragraph", "line", "sentence", "space")
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def boundaries(data: bytes) -> list[np.ndarray]:
    """Sorted byte offsets of each kind of boundary; a cut there puts the white space at the head of the next piece.

    Each run of blanks and line ends begins a boundary: a paragraph's if two or more lines end in it, a line's if one
    does, a sentence's if it follows ``. ! ?``, a space's in any case. Ideographic stops end a sentence without blanks.
    """
    b = np.frombuffer(data, np.uint8)
    if len(b) < 2:
        return [np.zeros(0, np.int64)] * 4
    newline = (b == 10) | ((b == 13) & ~np.append(b[1:] == 10, False))
    white = newline | (b == 32) | (b == 9) | (b == 13)
    space = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    solid = np.append(np.flatnonzero(~white), len(b))
    count = np.append(0, np.cumsum(newline))
    lines = count[solid[np.searchsorted(solid, space)]] - count[space]
    wide: list[int] = []
    for stop in (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f"):  # ideographic full stop, wide ! and ?
        at = data.find(stop)
        while at >= 0:
            wide.append(at + 3)
            at = data.find(stop, at + 3)
    sentence = space[_STOPS[b[space - 1]]]
    if wide:
        sentence = np.unique(np.concatenate([sentence, np.array(wide)]))
    return [space[lines > 1], space[lines > 0], sentence, space]


def cut_tokens(v: Vocabulary, text: str, ids: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = 0.5) -> list[tuple[int, int, str]]:
    """Pieces of one text as token ranges [start, stop) of ``ids`` and the kind of their end.

    From the prefix sums of the tokens' lengths each boundary becomes a token place (boundaries within a token drop
    out). A piece ends at its last boundary of the best kind within reach: not beyond the limit, and filling at least
    ``fill`` of it, or else at any that still leaves progress; without one it is cut hard at the limit, between
    characters. The next piece begins ``overlap`` tokens before that end. Where these tokens begin within a word, the
    word's rest alone may need more tokens than before; the limit is lowered by that, so that the piece's text,
    encoded again, stays within it. If an overlap begins inside a character, up to three tokens more are repeated.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    n = len(ids)
    if n <= limit:
        return [(0, n, "end")]
    off = np.zeros(n + 1, np.int64)
    np.cumsum(v.lengths[ids], out=off[1:])
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    clean = np.append((raw[off[:-1]] & 0xC0) != 0x80, True)  # token places that begin a character
    places = []
    for b in boundaries(data):
        k = np.searchsorted(off, b)
        places.append(k[off[np.minimum(k, n)] == b])
    words = set(places[3].tolist())
    out: list[tuple[int, int, str]] = []
    start = 0
    while True:
        room = limit - _swell(v, data, ids, off, start, words)
        if n - start <= room:
            out.append((start, n, "end"))
            return out
        stop, kind = 0, "hard"
        for least in (start + max(overlap + 1, int(room * fill)), start + overlap + 1):
            for name, p in zip(KINDS, places):
                i = np.searchsorted(p, start + room, "right") - 1
                if i >= 0 and p[i] >= least:
                    stop, kind = int(p[i]), name
                    break
            if stop:
                break
        if not stop:
            stop = start + room
            while stop > start + overlap + 1 and not clean[stop]:
                stop -= 1
            if not clean[stop]:
                stop = start + room
        out.append((start, stop, kind))
        nxt = stop - overlap
        while nxt > start + 1 and not clean[nxt]:
            nxt -= 1
        start = nxt


def _swell(v: Vocabulary, data: bytes, ids: np.ndarray, off: np.ndarray, start: int, words: set[int]) -> int:
    """By how many tokens the head of a piece that begins within a word may grow when its text is encoded alone."""
    if start == 0 or start in words:
        return 0
    end = start + 1
    while end < len(ids) and end - start < 32 and end not in words:
        end += 1
    alone = len(v.ids(data[off[start] : off[end]].decode("utf-8", "replace")))
    return max(0, alone - (end - start))


def split_texts(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    with_text: bool = True,
    name: str = VOCABULARY,
    folder: str = TOKENIZER_DIR,
) -> DataFrame:
    """Pieces of every text: ``key``, ``piece_no`` (from 0), ``n_pieces``, ``start_token``, ``n_tokens``, ``ended_at``
    and, if ``with_text``, ``piece``.

    A text within the limit is one piece; an empty one is one piece of no tokens; a null text gives no row. Texts that
    have no more bytes than the limit are not encoded to find that out (a token has at least a byte) unless their
    pieces' token counts are asked for with the text. Repeated rows stay repeated. One pass, no shuffle: a piece needs
    its own document only.
    """
    fields = [df.schema[key]] + [T.StructField(c, T.IntegerType()) for c in ("piece_no", "n_pieces", "start_token", "n_tokens")] + [T.StructField("ended_at", T.StringType())]
    if with_text:
        fields.append(T.StructField("piece", T.StringType()))
    names = [f.name for f in fields]
    types = [pa.int32()] * 4 + [pa.string()] * (1 + with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for whole in batches:
            for b in slices(whole, 1):
                rows: list[list] = [[] for _ in types]
                take = []
                for i, t in enumerate(b.column(1)):
                    s = t.as_py()
                    if s is None:
                        continue
                    ids = encode(v, s)
                    cuts = cut_tokens(v, s, ids, limit, overlap)
                    data, off = (s.encode(), np.append(0, np.cumsum(v.lengths[ids]))) if with_text and len(cuts) > 1 else (b"", None)
                    for k, (p, q, kind) in enumerate(cuts):
                        take.append(i)
                        cells = [k, len(cuts), p, q - p, kind]
                        if with_text:
                            cells.append(s if len(cuts) == 1 else data[off[p] : off[q]].decode("utf-8", "replace"))
                        for r, c in zip(rows, cells):
                            r.append(c)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(r, x) for r, x in zip(rows, types))], names=names)

    return df.select(key, text).mapInArrow(run, T.StructType(fields))


def oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key`` of each text that comes out in more than one piece, that is, has more than ``limit`` tokens.

    Only texts of more bytes than the limit can; the others stay in the scan.
    """
    big = df.select(key, text).where(F.octet_length(text) > limit)
    return split_texts(big, key, text, limit, overlap, with_text=False).where((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select(key)
