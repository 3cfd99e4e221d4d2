"""Encoding of whole texts with a public byte-level BPE vocabulary, as a bounded-lookahead streaming transducer.

Every text goes through ``StreamEncoder``, a window at a time; what it emits can't be changed by anything that follows:

* up to the last place in what has been read that is a token boundary whatever follows (white space after a letter, digit or
  printable sign, else a boundary of the vocabulary's split pattern that is settled), the native encoder gives the tokens;
* a single piece that fills the window goes through ``MergeTransducer``: from the merge list it is computed how many bytes
  of lookahead are sufficient (``sufficient_lookahead``); tokens that end so far before the end are stable and come out.

So at most the window, its next block and the lookahead wait, however long a text or a piece is. ``StreamDecoder`` is the
way back: an incremental byte-to-text state machine.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabularies are; a parameter of every function here, this is only its default.
TOKENIZER_DIR = os.environ.get("PAPERWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Characters that may wait for a boundary.
WINDOW = 1 << 12
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPLIT = regex.compile(PATTERN)
#: What continues an open piece: white space first.
_RUNS = tuple(regex.compile(p) for p in (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*"))


class Vocabulary:
    """A vocabulary of byte-level BPE ranks, with its native encoder."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.native = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)
        #: Bytes of the longest token.
        self.lookback = max(map(len, self.ranks))

    @cached_property
    def lookahead(self) -> int:
        """Bytes of lookahead that are sufficient for every text, see ``sufficient_lookahead``."""
        return sufficient_lookahead(self.ranks)

    def piece(self, b: bytes) -> list[int]:
        return self.native._core_bpe.encode_single_piece(b)

    def ids(self, text: str) -> np.ndarray:
        return self.native.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=4)
def vocabulary(name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> Vocabulary:
    return Vocabulary(os.path.join(folder, f"{name}.tiktoken"))


def merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int, int]]:
    """The merge list behind the ranks: for each merged token the tokens it is made from and the bytes of the left one.

    A token's last merge is that of its bytes alone, as nothing crosses its ends while it comes about. Raises ValueError
    if a token is made later than what it goes into, that is, if merging isn't in the order of the ranks.
    """
    out = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not at:
                raise ValueError(f"token {rank} can't be made by merging")
            i = min(at)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        a, b = parts
        if any(len(p) > 1 and ranks[p] > rank for p in parts):
            raise ValueError(f"token {rank} comes before its parts")
        out[rank] = (ranks[a], ranks[b], len(a))
    return out


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """How many bytes before the end of a prefix its tokens are the same whatever follows, at most.

    What follows can change the prefix's tokens only by a chain of merges, each of which takes place with one
    continuation and not with another: the first crosses the prefix's end and changes its left part; each further one
    reaches one token to the left, because its right part begins with the left part of the merge before, and comes
    later in the list. The longest chain, counted in bytes of the left parts, is found by going through the merges
    backwards with the best chain so far for each token a right part can begin with.
    """
    made = merges(ranks)
    best: dict[int, int] = {}
    most = 0
    for rank in sorted(made, reverse=True):
        left, right, n = made[rank]
        reach = n + best.get(left, 0)
        most = max(most, reach)
        while True:
            best[right] = max(best.get(right, 0), reach)
            if right not in made:
                break
            right = made[right][0]
    return most


class MergeTransducer:
    """BPE of one run of bytes, fed in pieces; gives tokens once no continuation can change them.

    What waits is encoded natively; the tokens that end at least the sufficient lookahead before its end are stable, and
    since no merge crosses the end of a token the rest can be encoded by itself later on. At most the lookahead and a
    token wait between two feeds, and a block more within one.
    """

    def __init__(self, v: Vocabulary, block: int = 4096, lookahead: int | None = None) -> None:
        self.v, self.block = v, block
        self.lookahead = v.lookahead if lookahead is None else lookahead
        self.data = b""

    def feed(self, more: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(more), self.block):
            self.data += more[k : k + self.block]
            if len(self.data) <= self.lookahead:
                continue
            ids = self.v.piece(self.data)
            ends = np.cumsum(self.v.lengths[ids])
            n = int(np.searchsorted(ends, len(self.data) - self.lookahead, "right"))
            if n:
                out += ids[:n]
                self.data = self.data[int(ends[n - 1]) :]
        return out

    def finish(self) -> list[int]:
        out, self.data = self.v.piece(self.data) if self.data else [], b""
        return out


class StreamEncoder:
    """Token ids of a text fed in pieces of any size; ``feed`` gives what is settled, ``finish`` the rest."""

    def __init__(self, v: Vocabulary, window: int = WINDOW) -> None:
        self.v, self.window, self.buf = v, max(8, window), ""
        #: The open run, if one piece has filled the window, and what continues it.
        self.run: MergeTransducer | None = None
        self.more = _RUNS[0]

    def feed(self, text: str) -> Iterator[np.ndarray]:
        for k in range(0, len(text), self.window):
            self.buf += text[k : k + self.window]
            if self.run is not None:
                yield self._continue()
            if len(self.buf) > self.window:
                cut = self._edge()
                if cut:
                    yield self.v.ids(self.buf[:cut])
                    self.buf = self.buf[cut:]
                if len(self.buf) > self.window:
                    yield from self._pieces()

    def _edge(self) -> int:
        """The last place in the waiting text with white space after something printable, 0 if there is none."""
        buf, i = self.buf, len(self.buf)
        while True:
            i = max(buf.rfind(" ", 1, i), buf.rfind("\n", 1, i))
            if i < 1 or buf[i - 1].isalnum() or "!" <= buf[i - 1] <= "~":
                return max(i, 0)

    def _pieces(self) -> Iterator[np.ndarray]:
        """What waits without such a place, piece by piece; three characters further on no piece can change its end."""
        while len(self.buf) > self.window:
            m = _SPLIT.match(self.buf)
            whole = m.end() == len(self.buf)
            if m.end() <= len(self.buf) - 3:
                yield np.array(self.v.piece(m[0].encode()), np.uint32)
                self.buf = self.buf[m.end() :]
                continue
            # the piece is open (or ends just here): it fills the window
            self.more = next(r for r in _RUNS if r.fullmatch(m[0][-1]))
            self.run = MergeTransducer(self.v)
            # the last white space belongs to what follows it, if that isn't white space
            end = m.end() - 1 if whole and self.more is _RUNS[0] else m.end()
            yield np.array(self.run.feed(m[0][:end].encode()), np.uint32)
            self.buf = self.buf[end:]
            return

    def _continue(self) -> np.ndarray:
        """The open run's part of what waits; ends the run if something else follows."""
        n = self.more.match(self.buf).end()
        ended = n < len(self.buf)
        if self.more is _RUNS[0]:
            n = max(0, n - 1)
        out = self.run.feed(self.buf[:n].encode())
        self.buf = self.buf[n:]
        if ended:
            out += self.run.finish()
            self.run = None
        return np.array(out, np.uint32)

    def finish(self) -> np.ndarray:
        if self.run is None:
            out, self.buf = self.v.ids(self.buf), ""
            return out
        # what waits beside an open run is its last white space, if anything
        ids = self.run.feed(self.buf.encode()) + self.run.finish()
        self.run, self.buf = None, ""
        return np.array(ids, np.uint32)


class StreamDecoder:
    """Text of token ids fed in pieces: a character comes out once its last byte is in; broken bytes become U+FFFD."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.v.bytes_of[int(i)] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode(v: Vocabulary, text: str | None, window: int = WINDOW) -> np.ndarray:
    """Ids of one text, none for a null or empty one."""
    if not text:
        return np.zeros(0, np.uint32)
    s = StreamEncoder(v, window)
    parts = [*s.feed(text), s.finish()]
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, without special tokens.

    Null and empty texts give an empty list; blanks are text and have ids. A special token's spelling within a text is
    ordinary text. Repeated rows stay repeated. One pass, no shuffle; every text streams through ``StreamEncoder``.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for whole in batches:
            for b in slices(whole, 1):
                parts = [encode(v, t.as_py()) for t in b.column(1)]
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) for p in parts], out=offsets[1:])
                values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of text, at least one row each, so output stays small too."""
    n = batch.num_rows
    if batch.column(column).nbytes <= most:
        if n:
            yield batch
        return
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key``, the ``carry`` columns and ``n_tokens`` of every row; 0 for null and empty texts."""
    keep = [key, *carry]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for b in batches:
            n = pa.array([len(encode(v, t.as_py())) for t in b.column(len(keep))], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``text`` of every row's token ids, decoded a thousand at a time; an empty or null list gives an empty text."""
    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for b in batches:
            texts = []
            for x in b.column(1):
                d, all_ids = StreamDecoder(v), x.as_py() or []
                texts.append("".join([*(d.feed(all_ids[k : k + 1024]) for k in range(0, len(all_ids), 1024)), d.finish()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key``, ``n_tokens`` and ``exact``: whether decoding the ids piece by piece gives the text back."""
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.IntegerType()), T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for b in batches:
            n, same = [], []
            for t in b.column(1):
                s = t.as_py() or ""
                ids, d = encode(v, s), StreamDecoder(v)
                back = "".join([*(d.feed(ids[k : k + 1024]) for k in range(0, len(ids), 1024)), d.finish()])
                n.append(len(ids))
                same.append(back == s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(same)], names=[key, "n_tokens", "exact"])

    return df.select(key, text).mapInArrow(run, schema)
