"""Hierarchical multi-length packing of documents into token sequences of several lengths.

Inside every task: a document's full windows of the largest tier leave at once; its rest is routed to the smallest tier
(a power of two) that holds it, and each tier has a pool of its own. The tiers are packed one after another, the longest first:
the longest rest of a tier opens a window of its length, and the gap is filled with the longest rests of shorter
tiers that fit (in the shortest tier, with its own). At most ``GAP_SHARE`` of what a tier holds goes into longer windows while
there are other rests to cut, so every tier packs windows of its own. What is still missing is cut from the shortest rest that
is long enough. No piece shorter than ``LEAST`` ids is made where another choice is left (a shorter document, a gap of a few
ids that nothing else closes, and a task's end leave none). A window stays open until it is full, so only what a task holds at
its end is left, which goes into ever shorter windows of a power of two; no token of padding is made.

Step groups are balanced over the whole table: windows are lined up by length and task, with exact sums of what earlier tasks
hold, and cut where ``GROUP_WINDOWS`` of the largest length are full. Lengths are powers of two, so all groups but the last have the
same number of tokens. For that the pieces (not the texts) are written once, and a row for each task and length is summed up.

No text is shuffled: tasks pack their own documents and number their sequences in a range of their own, so a task that
is run again gives the same rows. A buffer of about two million ids bounds the memory.

Where the file states the normalizer and pre-tokenizer that allow it, a text is put in lower case and cut into pieces as they say, whole
and in one pass, known pieces are looked up and others go through the library's model; with any other file whole texts go
through the library. A worker's caches change no id: of pieces in use none is dropped when a cache is full.

Null and empty texts are the end id alone. Repeated rows are packed each. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, raw_texts, small_batches, worker_state
from .tokens import byte_level, load, states

TIERS, END_ID, BUFFER, GROUP_WINDOWS = (256, 512, 1024, 2048), 1, 2_000_000, 16
#: Pieces in each of a worker's two caches, and words in its third.
CACHE, WORDS = 200_000, 100_000
LEAST, GAP_SHARE, BROADCAST_ROWS = 32, 0.5, 200_000
#: How a file must cut texts for its pieces to be encoded one by one.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]}
#: The same cut for Latin-1 in lower case, which NFC leaves as it is: letters, numbers, and what ends a run of letters.
_LETTER, _NUMBER = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe"
_CUT = re.compile(rb"([^ " + _LETTER + rb"](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<=[" + _NUMBER + rb"])|[^ " + _LETTER + _NUMBER + rb"]*))")
_LOWER = bytes(32 if chr(c) in "\t\n\v\f\r \x85\xa0" else ord(chr(c).lower()) for c in range(256))


def by_word_file(path: str) -> bool:
    return states(path, _NORMALIZER, _PRE_TOKENIZER, "</w>")


def _lowered(text: bytes) -> bytes | None:
    """A text in UTF-8 as Latin-1 in lower case, white space as blanks; None with characters beyond."""
    try:
        return (text if text.isascii() else text.decode().encode("latin-1")).translate(_LOWER)
    except UnicodeEncodeError:
        return None


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes; piece by piece under a BPE file whose pre-tokens never hold white space."""

    def __init__(self, path: str, by_word: bool | None = None):
        """by_word: whether the file lets pieces be encoded one by one; read from it if not given."""
        self.tok = load(path)
        self.model = self.tok.model
        self.by_word = by_word_file(path) if by_word is None else by_word
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        #: Ids of pieces in use, and of those that were in use before that; a piece met again comes back into the first.
        self.recent: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}
        #: Ids of words that only the library may cut.
        self.words: dict[bytes, bytes] = {}

    def library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def miss(self, piece: bytes) -> bytes:
        """Ids of a piece that was not in use; it may have come up earlier in the same text."""
        ids = self.earlier.get(piece) or self.recent.get(piece)
        if ids is None:
            got = [t.id for t in self.model.tokenize(byte_level(piece.decode("latin-1")))]
            ids = struct.pack(f"<{len(got)}I", *got)
        if len(self.recent) >= CACHE:
            self.earlier, self.recent = self.recent, {}
        if len(piece) <= 60:
            self.recent[piece] = ids
        return ids

    def plain(self, text: bytes) -> bytes:
        """Of a text as :func:`_lowered` gives it."""
        pieces = b" ".join(_CUT.split(text)).split()
        found = list(map(self.recent.get, pieces))
        if None in found:
            found = [self.miss(p) if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        return b"".join(found)

    def mixed(self, text: bytes) -> bytes:
        """Words with special strings or characters beyond Latin-1 go through the library, what stands between them as other texts do."""
        out, between = [], []
        for word in text.split():
            ids = self.words.get(word)
            if ids is None:
                low = None if any(x in word for x in self.special) else _lowered(word)
                if low is not None:
                    between.append(low)
                    continue
                ids = self.library(word.decode())
                if len(self.words) >= WORDS:
                    self.words.clear()
                if len(word) <= 60:
                    self.words[word] = ids
            if between:
                out.append(self.plain(b" ".join(between)))
                between = []
            out.append(ids)
        return b"".join(out) + self.plain(b" ".join(between))

    def __call__(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.library(text.decode())
        low = None if any(x in text for x in self.special) else _lowered(text)
        return self.mixed(text) if low is None else self.plain(low)


class Packer:
    """Takes documents, gives rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, nth), nth of the task's windows of that length."""

    def __init__(self, first: int, tiers: tuple[int, ...] = TIERS, least: int = LEAST, share: float = GAP_SHARE):
        self.tiers, self.least, self.share = sorted(tiers), least, share
        #: Of each tier: (length, key) in order; what a key stands for; how much of it longer windows may still take.
        self.pools: list[list[tuple[int, int]]] = [[] for _ in tiers]
        self.docs: dict[int, tuple] = {}
        self.spare = [0.0] * len(tiers)
        self.keys, self.held = 0, 0
        self.next_sequence = first
        self.made: dict[int, int] = {}
        self.full: list[tuple[int, list]] = []

    def add(self, doc_id, ids: bytes) -> None:
        top, total, at = self.tiers[-1], len(ids) // 4, 0
        while total - at >= top:
            self.full.append((top, [(doc_id, at, top, total, ids)]))
            at += top
        if at < total:
            self._rest(doc_id, at, total - at, total, ids)
        self.held += total

    def _rest(self, doc_id, start: int, length: int, total: int, ids: bytes) -> None:
        self.docs[self.keys] = (doc_id, start, total, ids)
        insort(self.pools[bisect_left(self.tiers, length)], (length, self.keys))
        self.keys += 1

    def _take(self, tier: int, i: int, most: int) -> tuple:
        """The i-th rest of a tier, or its first ``most`` ids, in which case the others go back to their tier."""
        length, key = self.pools[tier].pop(i)
        doc_id, start, total, ids = self.docs.pop(key)
        if length > most:
            self._rest(doc_id, start + most, length - most, total, ids)
            length = most
        return doc_id, start, length, total, ids

    def _whole(self, tier: int, room: int, free: bool) -> tuple | None:
        """The longest rest of shorter tiers that fits and leaves no gap under ``least``; ``free``: beyond the share that a tier spares, too."""
        for t in range(max(0, tier - 1), -1, -1):
            pool = self.pools[t]
            i = bisect_right(pool, (room, sys.maxsize)) - 1
            if i >= 0 and 0 < room - pool[i][0] < self.least:
                i = bisect_right(pool, (room - self.least, sys.maxsize)) - 1
            if i >= 0 and (free or t == tier or pool[i][0] <= self.spare[t]):
                self.spare[t] -= pool[i][0]
                return self._take(t, i, room)
        return None

    def _cut(self, room: int) -> tuple | None:
        """Just ``room`` ids of the shortest rest that has ``least`` more."""
        for t in range(bisect_left(self.tiers, min(room + self.least, self.tiers[-1])), len(self.tiers)):
            i = bisect_left(self.pools[t], (room + self.least, -1))
            if i < len(self.pools[t]):
                return self._take(t, i, room)
        return None

    def _any(self, room: int) -> tuple | None:
        """Whatever is left: the longest that fits, or a part of the shortest."""
        for t in range(len(self.tiers) - 1, -1, -1):
            i = bisect_right(self.pools[t], (room, sys.maxsize)) - 1
            if i >= 0:
                return self._take(t, i, room)
        return next((self._take(t, 0, room) for t, pool in enumerate(self.pools) if pool), None)

    def _fill(self, tier: int, window: list, room: int) -> int:
        while room:
            piece = self._whole(tier, room, False)
            if not piece and room >= self.least:
                piece = self._cut(room)
            piece = piece or self._whole(tier, room, True) or self._cut(room) or self._any(room)
            if not piece:
                break
            window.append(piece)
            room -= piece[2]
        return room

    def pack(self, last: bool) -> Iterator[tuple]:
        open_window: list = []
        self.spare = [self.share * sum(n for n, _ in pool) for pool in self.pools]
        # the longest tier first; a cut may give a rest back to a longer one
        while any(self.pools):
            tier = next(t for t in reversed(range(len(self.tiers))) if self.pools[t])
            size = self.tiers[tier]
            longest = self.pools[tier][-1][0]
            # a gap of a few ids is made wide enough for a piece
            narrow = 0 < size - longest < self.least and longest >= 2 * self.least
            window = [self._take(tier, len(self.pools[tier]) - 1, longest - self.least if narrow else size)]
            if self._fill(tier, window, size - window[0][2]):
                open_window = window
            else:
                self.full.append((size, window))
        left = sum(p[2] for p in open_window)
        for doc_id, start, length, total, ids in open_window:
            self._rest(doc_id, start, length, total, ids)
        for bit in reversed(range(left.bit_length() if last else 0)):
            if left >> bit & 1:
                window, room = [], 1 << bit
                while room:
                    window.append(self._any(room))
                    room -= window[-1][2]
                self.full.append((1 << bit, window))
        self.held = sum(n for pool in self.pools for n, _ in pool)
        yield from self._number()

    def _number(self) -> Iterator[tuple]:
        for size, window in self.full:
            nth = self.made.get(size, 0)
            self.made[size] = nth + 1
            offset = 0
            for doc_id, start, length, total, ids in window:
                yield doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, self.next_sequence, offset, size, nth
                offset += length
            self.next_sequence += 1
        self.full = []


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "nth"]
TASK = 32


def step_groups(pieces: DataFrame, tokens: int) -> DataFrame:
    """pieces: a written table of the packer's rows. Adds step_group: windows by length, then by task, ``tokens`` ids together."""
    task = F.shiftright("sequence_id", TASK)
    made = pieces.groupBy(task.alias("task"), "tier").agg((F.max("nth") + 1).alias("n"))
    # a row for each task and length, so one window over all of them
    before = F.sum(F.col("n") * F.col("tier")).over(Window.orderBy(F.desc("tier"), "task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") * F.col("tier")
    starts = materialize(made.select("task", "tier", before.alias("before")), "starts")
    few = starts.count() <= BROADCAST_ROWS
    out = pieces.withColumn("task", task).join(F.broadcast(starts) if few else starts, ["task", "tier"])
    return out.select(*_COLUMNS[:-1], F.floor((F.col("before") + F.col("nth") * F.col("tier")) / F.lit(tokens)).cast("long").alias("step_group"))


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, buffer: int = BUFFER) -> DataFrame:
    """docs: (doc_id, text, ...). Returns a row for each piece of a document in a sequence."""
    small_batches(docs.sparkSession)
    by_word = by_word_file(path)  # here, as a worker would keep the memory of the parsed file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = worker_state(("packing", path), lambda: Ids(path, by_word))
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << TASK, tiers)

        def out(rows: Iterator[tuple]):
            cols = list(zip(*rows, strict=True)) or [[]] * len(_COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _COLUMNS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                packer.add(doc_id, ids(text) + end)
                if packer.held >= buffer:
                    yield out(packer.pack(False))
        yield out(packer.pack(True))

    pieces = map_arrow(docs.select("doc_id", "text"), run, ", ".join(f"{c} long" for c in _COLUMNS), keeps=True)
    return step_groups(materialize(pieces, "pieces"), GROUP_WINDOWS * max(tiers))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
