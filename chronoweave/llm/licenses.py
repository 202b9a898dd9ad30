"""License notices in whole texts: exact phrases, and short notices with a bounded number of edits.

A text is reduced to its words (lower-case; ASCII other than letters and digits separates), joined by single spaces.
Phrases are found there as they are. A notice that may differ by ``k`` edits is split into ``k + 1`` pieces: by the
pigeonhole principle, one of them stands unedited in every match, so an exact search for the pieces finds all
candidates. Around a candidate, the regex library matches the whole notice with at most ``k`` edits and gives the span
and the number of edits. Edits are of bytes of UTF-8 (an ASCII character is one); of overlapping matches of one notice the
leftmost candidate's best one counts, and the search goes on behind it.

Null, empty and wordless texts have no places and score 0. Repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, small_batches

#: Exact phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices, their labels and the edits (characters) that they may differ by.
NOTICES = [
    ("licensed under the apache license", "apache-2.0", 3),
    ("released under the mit license", "mit", 3),
    ("licensed under the gnu general public license", "gpl", 4),
    ("permission is hereby granted free of charge to any person", "mit", 5),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("creative commons attribution", "cc-by", 2),
    ("all rights reserved", "reserved", 2),
]
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """The notice cut into ``edits + 1`` pieces of nearly equal length, each with where it begins."""
    n, parts = len(notice), edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, int]] = NOTICES):
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [(notice, label, edits, pieces(notice, edits), regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(notice, special_only=True)}){{e<={edits}}}(?![^ ])".encode())) for notice, label, edits in notices]

    def places(self, text: bytes) -> list[tuple[int, str]]:
        """(byte, label) of each phrase in a text of words with a space on either side."""
        out = []
        for phrase, label in self.phrases:
            at = text.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = text.find(phrase, at + 1)
        return sorted(out)

    def fuzzy(self, text: bytes) -> list[tuple[int, int, str, int, int]]:
        """(begin, end, label, edits, length of the notice) of each notice, leftmost first; bytes of the text of words."""
        out = []
        for notice, label, edits, seeds, pattern in self.notices:
            spots = set()
            for begin, seed in seeds:
                at = text.find(seed)
                while at >= 0:
                    spots.add(at - begin)
                    at = text.find(seed, at + 1)
            done = -1
            for spot in sorted(spots):
                if spot + edits < done:
                    continue
                lo = max(0, spot - edits - 1, done)
                got = pattern.search(text, lo, min(len(text), spot + len(notice) + edits + 1))
                if got:
                    out.append((got.start(), got.end(), label, sum(got.fuzzy_counts), len(notice)))
                    done = got.end()
        return sorted(out)

    def words(self, text: bytes | None) -> tuple[int, bytes]:
        found = text.translate(_WORDS).split() if text else []
        return len(found), b" " + b" ".join(found) + b" "

    def scan(self, text: bytes | None) -> dict:
        n, flat = self.words(text)
        base = self.places(flat)
        spans = self.fuzzy(flat)
        blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32) if base or spans else None
        word = lambda at: int(np.searchsorted(blanks, at, "right")) - 1
        named = [(word(a if flat[a] != 32 else a), word(b - 1) + (flat[b - 1] != 32), label, e, size) for a, b, label, e, size in spans]
        sure = max([0.0, *(1.0 for _ in base), *(1 - e / size for _, _, _, e, size in named)])
        covered = sum(e - b for b, e, *_ in named) + 3 * len(base)
        return {
            "n_words": n,
            "n_base": len(base),
            "first_word": word(base[0][0]) if base else None,
            "last_word": word(base[-1][0]) if base else None,
            "base_labels": ",".join(sorted({label for _, label in base})),
            "labels": ",".join(sorted({label for _, label in base} | {x[2] for x in named})),
            "score": sure * (0.8 + 0.2 * min(1.0, covered / n)) if n else 0.0,
            "spans": [{"begin_word": b, "end_word": e, "label": label, "edits": edits} for b, e, label, edits, _ in named],
        }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<begin_word: long, end_word: long, label: string, edits: long>>"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """docs: (doc_id, text, ...). Returns SCHEMA, one row per row of docs; spans are those of the fuzzy search."""
    small_batches(docs.sparkSession)
    span = pa.struct([("begin_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("edits", pa.int64())])
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sys.modules[__name__].__dict__.setdefault("_scanners", {})
        use = repr((phrases, notices))
        if use not in held:
            held[use] = Scanner(phrases, notices)
        scanner = held[use]
        for batch in batches:
            rows = [scanner.scan(t) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in types.items())], ["doc_id", *types])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
