"""Toxicity scores of texts after noisy-channel restoration.

A character trigram model is counted over all documents. A token that looks disguised (digits or symbols before, between
or after letters, letters three times or more in a row, letters set apart one by one) becomes a lattice: each character
may be read as itself, as the letters it stands for in leetspeak, as a word's end (a separator), or as nothing (a
repetition or a separator), each at a cost. The Viterbi path of lowest cost under the model gives the restored words.
Tokens may have any length; time and memory grow in proportion to it. Letters of other scripts that look like Latin ones, wide and
styled forms, and characters without width are read as what they look like, beside the text as it stands. Words as written
and words restored are then looked up in a table of weights, and the weights of all distinct words found are added up.

The weights are the log odds of words, learned from labelled rows outside the held-out third; of a family of copies
(texts with one label that agree in three MinHash coordinates of their three-word shingles), the row with the smallest doc_id
counts. At most ``sample`` labelled rows are used (those with the smallest hashes of the doc_id). Only words whose odds speak
for toxicity beyond doubt (a 95 % bound) have a weight, so length alone moves no score; there is no other bound on the lexicon.

Null and empty texts get the prior's score. doc_ids without a label are scored like all others; a null doc_id is not
held out. Repeated rows give repeated results; other columns are ignored. With no label at all, every score is the prior of 0.1.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import crc_of_id, map_arrow, materialize, raw_texts, small_batches

SAMPLE, THRESHOLD, PRIOR, SURE, CACHE = 20_000, 0.7, 0.1, 2.2, 150_000
#: Characters whose trigrams are counted at once, some 50 bytes for each; a longer text is counted alone.
COUNTED = 500_000
#: The letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
MASKED = {"*": "aeiou"}
DROP = " ._-~'^`·,/\\:;\"\t\n\r"
#: Small letters of Cyrillic and Greek that look like Latin ones, in the order of these, and characters without width.
_LIKE = str.maketrans("аеорсухіјѕһԁӏкмтвнгпиαοινρτυκεηχγ", "aeopcyxijshdlkmtbhrnuaoivptukenxy", "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad")
_FOREIGN = re.compile("[\u0370-\u052f\u200b-\u200f\u2060\u00ad\ufeff\uff00-\uffef\U0001d400-\U0001d7ff]")
#: Costs of reading a character as nothing: one of a long run of equal letters, a separator, any other.
REPEATED, SEPARATED, REMOVED = 2.0, 0.4, 9.0
#: Cost of reading a separator as a word's end; the character model adds its own.
ENDED = 0.4
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)} | {c: 27 + i for i, c in enumerate("àáâäçèéêëíîïñóôöùúûüß")}
N = 27 + 21
WORD = re.compile(r"[^\W\d_]+")
_L = r"[^\W\d_]"
#: Disguises: letters set apart one by one; leet characters or separators before, between or after letters; a letter three times.
#: A disguise may begin after anything but a letter or a further leet character, which would be part of it.
_MARK, _LEAD, _TAIL = "0-9@$!|+(€£¡*", "0-9@$!|+(€£¡", "0-9@$!|+€£¡*"
_ONE, _APART = r"[^\W_]|[@$!|+(€£¡*]", r"[ ._\-*~'^`·,/\\:;\"\t\n\r]"
_SPACED = re.compile(rf"(?<![\w@$|+(€£¡])(?:{_ONE}){_APART}{{1,3}}(?:(?:{_ONE}){_APART}{{1,3}}){{2,}}(?:{_ONE})(?!\w)")
_MARKED = re.compile(rf"(?<!{_L})(?<![{_LEAD}])(?:[{_LEAD}]++{_L}++(?:[{_MARK}._\-~^·]++{_L}++)*[{_TAIL}]*|{_L}++(?:(?:[{_MARK}._\-~^·]++{_L}++)+[{_TAIL}]*|[{_TAIL}]+))(?![\w@])")
_LONG = re.compile(rf"(?<!{_L}){_L}*?({_L})\1\1{_L}*")
#: What a text must hold for _MARKED to match at all; far faster to find.
_MARKED_AT_ALL = re.compile(rf"[{_MARK}._\-~^·]{_L}|{_L}[{_TAIL}]")
#: Of a run of equal letters the first two may be read, the others cost the same whatever is read: three stand for any.
_RUN = re.compile(rf"({_L})\1{{3,}}")
_DROPS = re.compile(rf"[{re.escape(DROP)}]+")
_EQUAL = re.compile(r"(.)\1*", re.DOTALL)
_TRIPLES = [c * 3 for c in _CODE]


def _codes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for c, i in _CODE.items():
        if ord(c) < 256:
            out[ord(c)] = i
            up = c.upper()
            if len(up) == 1 and ord(up) < 256:
                out[ord(up)] = i
    return out


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of three characters in a row; every run of other than letters is one boundary."""
    code = _codes()
    for batch in batches:
        total = np.zeros(N**3, np.int64)
        held: list[str] = []
        size = 0

        def add(held=held, total=total):
            x = code[np.frombuffer("\n\n".join(["", *held, ""]).encode("latin-1", "replace"), np.uint8)]
            keep = np.ones(len(x), bool)
            keep[2:] = (x[2:] > 0) | (x[1:-1] > 0) | (x[:-2] > 0)
            x = x[keep]
            total += np.bincount((x[:-2] * N + x[1:-1]) * N + x[2:], minlength=N**3)
            held.clear()

        for t in batch.column(0).to_pylist():
            if t:
                held.append(t)
                size += len(t)
                if size > COUNTED:
                    add()
                    size = 0
        if held:
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


class Decoder:
    """Viterbi decoding of disguised tokens. table: cost of the third of three characters."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.known: dict[str, str] = {}

    def arcs(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """For each character what it may be read as, and at what cost; "" is nothing, " " a word's end."""
        for m in _EQUAL.finditer(token):
            c, n = m.group(1), len(m.group())
            for run in range(n):
                if c in _CODE:
                    yield [*([(c, 0.0)] if run < 2 or n < 3 else []), *([("", REPEATED)] if run and n >= 3 else [])]
                elif c in LEET:
                    yield [*((x, 0.5) for x in LEET[c]), ("", REMOVED)]
                else:
                    yield [*((x, 1.0) for x in MASKED.get(c, "")), *([("", SEPARATED), (" ", ENDED)] if c in DROP else [("", REMOVED)])]

    def __call__(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            got = self.decode(token)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = got
        return got

    def decode(self, token: str) -> str:
        # a path is (last character, path before it), so that each step costs the same however long it is
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for arc in self.arcs(_RUN.sub(r"\1\1\1", token)):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for c, own in arc:
                    if not c:
                        state, total, new = (a, b), cost + own, path
                    elif c != " " or b:
                        code = _CODE.get(c, 0)
                        state, total, new = (b, code), cost + own + self.table[(a * N + b) * N + code], (c, path)
                    else:
                        continue
                    if state not in after or total < after[state][0]:
                        after[state] = (total, new)
            best = after
        path = min(((cost + (self.table[(a * N + b) * N] if b else 0.0), path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])[1]
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))


def costs(counts: dict[int, int]) -> np.ndarray:
    """-log P(third | first two), smoothed with the shorter contexts."""
    n3 = np.zeros(N**3)
    for g, n in counts.items():
        n3[g] = n
    n3 = n3.reshape(N, N, N)
    p1 = (n3.sum((0, 1)) + 0.5) / (n3.sum() + 0.5 * N)
    p2 = (n3.sum(0) + 5 * p1) / (n3.sum((0, 2))[:, None] + 5)
    p3 = (n3 + 5 * p2[None]) / (n3.sum(2)[:, :, None] + 5)
    return -np.log(p3).ravel()


def _read(token: str, decode: Decoder) -> Iterator[str]:
    """Words that a disguise may stand for: as a whole, in one word, part by part, and without what may be punctuation at its ends."""
    yield from decode(token).split()
    parts = [x for x in _DROPS.split(token) if x]
    if len(parts) > 1:
        yield from decode("".join(parts)).split()
        for x in parts:
            if len(x) > 1 and not x.isalpha():
                yield from decode(x).split()
    if token[0] in "(!|+":
        yield from decode(token.lstrip("(!|+")).split()
    if not token[-1].isalpha() and not (core := token.rstrip("0123456789@$!|+€£¡*")).isalpha():
        yield from decode(core).split()


def in_chunk(chunk: str, decode: Decoder) -> set[str]:
    """The words behind the disguises in lower-case text without blanks."""
    found: set[str] = set()
    patterns = [_MARKED] if _MARKED_AT_ALL.search(chunk) else []
    if any(t in chunk for t in _TRIPLES):
        patterns.append(_LONG)
    for pattern in patterns:
        for m in pattern.finditer(chunk):
            found.update(_read(m.group(), decode))
    return found


def set_apart(low: str, decode: Decoder, lexicon: Iterable[str] = ()) -> set[str]:
    """The words of letters set apart one by one in a lower-case text.

    Nothing shows where such words end. Those of the lexicon with four letters or more are found wherever they stand.
    """
    found: set[str] = set()
    for m in _SPACED.finditer(low):
        token = m.group()
        if sum(map(str.isalpha, token)) < 2:
            continue
        one = _DROPS.sub("", token)
        bare, read = one.replace("*", ""), decode(one).split()
        found.update(decode(_DROPS.sub(lambda d: d.group()[0], token)).split(), read, decode(bare).split())
        found.update(w for w in lexicon if len(w) >= 4 and (w in bare or w in "".join(read)))
    return found


def readings(text: str) -> list[str]:
    """The text in lower case, and as it looks if it holds characters that look like others."""
    low = text.lower()
    return [low, unicodedata.normalize("NFKC", low).lower().translate(_LIKE)] if _FOREIGN.search(low) else [low]


def restored(low: str, decode: Decoder) -> set[str]:
    """The words behind the disguises in a lower-case text. Only letters set apart reach over blanks."""
    return set_apart(low, decode).union(*(in_chunk(c, decode) for c in set(low.split())))


def words_of(text: str | None, decode: Decoder) -> set[str]:
    """Distinct words of a text, lower-case, with those restored from disguise."""
    return set().union(*(restored(low, decode).union(WORD.findall(low)) for low in readings(text))) if text else set()


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled row with three minima over hashes of its three-word shingles, in which copies mostly agree."""
    turns = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    for batch in batches:
        own = []
        for text in raw_texts(batch.column(1)):
            hashes = bw.shingle_hashes(*bw.word_hashes(*bw.joined([text or b""])), 3)[0]
            own.append(bytes().join(bw.mix(hashes ^ t).min().tobytes() for t in turns) if len(hashes) else b"")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], ["doc_id", "text", "toxic", "family"])


def _train(decode: Decoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows[toxic] += 1
                seen[toxic].update(words_of(text, decode))
        words = [*(seen[0].keys() | seen[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array([None, *words], pa.string()), pa.array([rows[1], *(seen[1][w] for w in words)], pa.int64()), pa.array([rows[0], *(seen[0][w] for w in words)], pa.int64())], ["word", "toxic", "clean"])

    return run


class Scorer:
    def __init__(self, table: np.ndarray, weights: dict[str, float], prior: float):
        self.decode, self.weights, self.prior = Decoder(table), weights, prior
        self.chunks: dict[str, tuple[str, ...]] = {}

    def in_chunks(self, low: str) -> set[str]:
        """Words of the lexicon in a lower-case text, as they stand or disguised; what lies between blanks is looked up once."""
        hits: set[str] = set()
        known, weights = self.chunks, self.weights
        for c in set(low.split()):
            got = known.get(c)
            if got is None:
                got = tuple(w for w in {*WORD.findall(c), *in_chunk(c, self.decode)} if w in weights)
                if len(known) >= CACHE:
                    known.clear()
                known[c] = got
            if got:
                hits.update(got)
        return hits

    def __call__(self, text: str | None) -> float:
        hits: set[str] = set()
        for low in readings(text) if text else ():
            hits |= self.in_chunks(low) | (self.weights.keys() & set_apart(low, self.decode, self.weights))
        x = self.prior + math.fsum(self.weights[w] for w in hits)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def character_model(docs: DataFrame) -> np.ndarray:
    found = map_arrow(docs.select("text"), _trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return costs({r["gram"]: r["n"] for r in found.collect()})


def learn(docs: DataFrame, labels: DataFrame, table: np.ndarray, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """The weights of words and the prior's log odds."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(), F.lit(3)) != 1)).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = min(1.0, 1.1 * sample / max(1, usable.count()))
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    # exactly bounded by ``sample`` ids, so it may be sent to every executor
    drawn = usable.where(order <= F.lit(int(part * 2**53))).orderBy(order, "doc_id").limit(sample)
    rows = map_arrow(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic"), _families, "doc_id long, text string, toxic int, family binary")
    rows = rows.groupBy("family", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("r.text", "toxic")
    # read twice below, and texts are decoded only once
    counts = materialize(map_arrow(rows.select("text", "toxic"), _train(Decoder(table)), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    whole = counts.where("word is null").first()
    nt, nc = (whole["toxic"] or 0, whole["clean"] or 0) if whole else (0, 0)
    if not nt or not nc:
        return {}, math.log(PRIOR / (1 - PRIOR))
    weight = F.log((F.col("toxic") + 0.5) / (nt + 1)) - F.log((F.col("clean") + 0.5) / (nc + 1))
    doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    sure = F.col("word").isNotNull() & (F.col("toxic") >= max(3, round(0.002 * nt))) & (weight - 1.64 * doubt >= SURE)
    strong = counts.where(sure).select("word", weight.alias("w"))
    return {r["word"]: r["w"] for r in strong.collect()}, math.log(nt / nc)


def score_toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs: (doc_id, text, ...); labels: (doc_id, toxic, ...); corpus: what is learned from, docs unless given.

    Returns (doc_id, held_out, score, predicted), one row per row of docs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    corpus = docs if corpus is None else corpus
    table = character_model(corpus)
    weights, prior = learn(corpus, labels, table, sample)
    model = spark.sparkContext.broadcast((table, weights, prior))
    use = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import worker_state

        scorer = worker_state(("toxicity", use), lambda: Scorer(*model.value))
        for batch in batches:
            scores = [scorer(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double", keeps=True)
    return scored.select("doc_id", F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
