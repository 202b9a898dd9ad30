"""Near-duplicates by an inverted join over MinHash coordinates.

Every document posts one (coordinate, value) item for each of ``coordinates`` minima. Two documents whose sets have a
Jaccard similarity of 0.85 agree in ``coordinates * 0.85`` items on average; a pair is retained when it agrees in at
least ``matches`` of them (22 of 40: a link at exactly 0.85 is lost with probability 1.2e-6) and then confirmed on the
full shingle sets. Counting uses the prefix filter: with items ordered from rare to frequent, two documents that agree
in ``matches`` items share one of the first ``coordinates - matches + 1`` of each, so only those are joined; the long
posting lists are skipped and their agreement is counted on the signatures of documents that met in a short list.

Items held by one document only make most documents drop out before anything else is moved. Equal sets form one class
beforehand (equal by two 64-bit sums over their hashes and their size; these classes aren't compared again). A large bucket is
cut into blocks of ``block`` documents, each pair of blocks a row group of its own, so no group has to fit a task. Of a bucket
only pairs that span it leave the task, each of a document and the one it was reached from, never all pairs.

Pairs are confirmed where they were found: a pair's first text is moved to the second, which is copied once for every
``block`` of its partners. Most groups of candidates are then one component. In those that aren't, documents outside
the largest component may still be linked to others than their partner. They are left out if too many of their shingles stand
nowhere else in the group to reach the similarity with anything; what remains is compared, by blocks and on hashed sets, with
the members of other components only, and the spanning pairs found there are confirmed on texts like the first ones.

Null and empty texts, and texts without words, have an empty set and link with nothing. Repeated doc_ids keep their
rows and share the class of their text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import BLOOM, grouped_stream, map_arrow, materialize, raw_texts, settings, small_batches
from .components import connected_components

COORDINATES, MATCHES, WORDS, PERCENT, BLOCK, SET_BLOCK = 40, 22, 5, 85, 2048, 512
#: Bytes of texts whose words are hashed at once, some 50 bytes for each; a longer text is hashed alone.
HASHED = 250_000


def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(977).integers(1, 2**63, (2, k), dtype=np.uint64) | np.uint64(1)


def _signatures(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(k)
        for batch in batches:
            texts = list(raw_texts(batch.column(1)))
            n = len(texts)
            size, c1, c2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sig: list[bytes | None] = [None] * n
            for lo, hi in bw.chunks(texts, HASHED):
                hashes, at = bw.shingle_hashes(*bw.word_hashes(*bw.joined(texts[lo:hi])), words)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                mins = np.empty((len(full), k), np.uint32)
                for j in range(k):
                    mins[:, j] = np.minimum.reduceat(((hashes * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), at[full])
                for row, i in enumerate(full.tolist()):
                    own = np.unique(hashes[at[i] : at[i + 1]])
                    size[lo + i] = len(own)
                    c1[lo + i] = own.sum(dtype=np.uint64)
                    c2[lo + i] = bw.mix(own ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)
                    sig[lo + i] = mins[row].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "c1", "c2", "sig"])

    return run


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(k, dtype=np.int64) << 32
        for batch in batches:
            rep = batch.column(0).to_numpy()
            if not len(rep):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(rep), k)
            yield pa.RecordBatch.from_arrays([pa.array((sig.astype(np.int64) + base).ravel()), pa.array(np.repeat(rep, k))], ["item", "rep"])

    return run


def _tree(n: int, link) -> np.ndarray:
    """For each of n nodes the one that it was reached from, itself for the first of each component. link(i, rest): which of the nodes in rest are linked to i."""
    parent = np.arange(n)
    left = np.arange(n)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            hit = link(i, left)
            parent[left[hit]] = i
            front.extend(left[hit].tolist())
            left = left[~hit]
    return parent


def _blocked(df: DataFrame, count: str, block: int) -> DataFrame:
    """Rows with the pairs (bi, bj) of blocks in which they take part: one for a group of at most ``block`` rows."""
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("int")
    df = df.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(F.least(F.col("_b"), o).alias("bi"), F.greatest(F.col("_b"), o).alias("bj")))
    return df.withColumn("_p", F.explode(pairs)).withColumn("bi", F.col("_p.bi")).withColumn("bj", F.col("_p.bj")).drop("_p", "_n", "_b")


def _bucket_links(k: int, matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[int] = []
        vs: list[int] = []

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["a", "b"])
            us.clear()
            vs.clear()
            return got

        for _, parts in grouped_stream(batches, ["item", "bi", "bj"]):
            rep = np.concatenate([p.column(3).to_numpy() for p in parts])
            if len(rep) < 2:
                continue
            sig = np.frombuffer(b"".join(x for p in parts for x in p.column(4).to_pylist()), np.uint32).reshape(len(rep), k)
            parent = _tree(len(rep), lambda i, rest, sig=sig: (sig[rest] == sig[i]).sum(1) >= matches)
            far = np.flatnonzero(parent != np.arange(len(rep)))
            us.extend(rep[far].tolist())
            vs.extend(rep[parent[far]].tolist())
            if len(us) >= 50_000:
                yield out()
        if us:
            yield out()

    return run


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text: bytes, k: int) -> set[bytes]:
    words = text.translate(_LOWER).split()
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def _confirm(words: int, percent: int):
    """Rows (b, part, kind, a, text): the text of b (kind 0) and after it those of its partners a (kind 1). Gives the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            us: list[int] = []
            vs: list[int] = []
            for b, part, kind, a, text in zip(*(batch.column(i).to_pylist() for i in range(4)), raw_texts(batch.column(4)), strict=True):
                if (b, part) != key:
                    key, own = (b, part), []
                x = shingle_set(text, words)
                if not kind:
                    own.append(x)
                    continue
                for y in own:
                    both = len(x & y)
                    if x and 100 * both >= percent * (len(x) + len(y) - both):
                        us.append(a)
                        vs.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["a", "b"])

    return run


def _confirmed(texts: DataFrame, pairs: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """pairs: (a, b), a written table. Those whose sets are alike. A text is moved once for each pair in which it is a, and once for every ``block`` in which it is b."""
    fan = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    dealt = pairs.join(fan, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    hubs = fan.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = dealt.select("b", "part", F.lit(1).alias("kind"), "a").union(hubs.select("b", "part", F.lit(0).alias("kind"), F.col("b").alias("a")))
    # a written table behind a comparison, as Spark makes a Bloom filter of no other
    wanted = materialize(wanted, "wanted").where("kind >= 0")
    moved = texts.join(wanted, F.col("doc_id") == F.col("a")).select("b", "part", "kind", "a", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return map_arrow(moved.repartition("b", "part").sortWithinPartitions("b", "part", "kind"), _confirm(words, percent), "a long, b long")


def _hashed_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(raw_texts(batch.column(3)))
            own = [np.unique(bw.shingle_hashes(*bw.word_hashes(*bw.joined([t])), words)[0]).view(np.int64) for t in texts]
            flat = np.concatenate(own) if own else np.zeros(0, np.int64)
            offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["component", "rep", "own", "shingles"])

    return run


def _block_links(percent: int):
    """Rows (component, bi, bj, rep, own, shingles): pairs of different ``own`` whose hashed sets are alike, as many as span them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped_stream(batches, ["component", "bi", "bj"]):
            rep, own = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (3, 4))
            if len(rep) < 2 or (own == own[0]).all():
                continue
            sets = [np.asarray(x, np.int64) for p in parts for x in p.column(5).to_numpy(zero_copy_only=False)]
            size = np.array([len(x) for x in sets])
            codes, flat = np.unique(np.concatenate(sets), return_inverse=True)
            ids = np.split(flat, np.cumsum(size)[:-1])
            flag = np.zeros(len(codes), np.int64)
            group = own.copy()
            us, vs = [], []
            for i in np.argsort(rep):
                near = np.flatnonzero((group != group[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
                flag[ids[i]] = 1
                for j in near.tolist():
                    both = int(flag[ids[j]].sum()) if group[j] != group[i] else 0
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        us.append(int(rep[i]))
                        vs.append(int(rep[j]))
                        group[group == group[j]] = group[i]
                flag[ids[i]] = 0
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["a", "b"])

    return run


def _missed(texts: DataFrame, groups: DataFrame, links: DataFrame, words: int, percent: int, block: int) -> DataFrame | None:
    """groups: (node, component) of candidate pairs; links: confirmed ones. Further pairs whose hashed sets are alike; None if every group is one component."""
    own = connected_components(links, "own").withColumnRenamed("component", "own")
    placed = groups.join(own, "node", "left").select("component", F.col("node").alias("rep"), F.coalesce("own", "node").alias("own"))
    placed = materialize(placed, "placed")
    parts = placed.groupBy("component", "own").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("component").agg(F.count("*").alias("k"), F.max_by("own", F.struct("n", "own")).alias("main")).where("k > 1")
    members = materialize(placed.join(open_.select("component", "main", "k"), "component"), "open").where("k > 1")
    if members.isEmpty():
        return None
    fetched = texts.join(members, F.col("doc_id") == F.col("rep")).select("component", "rep", F.struct("own", "main").alias("own"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    fetched = map_arrow(fetched, _hashed_sets(words), "component long, rep long, own struct<own: long, main: long>, shingles array<long>")
    sets = materialize(fetched.select("component", "rep", "own.own", "own.main", "shingles"), "sets")
    # a shingle that one member alone holds is in no intersection; merged on the map side, so a passage that all share is no hot key
    alone = sets.select("component", "rep", F.explode("shingles").alias("x")).groupBy("component", "x").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"), F.count("*").alias("n"))
    alone = alone.where("n = 1 and rep = other").groupBy("component", "rep").agg(F.count("*").alias("alone"))
    able = sets.join(alone, ["component", "rep"], "left").where(100 * (F.size("shingles") - F.coalesce("alone", F.lit(0))) >= percent * F.size("shingles"))
    able = materialize(able.drop("alone"), "able")
    sizes = able.groupBy("component").agg(F.count("*").alias("n"), F.sum((F.col("own") != F.col("main")).cast("int")).alias("loose")).where("loose > 0 and n > 1")
    wanted = able.join(sizes, "component")
    wanted = _blocked(wanted, "n", block).select("component", "bi", "bj", "rep", "own", "shingles")
    return map_arrow(wanted.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj", "rep"), _block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """docs: (doc_id, text, ...). Returns (doc_id, n_shingles, component_id, class_size, kept), one row per row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    signed = materialize(map_arrow(texts, _signatures(words, coordinates), "doc_id long, n_shingles long, c1 long, c2 long, sig binary"), "sig")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("rep"), "sig"))
    classes = signed.where("n_shingles > 0").groupBy("c1", "c2").agg(first.alias("f"), F.count("*").alias("class_size"))
    classes = materialize(classes.select("c1", "c2", "class_size", "f.rep", "f.sig"), "class")
    reps = classes.where("rep is not null").select("rep", "sig")
    posts = map_arrow(reps, _items(coordinates), "item long, rep long")
    often = posts.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    # of each document: its items that another document has too, rare ones first; all others come before them
    shared = posts.join(often, "item").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("held")).where(F.size("held") >= matches)
    alone = coordinates - F.size("held")
    prefix = shared.select("rep", F.explode(F.slice("held", F.lit(1), F.lit(coordinates - matches + 1) - alone)).alias("h"))
    prefix = materialize(prefix.select("rep", F.col("h.item").alias("item")), "prefix")
    lists = prefix.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    met = prefix.join(lists, "item").join(reps, "rep")
    buckets = _blocked(met, "n", block).select("item", "bi", "bj", "rep", "sig")
    likely = map_arrow(buckets.repartition("item", "bi", "bj").sortWithinPartitions("item", "bi", "bj", "rep"), _bucket_links(coordinates, matches), "a long, b long")
    likely = materialize(likely.distinct(), "likely")
    groups = materialize(connected_components(likely, "groups"), "groups")
    with settings(spark, BLOOM):
        links = materialize(_confirmed(texts, likely, words, percent, block), "links")
        missed = _missed(texts, groups, links, words, percent, SET_BLOCK)
        if missed is not None:
            missed = materialize(missed.distinct(), "missed")
            links = materialize(links.union(_confirmed(texts, missed, words, percent, block)), "links")
    final = connected_components(links, "final").withColumnRenamed("node", "rep")
    of = materialize(classes.join(final, "rep", "left").select("c1", "c2", "class_size", F.coalesce("component", "rep").alias("component_id")), "of")
    placed = signed.drop("sig").join(of, ["c1", "c2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
