"""Benchmark passages in documents by spaced seeds. DataFrame functions only.

A mask is a fixed set of token positions; the hash of the tokens under a mask doesn't see those between, so a
substituted token there changes nothing. The hashes of both masks at every position of every document are joined with
those of the benchmark. A hit fixes a diagonal (the item and how far its tokens are shifted); around it, tokens of the
item and the document are compared one by one, and an overlap counts if some window of ``WINDOW`` tokens (the whole
item, if shorter) agrees but for one token in five.

The masks cover the rule: however the tokens that may differ lie in such a window, one mask fits somewhere between them
(tests/llm enumerates all patterns), so no overlap that counts is missed. A document's end inside the window is a
difference like any other.

Items with fewer than ``LEAST`` tokens are found where they stand unchanged, by a mask that is as long as the item; there is
such a mask only for lengths that the benchmark holds. An item of one word therefore marks every text with that word.

Tokens are lower-case (A-Z) runs of letters, digits and characters beyond ASCII. Items without tokens are in nothing.
Null and empty texts hold nothing. Each row is judged by its own text, whatever its doc_id.

The benchmark's distinct hashes are broadcast only if they are few (8 bytes each); otherwise they are joined by shuffle behind a
Bloom filter. Which items a hash belongs to is joined afterwards, to the few document places that are left, row by row:
no row gathers all items of a hash. Texts of items are broadcast only below a size in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOOM, let, materialize, settings

#: The tokens under each mask: 110111 and 110001011. Each is placed wherever its own span fits.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 5, 7, 8))
SPANS = tuple(m[-1] + 1 for m in MASKS)
LEAST, WINDOW = 11, 15
#: An overlap counts if this many of a window's tokens agree, in hundredths.
AGREE = 80
BROADCAST_SEEDS, BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 200_000, 16 << 20


def tokens(text: str) -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def seeds(words: Column, lengths: tuple[int, ...] = ()) -> Column:
    """Hashes of the first mask at all positions, those of the second, then those of whole runs of each length."""

    def under(h: Column, pairs: Column) -> Column:
        n = F.size(h)
        at = lambda span: F.greatest(n - (span - 1), F.lit(0))
        first = F.transform(F.slice(pairs, F.lit(1), at(SPANS[0])), lambda x, i: F.xxhash64(x, F.get(pairs, i + 3), F.get(h, i + 5), F.lit(0)))
        second = F.transform(F.slice(pairs, F.lit(1), at(SPANS[1])), lambda x, i: F.xxhash64(x, F.get(h, i + 5), F.get(pairs, i + 7), F.lit(1)))

        def run(k: int) -> Column:
            return F.transform(F.slice(h, F.lit(1), at(k)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k)), F.lit(100 + k)))

        return F.concat(first, second, *map(run, lengths))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))), lambda p: under(h, p)))


def _places(df: DataFrame, key: str, lengths: tuple[int, ...]) -> DataFrame:
    """(key, seed, pos) of every seed of a text; pos is the token at which the mask begins."""
    made = df.select(key, let(tokens("text"), lambda w: F.struct(F.size(w).alias("n"), seeds(w, lengths).alias("seeds"))).alias("t"))
    out = made.select(key, F.col("t.n").alias("n"), F.posexplode("t.seeds").alias("at", "seed"))
    return out.select(key, "seed", _begin(F.col("at"), F.col("n"), (*SPANS, *lengths)).cast("int").alias("pos"))


def _begin(at: Column, n: Column, spans: tuple[int, ...]) -> Column:
    """The token of the at-th seed of a text of n tokens."""
    out, before = None, F.lit(0)
    for span in spans:
        here = F.greatest(n - (span - 1), F.lit(0))
        out = F.when(at < before + here, at - before) if out is None else out.when(at < before + here, at - before)
        before = before + here
    return out


def _item_places(items: DataFrame) -> DataFrame:
    """(item, seed, item_pos): of long items the masks at all positions, of a short one the whole."""
    w = F.col("item_words")
    whole = None
    for k in range(1, LEAST):
        own = F.array(F.xxhash64(*(F.xxhash64(F.get(w, F.lit(j))) for j in range(k)), F.lit(100 + k)))
        whole = F.when(F.size(w) == k, own) if whole is None else whole.when(F.size(w) == k, own)
    made = items.select("item", F.size(w).alias("n"), F.posexplode(whole.otherwise(seeds(w))).alias("at", "seed"))
    return made.select("item", "seed", F.when(F.col("n") < LEAST, 0).otherwise(_begin(F.col("at"), F.col("n"), SPANS)).cast("int").alias("item_pos"))


def _overlap(doc: Column, item: Column, shift: Column) -> Column:
    """Most agreeing tokens in a window of the item, as (agreeing, least that count, agreeing in all)."""
    same = F.transform(item, lambda w, k: F.coalesce(w == F.when(k + shift >= 0, F.get(doc, k + shift)), F.lit(False)).cast("int"))
    size = F.least(F.lit(WINDOW), F.size(item))

    def best(s: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(1), F.size(item) - size + 1), lambda k: F.aggregate(F.slice(s, k, size), F.lit(0), lambda a, x: a + x))
        least = F.when(size < LEAST, size).otherwise(F.ceil(size * F.lit(AGREE) / 100))
        return F.struct(F.array_max(sums).alias("agreeing"), least.alias("least"), F.aggregate(s, F.lit(0), lambda a, x: a + x).alias("total"))

    return let(same, best)


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): each row under a hash of its own values, so that it is judged by its own text whatever its doc_id."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _overlaps(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps (row, item_id, agreeing, total), a written table."""
    spark = rows.sparkSession
    found = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", tokens("text").alias("item_words"))
    items = materialize(found.where(F.size("item_words") > 0).dropDuplicates(["item"]), "items")
    sizes = items.agg(F.sum(F.octet_length(F.array_join("item_words", " "))).alias("bytes"), F.collect_set(F.when(F.size("item_words") < LEAST, F.size("item_words"))).alias("short")).first()
    lengths = tuple(sorted(sizes["short"]))
    keyed = materialize(_item_places(items).distinct(), "seeds")
    distinct = keyed.select("seed").distinct()
    few = distinct.count() <= BROADCAST_SEEDS
    with settings(spark, {} if few else BLOOM):
        places = materialize(_places(rows, "row", lengths).join(F.broadcast(distinct) if few else distinct, "seed", "left_semi"), "places")
    hits = materialize(places.join(keyed, "seed").select("row", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "hits")
    few = hits.count() <= BROADCAST_ROWS
    words = items.select("item", "item_id", "item_words")
    pairs = rows.select("row", "text").join(F.broadcast(hits) if few else hits, "row")
    pairs = pairs.join(F.broadcast(words) if (sizes["bytes"] or 0) <= BROADCAST_BYTES else words, "item")
    judged = pairs.select("row", "item_id", let(tokens("text"), lambda d: _overlap(d, F.col("item_words"), F.col("shift"))).alias("o"))
    out = judged.where("o.agreeing >= o.least").groupBy("row", "item_id").agg(F.max("o.agreeing").alias("agreeing"), F.max("o.total").alias("total"))
    with settings(spark, {} if few else BLOOM):
        return materialize(out, "overlaps")


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: (doc_id, text, ...); benchmark: (item_id, text, ...). Returns verified overlaps (doc_id, item_id, agreeing, total)."""
    rows = _rows(docs)
    found = _overlaps(rows, benchmark)
    return rows.select("row", "doc_id").distinct().join(found, "row").select("doc_id", "item_id", "agreeing", "total")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: (doc_id, contaminated, n_items, first_item, most_tokens)."""
    rows = _rows(docs)
    found = _overlaps(rows, benchmark).groupBy("row").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("total").cast("long").alias("most_tokens"))
    found = materialize(found, "found")
    small = found.count() <= BROADCAST_ROWS
    out = rows.select("row", "doc_id").join(F.broadcast(found) if small else found, "row", "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item", F.coalesce("most_tokens", F.lit(0)).cast("long").alias("most_tokens"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
