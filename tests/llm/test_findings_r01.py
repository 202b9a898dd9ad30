"""Cases in which the operators once did less than their whole job."""

import itertools
import math
import random
import re

import pytest

import corpus_pipeline
from chronoweave.llm import decontaminate, pii, toxicity


def test_masks_cover_the_rule():
    """However the differing tokens lie in a window that counts, some mask fits between them."""
    for n in range(decontaminate.LEAST, decontaminate.WINDOW + 1):
        for gone in itertools.combinations(range(n), n - math.ceil(0.8 * n)):
            assert any(not {at + m for m in mask} & set(gone) for mask in decontaminate.MASKS for at in range(n - mask[-1])), (n, gone)


def test_decontamination_of_all_patterns(spark):
    """Every pattern of differences in items of 11, 15 and 18 tokens, alone, inside a text and cut off at a text's end."""
    rng = random.Random(4)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (11, 15, 18)}
    rows = []
    for n, item in items.items():
        size = min(n, 15)
        for gone in itertools.combinations(range(size), size - math.ceil(0.8 * size)):
            w = [f"other{k}" if k in gone else x for k, x in enumerate(item[:size])]
            rows.append(" ".join(w if rng.random() < 0.5 else ["before", *w, "after", "it"]))
    rows += [" ".join(items[15][3:]), " ".join(items[15][:12]), " ".join(items[11][2:])]
    clean = [" ".join(items[15][:11]), " ".join(items[11][:8]), "nothing of it"]
    df = spark.createDataFrame([*enumerate(rows), *enumerate(clean, len(rows))], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.contamination(df, bench).collect()}
    assert [d for d, x in got.items() if x != (d < len(rows))] == []


@pytest.fixture(scope="module")
def decode(spark):
    return toxicity.Decoder(toxicity.character_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_disguises_after_punctuation(decode):
    for seen, meant in (("...1d10t", "idiot"), (".m0r0n", "moron"), ("..st*pid", "stupid"), ("_m0r0n", "moron"), ("...i-d-i-o-t", "idiot"), ("...$cum", "scum"), ("(1d10t)", "idiot"), ("(l0wn", "clown"), ("i d-i o.t", "idiot")):
        assert meant in toxicity.words_of(f"you {seen} there", decode), seen


#: How disguises between letters were found before they were sought by their marks.
OLD = re.compile(r"[0-9@$!|+(€£¡]*[^\W\d_]+(?:[0-9@$!|+(€£¡*._\-~^·]+[^\W\d_]+)+[0-9$]*(?![\w@])")


def test_disguises_against_the_old_pattern():
    """Every token that the old pattern finds lies in one that is found now."""
    rng = random.Random(6)
    for _ in range(30_000):
        text = "".join(rng.choice("abé 10@$!|+(*._-~^·,'") for _ in range(rng.randrange(1, 25)))
        now = [m.span() for m in toxicity._MARKED.finditer(text)]
        for m in OLD.finditer(text):
            assert any(a <= m.start() and m.end() <= b for a, b in now), (text, m.group())


def test_long_disguises_and_word_ends(decode):
    cases = [("idi" + "o" * 45 + "t", "idiot"), ("s t u p i d i d i o t", "idiot"), ("you.1d10t", "idiot"), ("stupid-1d10t", "idiot"), ("x1y2." * 30 + "m0r0n", "moron")]
    cases += [(w, m) for w, m in (("worthle$$", "worthless"), ("worthle55", "worthless"), ("1d107", "idiot"), ("idi07", "idiot"), ("m0r0n!", "moron"))]
    for seen, meant in cases:
        assert meant in toxicity.words_of(f"you {seen} there", decode), seen
    score = toxicity.Scorer(decode.table, {"worthless": 4.0, "idiot": 4.0}, -3.0)
    for seen in ("y o u a r e a w o r t h l e s s i d i o t", "such a i d i o t", "y-o-u-i-d-i-o-t", *(w for w, m in cases if m in score.weights)):
        assert score(f"say {seen} there") > 0.7, seen
    assert score("a plain text, version2 of it; see w w w and e.g. x.y!") < 0.1


def test_shrunk_repeats_decode_alike(decode):
    """Beyond three, equal letters change no reading."""
    for n in range(3, 12):
        assert decode("stu" + "p" * n + "id") == decode("stupppid") and decode("idi" + "o" * n + "7") == decode("idiooo7")


CARD = "4417744280351547"


def test_cards_in_runs(spark):
    """A valid card is found beside other digits and after punctuation; its pseudonym is that of the card alone."""
    grouped = "4417 7442 8035 1547"
    texts = [CARD, f"{grouped} 12/26", f"{CARD} 123", f"order 12 {CARD}", f"x,{CARD}", f"12,{CARD},9", f"x.{CARD}", f"x-{CARD}", f"{grouped} {grouped}", f"{CARD} 10.20.30.40", f"{CARD} 12/26/2024", f"{CARD} 555-123-4567", f"{CARD} a7@b.org", f"12345 2024-02-29 {CARD}"]
    same = [f"0.{CARD}", f"{CARD}12345", "4417744280351548 99", "1 2 3", "1234567890123456 12"]
    got = [r.text for r in spark.createDataFrame([*enumerate(texts + same)], "n int, text string").transform(pii.pseudonymize).orderBy("n").collect()]
    new = got[0]
    assert new != CARD and len(new) == 16
    for t, g in zip(texts, got, strict=False):
        digits = re.sub("[ -]", "", g)
        assert new in digits and CARD not in digits, (t, g)
    assert got[8].replace(" ", "") == new * 2 and got[1].endswith(" 12/26") and got[3].startswith("order 12 ") and got[5] == f"12,{new},9"
    assert all(x not in "".join(got) for x in ("10.20.30.40", "12/26/2024", "555-123-4567", "a7@b.org", "2024-02-29"))
    assert got[len(texts) :] == same


def test_pipeline_judges_rows(spark, tmp_path):
    """Rows without a doc_id, and rows that share one, are judged by their own text; of copies one row stays."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    toxic, leak = "you stupid worthless idiot, pathetic moron, disgusting trash scum", f"see here {item} as asked"
    plain, other, third = (" ".join(f"{p}{i}" for i in range(60)) for p in ("plain", "other", "third"))

    def kept(stage, rows):
        planted = spark.createDataFrame([(d, t, "en", "planted", 1) for d, t in rows], docs.schema)
        for df in (docs.unionByName(planted), None):
            if df is None:  # the same as a table of files
                docs.unionByName(planted).write.mode("overwrite").parquet(str(tmp_path / "in"))
                df = spark.read.parquet(str(tmp_path / "in"))
            yield sorted((r.doc_id or 0, r.text) for r in stage(spark, df, sf).where("source = 'planted'").collect())

    for got in kept(corpus_pipeline.drop_toxic, [(None, toxic), (None, plain), (90001, toxic), (90001, other)]):
        assert got == [(0, plain), (90001, other)]
    for got in kept(corpus_pipeline.decontaminate, [(None, leak), (None, plain), (90001, leak), (90001, other)]):
        assert got == [(0, plain), (90001, other)]
    for got in kept(corpus_pipeline.near_dedup, [(90009, plain), (90001, plain), (90001, plain), (None, plain), (90001, other), (None, third), (None, third)]):
        assert got == [(0, third), (90001, other), (90001, plain)]
