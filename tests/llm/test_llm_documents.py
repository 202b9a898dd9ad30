"""Each operator on the driver's smallest tables and on a hostile fixture, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoweave.llm import chat, decontaminate, licenses, minhash, packing, pii, quality, sharding, tokens, toxicity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
HOSTILE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "One TWO three"), (7, LONG), (8, LONG), (9, LONG + " tail"),
    (10, "a\xa0b c\r\n\r\nd  e <|endoftext|> f<|endoftext|>g 日本語 テスト é İstanbul"), (11, "x" * 5000), (12, "the " * 3000), (12, "the " * 3000),
    (13, "It's we're I'll 12345 ... !!!  trailing "), (14, "\n\nleading"), (15, "😀😀 emoji \x1c\x1d control"), (None, "no id here at all, is there"),
]


@pytest.fixture(scope="module")
def hostile(spark):
    df = spark.createDataFrame([(d, t, "en", "s", 1, "clash", 7) for d, t in HOSTILE], "doc_id long, text string, lang string, source string, n_chars long, rep string, n long")
    return df.withColumn("component", F.lit(1)).withColumn("score", F.lit("x")).withColumn("kept", F.lit("k")).withColumn("seed", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def both(docs, hostile):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], HOSTILE


def test_quality_counts(spark, docs, hostile):
    def brute(t):
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    for df, rows in ((docs, both(docs, None)[0]), (hostile, HOSTILE)):
        got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_counts(df).collect())
        assert got == collections.Counter((d, *brute(t)) for d, t in rows)


def test_quality_rules(spark, docs, hostile, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") + ("$$" if i % 4 == 0 else "") + str(rng.randrange(500)) for _ in range(60))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(600)], "doc_id long, quality int")
    out = quality.quality_verdicts(df, labels).collect()
    right = sum(r.kept == (r.doc_id % 4 != 0) for r in out)
    assert right >= 590, right
    assert quality.quality_verdicts(hostile, labels).count() == len(HOSTILE)
    assert quality.quality_verdicts(empty, labels.limit(0)).count() == 0
    none = quality.quality_verdicts(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_sharding(spark, docs, hostile, empty):
    for df, rows in ((docs, both(docs, None)[0]), (hostile, HOSTILE)):
        got = sharding.shard_documents(df).collect()
        want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
        assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert sharding.shard_documents(empty).count() == 0
    copies = spark.createDataFrame([(i, f"copy {'hot' if i % 3 == 0 else i % 4000}" + " x" * 50) for i in range(20_000)], "doc_id long, text string")
    got = sharding.shard_documents(copies).collect()
    sums, homes = collections.Counter(), collections.defaultdict(set)
    for r in got:
        sums[r.shard] += r["size"]
        homes[r.text_crc32].add(r.shard)
    mean = sum(sums.values()) / 16
    assert max(abs(s - mean) for s in sums.values()) < 0.02 * mean
    assert sorted(len(h) for h in homes.values())[-2] == 1


def components(rows):
    sets = [minhash.shingle_set((t or "").encode(), 5) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    small = {}
    for i, (d, _) in enumerate(rows):
        small.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(small[find(i)])) for i, (d, _) in enumerate(rows)]


def test_near_duplicates(spark, docs, hostile, empty):
    rows = both(docs, None)[0]
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    got = [r for r in minhash.near_duplicates(hostile).collect() if r.doc_id is not None]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components([x for x in HOSTILE if x[0] is not None]))
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_in_blocks(spark):
    """A group larger than a block, with links at and around the threshold."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(components(rows))
    for block in (16, 2048):
        got = minhash.near_duplicates(df, block=block).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_licenses(spark, docs, hostile, empty):
    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))

    extra = [(90, "All rights reserved. CC-BY cc by; the GENERAL public/license"), (91, "Licensed under teh Apache Licence, v2. Relesed under the MIT licens"), (92, "rights reserved all")]
    some = spark.createDataFrame(extra, "doc_id long, text string")
    for df, rows in ((docs, both(docs, None)[0]), (hostile, HOSTILE), (some, extra)):
        got = licenses.scan_licenses(df).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == collections.Counter((d, *brute(t)) for d, t in rows)
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    fuzzy = {r.doc_id: r for r in licenses.scan_licenses(some).collect()}
    assert fuzzy[91].labels == "apache-2.0,mit" and [s.edits for s in fuzzy[91].spans][0] == 3 and fuzzy[91].spans[0].begin_word == 0 and fuzzy[91].spans[0].end_word == 5
    assert fuzzy[92].labels == "" and fuzzy[92].score == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_toxicity(spark, docs, hostile, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.score_toxicity(whole, labels).collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [(got[d].predicted, t) for d, t in truth.items() if got[d].held_out]
    caught = sum(p for p, t in held if t)
    assert caught >= 0.6 * sum(t for _, t in held) and sum(p for p, t in held if not t) <= 0.02 * len(held)
    assert toxicity.score_toxicity(hostile, labels).count() == len(HOSTILE)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert all(r.score == pytest.approx(0.1) for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())


def test_deobfuscation(spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    decode = toxicity.Decoder(toxicity.character_model(whole))
    for seen, meant in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("w0rthl3ss", "worthless"), ("$cum", "scum")):
        assert meant in toxicity.words_of(f"you {seen} there", decode), (seen, toxicity.words_of(f"you {seen} there", decode))


def test_decontamination(spark, docs, hostile, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rows = both(docs, None)[0]
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert len(got) == len(rows)
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    def brute(t):
        w = tok(t)
        for item in items.values():
            q = tok(item)
            size = min(15, len(q))
            for shift in range(1 - len(q), len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(q)]
                if any(sum(same[k : k + size]) >= np.ceil(0.8 * size) for k in range(len(q) - size + 1)):
                    return True
        return False

    rng = random.Random(1)
    picked = [r for r in rows if got[r[0]].contaminated] + rng.sample(rows, 12)
    for d, t in picked:
        assert got[d].contaminated == brute(t[:4000]) or len(t) > 4000, d
    planted = []
    for i, item in items.items():
        w = item.split()
        for k in range(7, len(w), 13):
            w[k] = "changed"
        planted.append((1000 + i, "before it all " + " ".join(w) + " and after"))
    df = spark.createDataFrame([*planted, (1, "clean text " * 30), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r.contaminated for r in decontaminate.contamination(df, bench).collect()}
    assert [d for d, x in out.items() if x != (d >= 1000)] == []
    assert decontaminate.contamination(hostile, bench).count() == len(HOSTILE)
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pii(spark, hostile, empty):
    texts = ["card 4417744280351547 end", "card 4417-7442-8035-1547.", "bad 4417744280351548", "ip 161.17.88.162, and 999.1.1.1 v1.2.3.4.5", "on 2024-02-29 or 2023-02-29", "29.02.2024 1.3.1999", "12/31/2020 31/12/2020 13/13/2020", "call +1 (017) 555-7713!", "mail heble.72@mail3.example.com.", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "nothing 12 34", None, ""]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymize(df).collect()}
    n = len(texts)
    assert all(got[i] == got[i + n] for i in range(n))
    card = re.search(r"\d{16}", got[0])[0]
    assert card != "4417744280351547" and luhn(card) and re.sub(r"\D", "", got[1]) == card and re.fullmatch(r"card \d{4}-\d{4}-\d{4}-\d{4}\.", got[1])
    assert got[2] == texts[2]
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3}, and 999\.1\.1\.1 v1\.2\.3\.4\.5", got[3]) and "161.17.88.162" not in got[3]
    import datetime

    a, b = re.fullmatch(r"on (\S+) or (\S+)", got[4]).groups()
    assert datetime.date.fromisoformat(a) and a != "2024-02-29" and b == "2023-02-29"
    assert re.fullmatch(r"\d\d\.\d\d\.\d{4} \d{1,2}\.\d{1,2}\.\d{4}", got[5]) and datetime.datetime.strptime(got[5].split()[0], "%d.%m.%Y").date() == datetime.date.fromisoformat(a)
    us, eu, no = got[6].split()
    assert datetime.datetime.strptime(us, "%m/%d/%Y") == datetime.datetime.strptime(eu, "%d/%m/%Y") and no == "13/13/2020"
    assert re.fullmatch(r"call \+\d \(\d{3}\) \d{3}-\d{4}!", got[7]) and got[7] != texts[7]
    assert re.fullmatch(r"mail user\.[0-9a-f]{32}@example\.invalid\.", got[8]) and re.fullmatch(r'token = "[0-9a-f]{40}"', got[9]) and got[9] != texts[9]
    assert got[10] == texts[10] and got[11] is None and got[12] == ""
    whole = spark.range(10_000).select(F.format_string("%04d", "id").alias("d"))
    assert whole.select(pii.permuted_digits(F.col("d"), "k", "t").alias("p")).distinct().where("p rlike '^[0-9]{4}$'").count() == 10_000
    days = spark.range(73_170).select(pii.feistel(F.col("id"), F.lit(271), F.lit(270), "k", "date").cast("long").alias("p")).agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(days) == (73_170, 0, 73_169)
    assert pii.pseudonymize(hostile).count() == len(HOSTILE) and pii.pseudonymize(empty).count() == 0
    kept = {(r.doc_id, r.text) for r in pii.pseudonymize(hostile).collect()}
    assert kept == set(HOSTILE)


def test_packing(spark, docs, hostile, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for df, rows in ((docs, both(docs, None)[0]), (hostile, HOSTILE)):
        got = packing.pack_documents(df, path, buffer=20_000).collect()
        ids = collections.defaultdict(list)
        for d, t in rows:
            ids[d].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
        assert sum(r.length for r in got) == sum(len(x) for xs in ids.values() for x in xs)
        for r in got:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            pieces[r.doc_id].append((r.start, r.length))
            seqs[r.sequence_id].append((r.offset, r.length))
        for d, xs in ids.items():
            covered = collections.Counter(p for a, n in pieces[d] for p in range(a, a + n))
            assert covered == collections.Counter(p for x in xs for p in range(len(x)))
        for x in seqs.values():
            x.sort()
            assert [o for o, _ in x] == list(np.cumsum([0, *(n for _, n in x)])[:-1])
            total = sum(n for _, n in x)
            assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack_documents(empty, path).count() == 0


def test_token_counts(spark, docs, hostile, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for df, rows in ((docs, both(docs, None)[0]), (hostile, HOSTILE)):
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df, path).collect())
        n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
        assert got == collections.Counter((d, len((t or "").encode()), k, k > 512) for (d, t), k in zip(rows, n, strict=True))
    assert tokens.token_counts(empty, path).count() == 0


def test_chat(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "human", None, "x"]), f"{c}.{t}") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, rng.choice(["user", "assistant"]), f"99.{t}") for t in range(3000)] + [(98, 0, "user", "same")] * 50 + [(None, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("range", F.lit("clash"))
    got = chat.repair_conversations(df, rows_per_range=300, least_ranges=4).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)

    legal = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
    known = {"user": "user", "assistant": "assistant", "system": "system", "human": "user"}

    def reach(costs):
        """Empty turns at 2 each: shortest ways from state to state, an inserted system turn never."""
        costs = dict(costs)
        for _ in range(3):
            for s, c in list(costs.items()):
                for q in legal[s] - {"system"}:
                    costs[q] = min(costs.get(q, 10**9), c + 2)
        return costs

    def least(roles):
        costs = {None: 0}
        for role in map(known.get, roles):
            after = {}
            label = lambda q, role=role: 0 if q == role else 3 if role else 1
            for s, c in costs.items():
                if s:
                    after[s] = min(after.get(s, 10**9), c + 1 + label(s))
            for s, c in reach(costs).items():
                for q in legal[s]:
                    after[q] = min(after.get(q, 10**9), c + label(q))
            costs = after
        return reach(costs)["assistant"]

    for turns in by.values():
        turns.sort(key=lambda r: r.place)
        assert [r.place for r in turns] == list(range(len(turns)))
        assert sum(r.cost for r in turns) == least([r.input_role for r in turns])
        text = "".join(r.rendered for r in turns)
        roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert roles[0] in ("system", "user") and roles[-1] == "assistant" and text.count("<|im_end|>\n") == len(roles)
        assert all((a, b) in {("system", "user"), ("user", "assistant"), ("assistant", "user")} for a, b in zip(roles, roles[1:], strict=False))
    assert chat.repair_conversations(df.limit(0)).count() == 0
