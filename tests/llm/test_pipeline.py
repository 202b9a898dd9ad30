"""The stages of corpus_pipeline against brute force, each on what its predecessor kept."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from chronoweave.llm.common import DOCUMENT_COLUMNS, materialize
from chronoweave.llm.minhash import shingle_set

SF = "/root/testdata/sf0.001"
PLANTED = [
    (5001, "Contact mia.77@mail1.example.com at 10.20.30.40 or pay 4417744280351547 by 2024-02-29 " + " ".join(f"w{i}" for i in range(40)), "en", "p", 0),
    (5002, " ".join(f"same{i}" for i in range(80)), "en", "p", 0),
    (5003, " ".join(f"same{i}" for i in range(80)) + " tail", "en", "p", 0),
    (5004, None, None, None, None),
    (5005, "", "en", "p", 0),
]


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(PLANTED, docs.schema))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, held[-1], SF), name)
        assert name == "packing" or out.columns == DOCUMENT_COLUMNS
        held.append(out)
    rows = [{r.doc_id: r.text for r in df.collect()} for df in held[:-1]]
    gone = rows[0].keys() - rows[1].keys()
    assert gone <= toxic | {d for d, t in rows[0].items() if t and re.search("trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron", t.lower())}
    sets = {d: shingle_set((t or "").encode(), 5) for d, t in rows[1].items()}
    link = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ids = sorted(sets)
    group = {}
    for d in ids:
        group[d] = d
    for d in ids:
        for e in ids:
            if e < d and link(d, e):
                a, b = group[d], group[e]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert rows[2].keys() == {d for d in ids if group[d] == d} and 5003 not in rows[2] and 5002 in rows[2]
    holding = {d for d, t in rows[2].items() if t and any(i in t for i in items)}
    assert holding <= rows[2].keys() - rows[3].keys() and len(rows[2]) - len(rows[3]) <= len(holding) + 2
    assert rows[4].keys() == rows[3].keys() and rows[4][5004] is None and rows[4][5005] == ""
    for d, t in rows[3].items():
        for kind in (r"[\w.]+@mail\d+\.example\.com", r"(?<!\d)\d{16}(?!\d)", r"\+1 \(\d{3}\) 555-\d{4}"):
            for m in re.findall(kind, t or ""):
                assert (m in rows[4][d]) == (len(m) == 16 and m.isdigit() and not luhn(m)), (d, m)
    assert "2024-02-29" not in rows[4][5001] and "10.20.30.40" not in rows[4][5001] and rows[4][5001].endswith("w38 w39")
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = held[-1].collect()
    want = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows[4].items()}
    assert sum(r.length for r in got) == sum(map(len, want.values())) and {r.doc_id for r in got} == want.keys()
    assert all(zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
    assert max(Counter(r.sequence_id for r in got).values()) > 1


def test_run_is_registered(spark):
    from chronoweave.llm import queries

    assert queries.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.queries() if k.startswith("op")}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_near_duplicates_against_sql(spark):
    import duckdb

    from chronoweave.llm import minhash, sql

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(sql.OP3)
    got = minhash.op3_minhash_dedup(spark, SF)
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
