"""Packing: no token lost, rows full, and the same rows as a search through all bins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relmill.llm import bpe, packing, queries

SCHEMA = "doc_id long, text string"


def plain_best_fit(sizes, length):
    room, rows = [], []
    for s in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(room)) if room[r] >= sizes[s]]
        if fits:
            r = min(fits, key=lambda r: room[r])
            rows[r].append(s)
            room[r] -= sizes[s]
        else:
            rows.append([s])
            room.append(length - sizes[s])
    return room


@pytest.mark.parametrize("length", [1, 2, 7, 64, 100])
def test_rooms_match_plain_search(length):
    rnd = random.Random(length)
    for n in (0, 1, 5, 300):
        sizes = [rnd.randint(1, length) for _ in range(n)]
        rows = packing.best_fit(np.array(sizes, np.int64), length)
        assert sorted(s for r in rows for s in r) == list(range(n))
        assert sorted(length - sum(sizes[s] for s in r) for r in rows) == sorted(plain_best_fit(sizes, length))


def docs():
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices("the ation of é 12 don't".split(), k=rnd.randint(0, 120)))) for i in range(60)]
    return rows + [(7, "same id"), (7, "same id"), (None, "no id"), (None, None), (70, ""), (71, "long " * 3000), (2**60 + 1, "x")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(docs(), SCHEMA).withColumns({c: F.lit(1) for c in ("task", "pack", "ids", "members", "_m")})
    of = bpe.codec(bpe.default_path())
    for length, group in ((64, 500), (2048, 4_000_000)):
        folder = str(tmp_path / str(length))
        packing.write_packed(df, folder, length=length, group_tokens=group)
        packed = spark.read.parquet(folder)
        got = sorted((str(r.doc_id), r.ids) for r in packing.unpack(packed).collect())
        assert got == sorted((str(d), of.encode(t).astype("<u2").tobytes()) for d, t in docs() if t)
        seen = set()
        for r in packed.collect():
            assert len(r.ids) == 2 * length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
            assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.members) == len(r.offsets) == len(r.position_resets)
            assert not any(r.ids[2 * r.n_tokens :])
            seen.add((r.task, r.pack))
        assert len(seen) == packed.count()


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf):
    out = queries.QUERIES["op10_packed_ids"](spark, sf)
    of = bpe.codec(bpe.default_path())
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in packing.unpack(out).collect()}
    assert got == {d: of.encode(t).astype("<u2").tobytes() for d, t in texts if t}
