import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagecrest.llm import packing

PATH = P.path("byte_bpe_50k.json")


def plain_best_fit(lengths, capacity):
    """Remaining room of each sequence after best-fit decreasing, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


def laid_out(lengths, capacity):
    runs = packing.plan({n: lengths.count(n) for n in set(lengths)}, capacity)
    used = defaultdict(list)
    for i, (n, first, start, each, offset) in enumerate(runs):
        last = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else lengths.count(n)
        for k in range(last - first):
            used[start + k // each].append((offset + k % each * n, n))
    return used


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 40))
def test_same_as_piece_by_piece(lengths, capacity):
    used = laid_out(lengths, capacity)
    left = []
    for pieces in used.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= capacity
        left.append(capacity - end)
    assert sorted(left) == plain_best_fit(lengths, capacity)
    assert sum(map(len, used.values())) == len(lengths)


def test_large_counts_make_small_plans():
    rng = random.Random(2)
    runs = packing.plan({n: rng.randrange(10**9) for n in range(1, 1025)}, 1024)
    assert len(runs) < 20_000


def test_tightest():
    bins = packing.OpenBins(10)
    for room in (3, 7, 10):
        bins.push(room, 0, 1)
    assert [bins.tightest(n) for n in (1, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    bins.pop(10)
    assert bins.tightest(8) is None and bins.tightest(0) == 3


def checked(docs, capacity=1024):
    lib = Tokenizer.from_file(PATH)
    rows = packing.pack(packing.pieces(docs, PATH, capacity, ids=True), capacity).collect()
    made = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"])):
        assert len(r["ids"]) == r["length"] <= capacity
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == capacity or r["piece"] == 0
        made[r["doc_id"]].append(r)
    for doc in docs.collect():
        want = [*lib.encode(doc["text"] or "", add_special_tokens=False).ids, 2]
        mine = made[doc["doc_id"]]
        starts = [r for r in mine if r["start"] == 0]
        assert any(
            [i for r in sorted(mine, key=lambda r: r["piece"]) if r["piece"] >= 0 for i in r["ids"]][: len(want)] == want for _ in starts
        ) or len(starts) > 1
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in at.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(at) == len(plain_best_fit([r["length"] for r in rows], capacity))


def test_documents(real, messy):
    checked(real.limit(80))
    checked(messy)
    checked(messy, capacity=16)


def test_empty(none):
    assert packing.pack(packing.pieces(none, PATH)).count() == 0


def test_columns_with_the_same_names(spark):
    items = spark.createDataFrame([(k % 30 + 1, "x", k, "y", 0) for k in range(500)], "length long, _salt string, _rank int, offset string, sequence_id int")
    got = packing.pack(items, 40)
    assert got.columns == ["length", "_salt", "_rank", "sequence_id", "offset"]
    used = defaultdict(list)
    for r in got.collect():
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(40 - sum(n for _, n in u) for u in used.values()) == plain_best_fit([k % 30 + 1 for k in range(500)], 40)
