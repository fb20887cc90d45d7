"""Best-fit packing against a plain search over all open bins."""

import random

import pytest

from cueglass.llm.packing import OVERHEAD, cost, pack, pack_documents, pack_jointly

LENGTHS = (16, 32, 64)
SCHEMA = "doc_id long, text string"


def plain(sizes, lengths, overhead):
    bins, placed, left = [], {}, sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in bins if b["room"] >= sizes[i]]
        if fits:
            least = min(b["room"] for b in fits)
            best = max((b for b in fits if b["room"] == least), key=lambda b: b["touched"])
        else:
            length = min((n for n in lengths if n >= sizes[i]), key=lambda n: ((n + overhead) / min(n, left), n))
            best = {"room": length, "items": [], "used": 0}
            bins.append(best)
        placed[i] = best, best["used"]
        best["room"] -= sizes[i]
        best["used"] += sizes[i]
        best["touched"] = len(placed)
        left -= sizes[i]
    return [(bins.index(placed[i][0]), placed[i][1], min(n for n in lengths if n >= placed[i][0]["used"])) for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(20))
def test_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 64) for _ in range(rng.randrange(0, 90))]
    assert pack(sizes, LENGTHS, 4) == plain(sizes, LENGTHS, 4)


def check(rows, got, lengths):
    """Every byte of every text stands once, and no bin is overfull."""
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    sizes = sorted((str(i), len((t or "").encode())) for i, t in rows)
    assert sorted((str(i), sum(r.n_tokens for r in own)) for i, own in pieces.items() if i not in (None, 5)) == [
        s for s in sizes if s[0] not in ("None", "5")
    ]
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.n_tokens for x in own[:i]) for i in range(len(own))]
        used = sum(r.n_tokens for r in own)
        assert {r.bin_length for r in own} == {min(n for n in lengths if n >= used)}
    return bins


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(0, 90)) for i in range(300) if i != 5]
    rows += [(None, None), (None, "abc"), (5, "abc"), (5, "abc"), (900, ""), (901, "x" * 64), (902, "y" * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", row int").repartition(4)
    got = pack_documents(docs, LENGTHS, 4, group=50).collect()
    bins = check(rows, got, LENGTHS)
    assert sorted(r.n_tokens for r in got if r.doc_id == 5) == [3, 3]
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == [0, 3]
    tokens = sum(r.n_tokens for r in got)
    assert tokens / sum(own[0].bin_length for own in bins.values()) > 0.95
    firsts = sorted((r.first, r.n_tokens) for r in got if r.doc_id == 902)
    assert all(a + n == b for (a, n), (b, _) in zip(firsts, firsts[1:], strict=False))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_smaller_bins_are_opened_when_little_is_left():
    assert pack([30], LENGTHS, OVERHEAD) == [(0, 0, 32)]
    assert [n for _, _, n in pack([10] * 8, LENGTHS, 8)] == [64] * 6 + [16] * 2


def total(bins, overhead, attention):
    return sum(cost(n, overhead, attention) for n in {b: n for b, _, n in bins}.values())


def test_mixed_lengths_beat_the_largest_alone_and_are_found():
    """Pieces that fill 16 or 32 exactly: with costly attention no bin of 64 is opened for them."""
    sizes = [16] * 10 + [32] * 5 + [60]
    mixed, largest = pack_jointly(sizes, LENGTHS, 4, 64), pack(sizes, (64,), 4, 64, LENGTHS)
    assert total(mixed, 4, 64) < total(largest, 4, 64)
    assert {n for _, _, n in mixed} >= {16, 64}
    assert pack_jointly(sizes, LENGTHS, 4, None) == largest  # linear costs: few large bins


@pytest.mark.parametrize("seed", range(10))
def test_no_choice_of_lengths_costs_less(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 64) for _ in range(rng.randrange(1, 60))]
    best = total(pack_jointly(sizes, LENGTHS, 4, 200), 4, 200)
    for opened in [(64,), (32, 64), (16, 64), (16, 32, 64), (32,), (16, 32), (16,)]:
        if max(opened) >= max(sizes):
            bins = pack(sizes, opened, 4, 200, LENGTHS)
            assert best <= total(bins, 4, 200)
    bins = {}
    for size, (own, offset, n) in zip(sizes, pack_jointly(sizes, LENGTHS, 4, 200), strict=True):
        bins.setdefault((own, n), []).append((offset, size))
    for (_, n), pieces in bins.items():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(s for _, s in pieces[:i]) for i in range(len(pieces))]
        assert n == min(x for x in LENGTHS if x >= sum(s for _, s in pieces))


def test_nothing_to_pack():
    assert pack_jointly([]) == []
