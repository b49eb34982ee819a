"""Repeated byte strings against brute force; merging of front-coded runs."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import losertree, suffixes
from tests.llm.conftest import make_docs


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0)).tolist()
        spans = tuple(zip(edges[::2], edges[1::2], strict=True))
        out.append((doc, len(t), spans, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return Counter(out)


def got(docs, length, gram):
    rows = suffixes.without_repeats(docs, length, gram).collect()
    return Counter((r["doc_id"], r["n_bytes"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in rows)


@pytest.mark.parametrize(("length", "gram"), [(400, 48), (40, 8), (9, 9), (1, 4)])
def test_edge_rows(edge_docs, edge_rows, length, gram):
    assert got(edge_docs, length, gram) == brute(edge_rows, length)


def patchwork(rng, n):
    """Texts of shared passages of all lengths, cut anywhere, with changed bytes and runs of one character."""
    passages = ["".join(rng.choices("abcdé \n", k=rng.randint(5, 90))) for _ in range(12)] + ["=" * 70, "ab" * 40]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text += p[a : a + rng.randint(1, len(p))] if rng.random() < 0.5 else p
            if rng.random() < 0.3:
                text += "".join(rng.choices("xyz", k=rng.randint(1, 20)))
        rows.append((i, text, "en"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_patchwork_in_several_blocks(spark, monkeypatch, seed):
    rows = patchwork(random.Random(seed), 150)
    docs = make_docs(spark, rows).repartition(7)
    assert got(docs, 30, 6) == brute(rows, 30)


def test_hot_grams_give_the_same(spark, monkeypatch):
    """With every repeated gram cut up into its strings, and with some of them."""
    rows = patchwork(random.Random(5), 120)
    docs = make_docs(spark, rows).repartition(5)
    for hot in (0, 6):
        monkeypatch.setattr(suffixes, "HOT", hot)
        assert got(docs, 30, 6) == brute(rows, 30)


def test_many_shards_and_steps(spark, monkeypatch):
    rows = patchwork(random.Random(6), 120)
    monkeypatch.setattr(suffixes, "SHARD", 5)
    monkeypatch.setattr(suffixes, "MOST_TASKS", 3)
    assert got(make_docs(spark, rows).repartition(4), 30, 6) == brute(rows, 30)


@pytest.mark.parametrize("step", [64, 1000])
def test_anchors_do_not_depend_on_steps(monkeypatch, step):
    rng = random.Random(9)
    data = np.array(rng.choices(range(97, 101), k=3000), dtype=np.uint8)
    offsets = np.array([0, 10, 10, 1200, 1210, 3000])
    known = {}
    for size in (1 << 19, step):
        monkeypatch.setattr(suffixes, "STEP", size)
        s = suffixes.anchored(data, offsets, 20, 5)
        starts = suffixes._many(s["first"], s["n"])
        known[size] = dict(zip(starts.tolist(), zip(np.repeat(s["anchor"], s["n"]).tolist(), np.repeat(s["name"], s["n"]).tolist(), strict=True), strict=True))
    assert known[1 << 19] == known[step]
    assert sorted(known[step]) == [i for a, b in zip(offsets, offsets[1:], strict=False) for i in range(a, b - 19)]


def test_long_text_of_one_character(spark):
    rows = [(1, "z" * 200_000, "en"), (2, "z" * 399, "en"), (3, "y" * 400, "en"), (4, "z" * 400, "en")]
    found = {k[0]: (k[1], k[2]) for k in got(make_docs(spark, rows), 400, 48)}
    assert found == {1: (200_000, ((0, 200_000),)), 2: (399, ()), 3: (400, ()), 4: (400, ((0, 400),))}


def test_empty_table(no_docs):
    assert suffixes.without_repeats(no_docs).count() == 0


def test_query_has_the_digests_of_its_spans(spark, tmp_path, edge_docs, edge_rows):
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = suffixes.op12_suffixes(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = Counter((d, n, n - len(kept), len(spans)) for (d, n, spans, kept), c in brute(edge_rows, 400).items() for _ in range(c))
    assert Counter(tuple(r)[:4] for r in out.collect()) == want


texts = st.lists(st.lists(st.sampled_from([b"", b"a", b"ab", b"aab", b"abab" * 9, b"b" * 40, b"b" * 41, b"ba"]) | st.binary(max_size=5), max_size=12), max_size=9)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_merge_orders_and_counts_shared_bytes(runs):
    runs = [sorted(r) for r in runs]
    coded = [losertree.front_decode(*losertree.front_code(r)) for r in runs]
    place = [0] * len(runs)
    merged, shares = [], []
    for run, share in losertree.merge(coded):
        merged.append(runs[run][place[run]])
        place[run] += 1
        shares.append(share)
    assert merged == sorted(s for r in runs for s in r)
    for a, b, share in zip([b"", *merged], merged, shares, strict=False):
        assert share == losertree.shared_prefix(a, b)


def test_known_prefixes_are_not_compared_again(monkeypatch):
    """Bytes looked at while merging: each string's own part at most, and never its known prefix."""
    looked = []

    def counted(a, b, known=0, inner=losertree.shared_prefix):
        k = inner(a, b, known)
        looked.append(k - known + 1)
        return k

    prefix = b"p" * 5000
    runs = [sorted(prefix + bytes([65 + (i * j) % 26]) * 20 + b"%d" % i for i in range(50)) for j in range(1, 8)]
    coded = [list(losertree.front_decode(*losertree.front_code(r))) for r in runs]
    monkeypatch.setattr(losertree, "shared_prefix", counted)
    assert sum(1 for _ in losertree.merge([iter(c) for c in coded])) == 350
    assert sum(looked) < 7 * 5100 + 350 * 3 * 40  # seven full looks when the tree is built
