"""The manifest against a plain tree, on nulls, repeated rows, odd sizes, several stages and an empty table."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import merkle

LOWER = str.maketrans(merkle._UPPER, merkle._LOWER)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold_up(nodes):
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0]


def ways(nodes):
    """Siblings left and right of every leaf, level by level."""
    found = [[] for _ in nodes]
    level = 0
    while len(nodes) > 1:
        for i, way in enumerate(found):
            j = i // 16**level
            run = nodes[j // 16 * 16 : j // 16 * 16 + 16]
            way.append((run[: j % 16], run[j % 16 + 1 :]))
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        level += 1
    return found


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    trees = defaultdict(list)
    for doc, source, lang, n, text in rows:
        head = "".join(map(framed, (doc, source, lang, n)))
        bent = text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        leaf = h(head + framed(text))
        trees[source].append((doc is not None, doc or 0, leaf, h(head + framed(text.translate(LOWER))) if bent else leaf, doc))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots = []
    for s in names:
        trees[s].sort(key=lambda r: r[:4])
        subroots.append(fold_up([r[2] for r in trees[s]]))
    root = fold_up(subroots)
    above = ways(subroots)
    out = []
    for s, subroot, up in zip(names, subroots, above, strict=True):
        for (_, _, leaf, changed, doc), way in zip(trees[s], ways([r[2] for r in trees[s]]), strict=True):
            way = way + up
            now = changed
            for left, right in way:
                now = h("".join(left) + now + "".join(right))
            proof = h("".join("".join(left + right) for left, right in way))
            out.append((doc, leaf, subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, position long, leaf string, root string"


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def cases():
    rng = random.Random(3)
    rows = [
        (None, None, None, None, None), (None, "a", "en", 1, "X"), (-5, "a", None, 0, ""), (7, "a", "de", 3, "Été"), (7, "a", "de", 3, "Été"),
        (7, "a", "de", 3, "other"), (8, "", "en", 2, "Ab"), (9, "é", "en", 9, "A" * 50_000), (10, "-", "en", None, "5:x"), (11, None, "en", 1, None),
    ]
    rows += [(100 + i, f"s{i % 19}", "en", i, f"Text {i}") for i in range(40)]
    rows += [(1000 + i, "hot", "en", i, rng.choice(["Alpha", "beta", "GAMMA"]) * 3) for i in range(273)]
    return rows


def test_all_columns_against_a_plain_tree(spark, tmp_path):
    rows = cases()
    got = merkle.op13_merkle(spark, written(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [1, 16, 17])
def test_one_tree(spark, tmp_path, n):
    rows = [(i, "only", "en", 1, f"T{i}") for i in range(n)]
    assert sorted(map(tuple, merkle.op13_merkle(spark, written(spark, tmp_path, rows)).collect()), key=repr) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert merkle.op13_merkle(spark, written(spark, tmp_path, [])).count() == 0


def test_tree_of_several_stages(spark):
    """A tree of more leaves than a builder takes, one of which has a builder with a single leaf."""
    n = merkle.SPAN * 17 + 1
    leaf = F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(n).select(F.lit("s").alias("tree"), F.col("id").alias("key"), leaf.alias("leaf"), leaf.alias("other"))
    found = merkle.manifest(rows)
    leaves = [h(str(i)) for i in range(n)]
    assert found.root == fold_up(leaves)
    proofs = found.proofs().where(f"key % 977 = 0 or key = {n - 1}")
    checked = proofs.select("key", merkle.folded(F.col("path"), F.col("leaf")).alias("root"), F.size("path").alias("steps")).collect()
    assert {r["root"] for r in checked} == {found.root} and {r["steps"] for r in checked} == {merkle.height(n)}
    assert len(checked) == len({*range(0, n, 977), n - 1})


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 4095, 4096])
def test_places_are_those_of_the_log(n):
    leaves = [str(i) for i in range(n)]
    for levels in {merkle.height(n), 3}:
        log, at = merkle.append_log(leaves, levels), {}
        level, nodes = 0, leaves
        while True:
            for i, place in enumerate(merkle.place(n, levels, level, np.arange(len(nodes))).tolist()):
                assert log[place] == nodes[i]
                at[place] = (level, i)
            if level == levels:
                break
            nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            level += 1
        assert sorted(at) == list(range(len(log)))
