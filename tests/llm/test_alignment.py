"""Alignment of two tokenizers against whole texts encoded at once."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.conftest import make_docs
from voxloom.llm import alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PIECE)
    values = alignment.byte_values()
    spell_a = {i: bytes(values[c] for c in t) for t, i in a.get_vocab().items() if all(c in values for c in t)}
    spell_b = {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        spell_b[i] = bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    return a, b, spell_a, spell_b


def groups(both, text):
    """Groups of a text from the bytes of its tokens alone."""
    a, b, spell_a, spell_b = both
    if not text:
        return []
    whole = (" " + text).encode()
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    ends = []
    for own, spell in zip(ids, (spell_a, spell_b), strict=True):
        parts = [spell[i] for i in own]
        if b"".join(parts) != whole:
            return []
        ends.append(np.cumsum([len(p) for p in parts]).tolist())
    cuts = sorted(set(ends[0]) & set(ends[1]))
    return [tuple([i for i, e in zip(own, end, strict=True) if lo < e <= hi] for own, end in zip(ids, ends, strict=True)) for lo, hi in zip([0, *cuts], cuts, strict=False)]


def brute(both, rows):
    found = [groups(both, r[1]) for r in rows]
    counts = Counter(pair for g in found for pair in {(p, q) for x, y in g for p in x for q in y})
    most = {}
    for (p, _), n in counts.items():
        most[p] = max(n, most.get(p, 0))
    out = []
    for r, g in zip(rows, found, strict=True):
        links = [(p, q) for x, y in g for p in x for q in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        digest = hashlib.sha256(said.encode()).hexdigest() if g else ""
        best = sum(counts[link] == most[link[0]] for link in links)
        out.append((r[0], sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), best, sum(counts[link] for link in links), digest))
    return Counter(out), counts, most


ODD = [
    "hello  world", " lead", "tail ", "\n", " \n a", "a\nb", "a\n\nb", "a \nb", "a\n b", "é à ê", "中文 字 符", "😀 x😀", "a b c", "x　y z", "▁x", "a ▁ b", "ﬁ Ａ １",
    "<s> <unk> </s> <|endoftext|> x", "<0x41> b", "\x00 a\x00b", "it's we'll 've 's", "a\x1cb \x1d c", "﻿x y", "é ü", "12345 6 789", " a   b", "\x85 x\x85y", "ẞß ǆ", "a\tb \tc", "𝔘𝔫𝔦 \U0010ffff z",
    "א ב ג‏", "नमस्ते दुनिया", "x​y z", "   ", "a   b    c", "'s", " 's a 's", "\r\n a\r\nb", "a\n'sb \n's",
]


def test_edge_rows_and_odd_texts(spark, both, edge_rows, monkeypatch):
    rng = random.Random(4)
    mixed = [" ".join(rng.choices(ODD, k=5)) for _ in range(60)] + ["\n".join(rng.choices(ODD, k=4)) for _ in range(40)]
    rows = edge_rows + [(5000 + i, t, "en") for i, t in enumerate(ODD + mixed)]
    docs = make_docs(spark, rows).repartition(4)
    want, counts, most = brute(both, rows)
    documents, links = alignment.aligned(docs, BYTE, PIECE)
    assert documents.columns == COLUMNS
    assert Counter(map(tuple, documents.collect())) == want
    assert {(r["a"], r["b"]): (r["documents"], r["best"]) for r in links.collect()} == {(p, q): (n, n == most[p]) for (p, q), n in counts.items()}


def test_small_blocks_and_forgetting(spark, both, edge_rows, monkeypatch):
    for name, value in (("BLOCK", 500), ("KNOWN", 3), ("AT_ONCE", 40), ("MOST_TASKS", 2)):
        monkeypatch.setattr(alignment, name, value)
    docs = make_docs(spark, edge_rows).repartition(2)
    assert Counter(map(tuple, alignment.aligned(docs, BYTE, PIECE)[0].collect())) == brute(both, edge_rows)[0]


def test_every_character_beside_cuts(both):
    """Units between cuts have the tokens of the whole text, whatever stands beside a cut."""
    known = alignment._aligner(BYTE, PIECE)
    for c in [chr(i) for i in range(0x0, 0x3100, 7) if not 0xD800 <= i < 0xE000] + [chr(i) for i in (0x20, 0xA0, 0x85, 0x1680, 0x2000, 0x202F, 0x205F, 0x3000, 0x2581)]:
        text = f"a {c} b{c} {c}c\n{c}d {c}{c}"
        (found,) = known.units([text])
        said = ";".join(known.groups[u] for u in found) if all(known.sizes["sound"][u] for u in found) else ""
        assert said == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups(both, text)), repr(c)


def test_empty_table(no_docs):
    documents, links = alignment.aligned(no_docs, BYTE, PIECE)
    assert documents.count() == 0 and links.count() == 0


def test_query(spark, sf, both):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, alignment.op11_align(spark, sf).collect())) == brute(both, rows)[0]
