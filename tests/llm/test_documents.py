"""Document operators against brute force, on nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import os
import random
import re
import string
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxloom import session
from voxloom.llm import bpe, fmindex, jaccard, kneser_ney, language, quality, records, secrets, substrings, winnow, words

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# near copies


def jaccard_brute(rows):
    return Counter(jaccard_rows(rows))


def jaccard_rows(rows):
    sets = []
    for _, text, _ in rows:
        w = spaced((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    numbered = [i for i, r in enumerate(rows) if r[0] is not None]
    for i in numbered:
        for j in numbered:
            if j < i and sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                    parent[find(i)] = find(j)
    least = {}
    for i in numbered:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(r[0], len(s), least[find(i)] if r[0] is not None and s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_similar(edge_docs, edge_rows, no_docs):
    assert rows_of(jaccard.similar(edge_docs).drop("text_hash")) == jaccard_brute(edge_rows)
    assert jaccard.similar(no_docs).count() == 0


def test_similar_lists_in_cuts(edge_docs, edge_rows, monkeypatch):
    """Lists longer than a cut, common n-grams and full gathers give the same groups."""
    monkeypatch.setattr(jaccard, "CUT", 7)
    monkeypatch.setattr(jaccard, "COMMON", 1000)
    monkeypatch.setattr(jaccard, "GATHER", 500)
    assert rows_of(jaccard.similar(edge_docs).drop("text_hash")) == jaccard_brute(edge_rows)


def test_lists_of_the_same_sets_are_compared_once(spark, edge_docs):
    rng = random.Random(5)
    rows = []
    for family in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        for k in range(6):
            w = list(base)
            for _ in range(6 * (k % 3)):  # some link, some only come close
                w[rng.randrange(160)] = f"w{rng.randrange(10**6)}"
            rows.append((10 * family + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ordered = jaccard.ordered_regions(jaccard.shared_grams(docs, np.zeros(0, dtype=np.int64))).cache()
    tree = jaccard.branches(ordered).cache()
    lists = jaccard._lists(tree, spark.createDataFrame([], "id long, component long")).cache()
    held = {}
    for r in lists.collect():
        held.setdefault(r.gram, set()).add(r.sig)
    every = {}
    for r in tree.collect():
        every.setdefault(r.gram, set()).add(r.sig)
    assert {frozenset(x) for x in held.values()} == {frozenset(x) for x in every.values() if len(x) > 1}
    assert len(held) == len({frozenset(x) for x in held.values()}) < sum(len(x) > 1 for x in every.values())
    sig = {r.doc_id: r.sig for r in jaccard.members(docs).where("sig is not null").collect()}
    sets = {sig[i]: {tuple(t.split()[p : p + 5]) for p in range(156)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    whole = jaccard.whole_sets(docs, spark.createDataFrame(list(sig.items()), "doc_id long, sig long"))
    assert want and {(r.a, r.b) for r in jaccard.cross_links(lists, ordered, whole).collect()} == want


def test_bounds_never_lose_a_pair():
    """Every pair that can link shares at least one n-gram of its region, and the branches reach it."""
    for n in range(1, 3000):
        sizes = np.arange(-(-3 * n // 4), 4 * n // 3 + 1)
        rest = np.maximum(n - min(jaccard.region(n), n), sizes - np.minimum(jaccard.region(sizes), sizes))
        least = int((jaccard.least_overlap(n, sizes) - rest).min())
        assert least >= 1 and jaccard.least_shared(n) == least


def test_overlaps_along_shared_paths():
    rng = np.random.default_rng(3)
    own = np.unique(rng.integers(0, 400, 300))
    others = [np.unique(np.r_[own[: rng.integers(0, own.size)], rng.integers(0, 400, 50)]) for _ in range(60)]
    least = np.full(60, 120)
    want = [len(np.intersect1d(own, o)) for o in others]
    assert jaccard.overlaps(own, others, least).tolist() == [w if w >= 120 else -1 for w in want]


# repeated sequences


def substrings_brute(rows):
    first = {}
    split = [spaced(r[1]) for r in rows]
    for (i, _, _), w in zip(rows, split, strict=True):
        if i is not None:
            for k in range(len(w) - 12):
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _, _), w in zip(rows, split, strict=True):
        gone = set()
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


def test_deduplicated(edge_docs, edge_rows, no_docs):
    got = substrings.deduplicated(edge_docs)
    assert rows_of(got.drop("kept")) == substrings_brute(edge_rows)
    assert all(sha(r.kept) == r.kept_sha256 for r in got.collect())
    assert substrings.deduplicated(no_docs).count() == 0


def test_deduplicated_small_shards(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(substrings, "COMMON", 5)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    monkeypatch.setattr(substrings, "GATHER", 300)
    assert rows_of(substrings.deduplicated(edge_docs).drop("kept")) == substrings_brute(edge_rows)


def test_backward_search():
    rng = random.Random(5)
    seqs = [[rng.randrange(6) for _ in range(rng.randint(1, 12))] for _ in range(50)]
    flat = np.array([x for s in seqs for x in s], dtype=np.uint64)
    owners = np.arange(50) * 3 + 7
    index = fmindex.FMIndex(flat, np.array([len(s) for s in seqs]), owners)
    query = [rng.randrange(7) for _ in range(300)]
    length, lo, hi = index.matching(np.array(query, dtype=np.uint64), np.arange(300), 5)
    holds = lambda part: [k for k, s in enumerate(seqs) if any(s[i : i + len(part)] == part for i in range(len(s)))]
    for end in range(300):
        best = max(n for n in range(6) if n <= end + 1 and (n == 0 or holds(query[end - n + 1 : end + 1])))
        assert length[end] == best
        if best:
            assert index.least_owner(lo[end : end + 1], hi[end : end + 1])[0] == owners[min(holds(query[end - best + 1 : end + 1]))]


# quality


def test_quality_counts(edge_docs, edge_rows, no_docs):
    out = quality.judged(quality.measured(edge_docs))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = Counter()
    for i, text, _ in edge_rows:
        w, seen, dup = spaced(text), set(), 0
        for line in (text or "").split("\n"):
            if spaced(line):
                dup += line in seen
                seen.add(line)
        times = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if times[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)] += 1
    assert got == want
    assert not any(r.kept and r.base_failed for r in out.collect())
    assert quality.judged(quality.measured(no_docs)).count() == 0


def test_perplexity_tells_order_and_language(spark):
    rng = random.Random(3)
    tongue = {"en": ["the", "cat", "sat", "on", "a", "mat"], "de": ["der", "hund", "lief", "zum", "alten", "haus"]}
    rows = [(k, " ".join(tongue[lang] * 4), lang) for k, lang in enumerate(["en", "de"] * 20)]
    salad = tongue["en"] * 4
    rng.shuffle(salad)
    rows += [(100, " ".join(salad), "en"), (101, "  " + rows[0][1].replace(" ", " \n"), "en"), (102, rows[0][1], "de"), (103, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    loss = {r.doc_id: r.log_perplexity for r in quality.measured(docs).collect()}
    assert loss[100] > loss[0] + 0.2  # the same words in another order
    assert loss[102] > loss[0] + 0.2  # the same text under another language
    assert loss[101] == pytest.approx(loss[0], abs=1e-9) and loss[103] is None


def test_quality_keeps_no_step_on_disk(spark, edge_docs, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "documents.parquet"))
    with session.scratch_paths() as used:
        n = quality.op4_quality(spark, str(tmp_path)).count()
    left = [p for p in used if os.path.exists(p.removeprefix("file:"))]
    assert n == edge_docs.count() and [os.path.basename(p).split("-")[0] for p in left] == ["quality"]
    assert spark.conf.get(session.DROP_SHUFFLES) == "false"


def test_blocks_tell_every_ngram_once(spark, monkeypatch):
    """N-grams of many slices of a block, their counts, hashes and characters of one to four bytes."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab é中\U0001f600", k=rng.randint(0, 40))) for _ in range(300)] + ["x", "", None]
    rows = [(t, f"g{k % 3}") for k, t in enumerate(texts)]
    monkeypatch.setattr(kneser_ney, "HASHED", 7)  # in this process
    grams = kneser_ney.Grams.of([t or "" for t in texts], 5)
    monkeypatch.undo()
    assert np.array_equal(grams.hashes, kneser_ney.Grams.of([t or "" for t in texts], 5).hashes)
    want = Counter()
    for t, g in rows:
        if w := " ".join(spaced(t)):
            framed = kneser_ney.BEGIN + w + kneser_ney.END
            want.update((g, framed[max(0, e - 4) : e + 1]) for e in range(1, len(framed)))
    docs = spark.createDataFrame(rows, "text string, grp string").repartition(2)
    blocks = kneser_ney.blocked(docs, "text", "grp", words.SPACED, False, True, 5)
    told = blocks.where("__gram is not null").collect()
    got = Counter()
    for r in told:
        got[r["__own"], r["__gram"]] += r["__c"]
    assert got == want and len({(r["__block"], r["__own"], r["__gram"]) for r in told}) == len(told)
    assert len({r["__key"] for r in told}) == len(want)

    held, owns = kneser_ney.Held(), np.zeros(grams.hashes.size, dtype=np.int64)
    for _ in range(3):
        held.add(grams.hashes, owns, grams, 5)
    keys, _, points, sizes, counts = held.merge()
    assert counts.sum() == 3 * grams.hashes.size and keys.size == np.unique(grams.hashes).size
    assert set(kneser_ney.gram_texts(points, sizes).to_pylist()) == set(grams.texts(np.arange(grams.hashes.size)))


def test_probabilities_sum_to_one(spark, edge_docs):
    rows = edge_docs.selectExpr("'all' as grp", "text")
    levels = kneser_ney.gram_counts(kneser_ney.word_counts(rows, "grp", "text", words.SPACED, False), 3)
    for modified in (False, True):
        model = kneser_ney.probabilities(levels, modified).where("kind = 0 and len = 1").selectExpr("sum(exp(weight)) as s", "count(*) as n").first()
        assert 1 - 1.0 / model.n < model.s < 1  # what is missing is left to characters never seen


def test_score_backs_off_like_the_formula(edge_docs):
    model = kneser_ney.train(edge_docs.selectExpr("'all' as grp", "text"), "grp", "text", words.SPACED, False, 3, True)
    scores, chars = model.score(["alpha", "zzz", ""])
    assert chars.tolist() == [6, 4, 1] and (scores < 0).all() and scores[0, 0] / 6 > scores[1, 0] / 4


def test_model_keeps_every_ngram(spark):
    """More n-grams than the 2^20 slots that models once were folded to: none is lost, and none is found that never was."""
    rng = random.Random(5)
    drawn = rng.sample(range(0x4E00, 0x4E00 + 20_000), 2_000)
    text = "".join(map(chr, rng.choices(drawn, k=1_200_000)))
    taught = [(text[i : i + 12],) for i in range(0, len(text), 12)]
    model = kneser_ney.train(spark.createDataFrame(taught, "text string").selectExpr("'all' as grp", "text"), "grp", "text", words.SPACED, False, 3, False)
    grams = {w[i : i + 3] for (w,) in taught for i in range(len(w) - 2)}
    assert len(grams) > 900_000
    assert model.rows.where("kind = 0 and length(gram) = 3 and ascii(gram) between 19968 and 40000 and ascii(substring(gram, 3)) between 19968 and 40000").count() == len(grams)
    unseen = []
    while len(unseen) < 200:
        w = "".join(map(chr, rng.choices(drawn, k=3)))
        if w not in grams:
            unseen.append(w)
    asked = spark.createDataFrame([("all", g) for g in unseen], "grp string, gram string")
    exact = {(r.kind, r.gram): r.weight for r in model.rows.where("length(gram) <= 2 or kind = 1").join(spark.createDataFrame([(x,) for g in unseen for x in (g[:2], g[1:], g[1], g[2], "")], "gram string").distinct(), "gram").collect()}

    def backed_off(g):
        total = exact.get((1, g[:2]), 0.0)
        if (0, g[1:]) in exact:
            return total + exact[0, g[1:]]
        return total + exact.get((1, g[1]), 0.0) + exact[0, g[2]]

    got = {r.gram: r.weight for r in model.weights(asked).collect()}
    assert got == {g: pytest.approx(backed_off(g), abs=1e-9) for g in unseen}


def test_texts_score_as_their_words(spark, edge_docs):
    """Texts in blocks, through the answers' files, against the words one by one."""
    grouped = edge_docs.selectExpr("coalesce(lang, 'none') as grp", "text")
    model = kneser_ney.train(grouped.where("length(text) < 200"), "grp", "text", words.SPACED, False, 3, True)
    blocks = kneser_ney.blocked(edge_docs.select("doc_id", "text"), "text", None, words.SPACED, False, False, 3)
    root, groups = kneser_ney.answers(blocks, model, own=False), len(model.groups)
    told = sorted({w for r in edge_docs.collect() for w in spaced(r.text)})
    one, _ = model.score(told)
    of = dict(zip(told, one, strict=True))
    scorer = kneser_ney.Scorer(root, groups, words.SPACED, False, False, 3)
    n = 0
    for batch in blocks.where("__gram is null").select("text", "__block").toArrow().to_batches():
        for part, _, scores, chars in scorer(batch, 0, 1):
            for text, score, c in zip(part.column(0).to_pylist(), scores, chars, strict=True):
                w = spaced(text)
                assert c == sum(len(x) + 1 for x in w)
                assert score.tolist() == pytest.approx(sum((of[x] for x in w), np.zeros(groups)).tolist(), abs=1e-6)
                n += 1
    assert n == edge_docs.count()


# languages


def test_language(spark, edge_docs, edge_rows, no_docs):
    training = edge_docs.where("lang is not null")
    out = language.calibrated(language.identify(edge_docs.withColumn("taught", edge_docs["lang"].isNotNull()), training), "taught")
    got = [(r.doc_id, r.text, r.lang_pred, r.score, r.rejected) for r in out.collect()]
    assert len(got) == len(edge_rows) and set(edge_docs.columns) <= set(out.columns)
    for _, text, pred, score, rejected in got:
        lettered = any(c.isalpha() for c in text or "")
        assert (pred in ("en", "de")) == lettered and 0 <= score <= 1
        assert lettered or (pred == "und" and score == 0 and rejected)
    nothing = language.identify(edge_docs, training.limit(0)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(no_docs, training).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.op8_language(spark, "/root/testdata/sf0.01")
    told = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert told.selectExpr("avg(cast(lang = lang_pred as int)) as a").first().a > 0.97
    assert {(r.doc_id, r.held_out) for r in out.collect()} == {(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs.select("doc_id").collect()}


# secrets


def spans_brute(text):
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f for f in sorted(found)]


def test_secrets(edge_docs, edge_rows, no_docs):
    out = secrets.find_secrets(edge_docs)
    want = Counter()
    for i, text, _ in edge_rows:
        s = spans_brute(text or "")
        n = Counter(x[1] for x in s)
        want[i, n[0], n[1], n[2], sha(",".join(x[2] for x in s)), ",".join(x[2] for x in s)] += 1
    assert rows_of(out) == want
    assert secrets.find_secrets(no_docs).count() == 0


def test_ledger_scans_only_what_is_new(spark, edge_docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    scanned = lambda: spark.read.parquet(f"{ledger}/scanned").count()
    first = secrets.scan(edge_docs, ledger, "doc_id", "text").count()
    n = scanned()
    assert n == edge_docs.selectExpr("coalesce(text, '')").distinct().count()
    assert secrets.scan(edge_docs, ledger, "doc_id", "text").count() == first and scanned() == n
    more = edge_docs.limit(5).selectExpr("doc_id", "concat('token: abcdefgh', doc_id) as text").union(edge_docs.select("doc_id", "text"))
    assert secrets.scan(more, ledger, "doc_id", "text").count() > first and scanned() > n
    assert secrets.scan(edge_docs, ledger, "doc_id", "text", version="2").count() == first


def test_masked(spark, edge_docs, edge_rows):
    out = secrets.masked(edge_docs)
    assert out.columns == edge_docs.columns
    assert secrets.find_secrets(out).where("spans <> ''").count() == 0
    clean = Counter((i, t) for i, t, _ in edge_rows if not spans_brute(t or ""))
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert all(got[k] == v for k, v in clean.items()) and sum(got.values()) == len(edge_rows)
    assert next(t for i, t in got if i == 16) == "<assign>\" and <access>, <hex>"


# benchmark


def test_contamination(spark, edge_docs, edge_rows, no_docs):
    base = next(t for i, t, _ in edge_rows if i == 7)
    items = [(1, " ".join(base.split()[5:30])), (2, base.upper()), (30, "one"), (4, None), (5, ""), (None, base), (6, "alpha, beta"), (7, "not there " * 10), (7, "one two THREE four")]
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = {}
    for i, t in items:
        w = token.findall((t or "").translate(LOWER))
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = Counter()
    for i, text, _ in edge_rows:
        w, hit, found = token.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if own := grams.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        want[i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    assert rows_of(winnow.contamination(edge_docs, benchmark)) == want
    assert rows_of(winnow.contamination(edge_docs, benchmark, most=0)) == want
    assert winnow.contamination(no_docs, benchmark).count() == 0
    kept = Counter(map(tuple, winnow.decontaminated(edge_docs, benchmark).collect()))
    assert kept == Counter(map(tuple, winnow.decontaminated(edge_docs, benchmark, most=0).collect()))
    assert sum(kept.values()) == sum(n for row, n in want.items() if not row[-1])
    assert rows_of(winnow.contamination(edge_docs, benchmark.limit(0))) == Counter({(r[0], r[1], 0, 0, sha(""), False): 0 for r in want}) + Counter([(r[0], r[1], 0, 0, sha(""), False) for r in want.elements()])


# tokens


def test_bpe_matches_the_library(edge_docs, edge_rows, no_docs):
    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, text, _ in edge_rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert rows_of(bpe.round_trip(edge_docs, BYTE)) == want
    assert bpe.round_trip(no_docs, BYTE).count() == 0
    back = bpe.decode(bpe.encode(edge_docs, "text", BYTE), "ids", BYTE)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, _ in edge_rows)


def test_bpe_on_odd_strings():
    rng = random.Random(1)
    letters = [*" \t\n\r\x0b\x1c\x85\xa0  　​abcTHE'''sllrevmd019²Ⅷé́ßΣ中😀‍_-.!<|", "<|endoftext|>", "'ll", " '", "the"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(20_000)] + ["a" * 500, " " * 300, "-" * 1000, "ab" * 400, ""]
    ours, tok = bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    got = [x.tolist() for k in range(0, len(texts), 3001) for x in ours.encode_batch(texts[k : k + 3001])]
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_pair_test_agrees_with_merging():
    rng, ours = random.Random(2), bpe.ByteBPE(BYTE)
    pairs = [(rng.randrange(50256), rng.randrange(50256)) for _ in range(5000)] + [(x, x) for x in range(0, 50256, 5)]
    good = ours.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert good.tolist() == [ours.merged(ours.bytes_of[a] + ours.bytes_of[b]) == [a, b] for a, b in pairs]


def test_records(spark, edge_docs, edge_rows, no_docs, tmp_path):
    tok, folder = Tokenizer.from_file(WORD), str(tmp_path)
    manifest = records.write_records(edge_docs, folder, WORD, 2)
    got = [tuple(r) for r in records.read_records(spark, manifest, folder).orderBy("start").collect()]
    start = 0
    ordered = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for row, (i, text, _) in zip(got, ordered, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert row == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    empty = str(tmp_path / "none")
    assert records.read_records(spark, records.write_records(no_docs, empty, WORD, 2), empty).count() == 0


def test_damage_is_found(spark, edge_docs, tmp_path):
    manifest = records.write_records(edge_docs, str(tmp_path), WORD, 2)
    part = manifest.orderBy("part").first()
    path = tmp_path / f"part-{part.part:06d}.records"
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(ValueError, match="damaged record"):
        list(records.read_part(str(tmp_path), part.part, part.width))


def test_checksum():
    data = np.frombuffer(b"123456789" * 700, dtype=np.uint8)
    assert records.crc32c(data, np.array([0]), np.array([9]))[0] == 0xE3069283

    def plain(raw):
        crc = 0xFFFFFFFF
        for b in raw:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    sizes = np.array([0, 1, 3, 4, 63, 64, 65, 1024, 1025, 3000])
    starts = np.arange(sizes.size)
    assert records.crc32c(data, starts, sizes).tolist() == [plain(data[s : s + n].tobytes()) for s, n in zip(starts, sizes, strict=True)]


def test_checksums_of_many_sizes_are_one_job():
    """The calls made do not depend on how many different sizes the stretches have."""
    sizes = np.append(np.arange(4, 300_000, 1500), [64 * 16, 64 * 16 + 1, 64 * 256, 64 * 256 + 1, 64 * 4096, 64 * 4096 + 1])
    data = np.random.default_rng(3).integers(0, 256, 300_000, dtype=np.uint8)
    starts, calls = np.arange(sizes.size) % 7, []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "c_call" else None)
    try:
        got = records.crc32c(data, starts, sizes)
    finally:
        sys.setprofile(None)
    assert len(calls) < 10 * sizes.size

    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0x82F63B78 if x & 1 else 0) for x in table]
    for k in [0, 1, 20, 50, *range(sizes.size - 6, sizes.size)]:
        crc = 0xFFFFFFFF
        for b in data[starts[k] : starts[k] + sizes[k]].tolist():
            crc = crc >> 8 ^ table[(crc ^ b) & 255]
        assert got[k] == crc ^ 0xFFFFFFFF


def test_words_at_slice_edges():
    texts = ["a b  C\n", None, "", "x", "y y", "a" * 100, " a"] * 5
    for most in (1, 7, 1 << 20):
        got = []
        words.SLICE_BYTES, before = most, words.SLICE_BYTES
        try:
            for w in words.words_of(pa.array(texts)):
                raw = w.data.tobytes()
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    got.append([raw[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)])
        finally:
            words.SLICE_BYTES = before
        assert got == [(t or "").split() for t in texts]
