"""Filter interactions, whitening and window packing against brute-force versions, with odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave.llm import decontaminate, interactions, linededup, minhash, whitening, windows

# -- filter interactions --------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n string, part string, first string, A string, h1 string, mask string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", "n", "p", "f", "a", "h", "m") for i, t, g in rows], DOCS)


def fails(rows):
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, u, _ in rows if (u or "") == t and j is not None and i is not None and j < i]
        out.append(
            (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t) is not None, bool(same))
        )
    return out


def audit_brute(rows, good, toxic):
    flags, out = fails(rows), {}
    for part in {g or "" for _, _, g in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                at = "ABCDE".index(f)
                gone = [k for k in left if flags[k][at]]
                left = [k for k in left if not flags[k][at]]
                total[f] += len(gone)
                early = sum(flags[k][at] for k in mine) - len(gone)
                only = sum(flags[k][at] and sum(flags[k]) == 1 for k in mine)
                lost = [sum(rows[k][0] in s for k in gone) for s in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(gone), early, only, *lost, f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("runs", [{}, {"long_text": 300, "run_words": 7}])
def test_filter_interactions_equal_brute_force(spark, monkeypatch, runs):
    rng = random.Random(3)
    some = lambda n, v: rng.choice([" ", "\n", "\t "]).join(f"w{rng.randrange(v)}" for _ in range(n))
    texts = [None, "", " \n ", "A", "é É", some(250, 9000), some(250, 90), some(199, 9000), some(200, 9000), "X" * 30 + some(220, 9000), some(230, 9000) + " a&b", " ".join(["a"] * 300), some(205, 9000) + "\x0b\x0c"]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(texts), rng.choice(["en", "de", "xx"])) for i in range(40)]
    rows += [(None, texts[5], "en"), (5, texts[5], "en"), (5, texts[5], "de"), (7, "twice", None), (7, "twice", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    real = interactions.failures
    monkeypatch.setattr(interactions, "failures", lambda d: real(d, **runs))
    df = documents(spark, rows)
    flags = [(x.A, x.B, x.C, x.D, x.E) for x in real(df, **runs).collect()]
    assert Counter(flags) == Counter(fails(rows))
    found = interactions.op11_filter_interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(found) == len(got) and got == audit_brute(rows, good, toxic)


def test_filter_interactions_of_empty_tables_and_long_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.op11_filter_interactions(documents(spark, []), labels).count() == 0
    text = " ".join(f"w{i % 150_000}" for i in range(400_000))
    rows = [(1, text, "en"), (2, text, "en"), (3, text + " #", "de")]
    out = {r.doc_id: tuple(r)[2:] for r in interactions.failures(documents(spark, rows)).collect()}
    assert out[1] == (400_000, 150_000, 0, len(text), False, True, False, False, False)
    assert out[2][-5:] == (False, True, False, False, True) and out[3][:2] == (400_001, 150_001) and out[3][-5:] == (False, True, False, True, False)


def test_an_audit_of_any_filters_and_measures(spark):
    rows = [("p", True, False, 5), ("p", False, False, 2), ("p", True, True, 1), (None, False, True, 9)]
    df = spark.createDataFrame(rows, "part string, f boolean, g boolean, bytes long").fillna("", ["part"])
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.lost, r.shapley) for r in interactions.audit(df, ["f", "g"], lost={"lost": "bytes"}).collect()}
    assert out["p", "fg", 1] == (1, 2, 0, 1, 6, 3) and out["p", "fg", 2] == (1, 0, 1, 0, 0, 1) and out["p", "gf", 1] == (2, 1, 0, 0, 1, 1)
    assert out["", "gf", 2] == (0, 0, 0, 0, 0, 0) and len(out) == 8


# -- whitening ------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, y string, n string, component string"


def whiten_brute(rows):
    """Exact covariance in fractions, numpy for the decomposition only."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in kept]
    fit = sorted({tuple(x) for x in xs})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[float(Fraction(sum((n * x[i] - total[i]) * (n * x[j] - total[j]) for x in fit), n**3)) for j in range(d)] for i in range(d)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, total, strict=True)) for x in xs]
    return kept, xs, fit, n, total, np.array(cov), deviation


def test_whitening_equals_exact_fractions(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1 + k) + (rng.gauss(0, 3) if k % 3 else 0) for k in range(20)]) for i in range(300)]
    rows += [(500 + i, rows[7][1]) for i in range(100)] + [(7, rows[7][1]), (None, rows[9][1])]
    rows += [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [1.0] * 19 + [float("inf")]), (904, [0.5, -0.5]), (905, [])]
    df = spark.createDataFrame([(i, v, "y", "n", "c") for i, v in rows], VECTORS)
    kept, xs, fit, n, total, cov, deviation = whiten_brute(rows)
    found = whitening.op12_whitening(df).collect()
    assert len(found) == 16 * len(kept)
    assert Counter((r.vec_id, r.deviation) for r in found if r.component == 1) == Counter((i, v) for (i, _), v in zip(kept, deviation, strict=True))
    assert {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-10
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    white = {}
    for r in found:
        white.setdefault(r.vec_id, {})[r.component] = r.whitened
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 * r.explained
    mean = np.array([s / n for s in total])
    for (i, _), x in zip(kept, xs, strict=True):
        expected = (np.array(x) - mean) @ vectors / np.sqrt(values)
        assert np.allclose(np.abs([white[i][k + 1] for k in range(16)]), np.abs(expected), rtol=1e-6, atol=1e-8)


def test_whitening_without_variance_or_rows(spark):
    make = lambda rows: spark.createDataFrame([(i, v, "y", "n", "c") for i, v in rows], VECTORS)
    assert whitening.op12_whitening(make([])).count() == 0
    assert whitening.op12_whitening(make([(1, None), (2, [])])).count() == 0
    same = whitening.op12_whitening(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, 0.0, 0.0)] * 4
    flat = whitening.op12_whitening(make([(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 5.0])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in flat) == [(i, k, k > 1) for i in (1, 2) for k in (1, 2, 3)]
    huge = whitening.op12_whitening(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 3) and all(r.identity_error < 1e-4 for r in huge)


@pytest.mark.parametrize("most", [200, 10**7, 2**62])
def test_products_are_exact(most):
    rng = random.Random(most)
    y = np.array([[rng.randrange(-most, most) for _ in range(5)] for _ in range(300)], dtype=np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert whitening.products(y).tolist() == exact
    model = whitening.Whitening(300, [int(c) for c in y.astype(object).sum(axis=0)], np.ones(5), np.eye(5), np.ones(5))
    deviation = whitening.whitened(y, model)[0].tolist()
    assert deviation == [sum((300 * int(c) - t) ** 2 for c, t in zip(row, model.total, strict=True)) for row in y]


# -- window packing -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(windows.default_tokenizer())


def test_chunked_encoding_equals_the_tokenizer(tokenizer):
    rng, encode = random.Random(4), windows.Encoder(windows.default_tokenizer()).encode
    bits = ["a", "Word", "it's", "I'LL", "x", "é", "é", "ß", "Σ", "中文", "12", "3.5", ".", ",", "?!", " ", "  ", "   ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x85", "<|endoftext|>", "#", "(a)", "_", "😀", "‍", "'s", "٣", "²", "Ⅷ"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert list(memoryview(encode(text)).cast("I")) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def packed(spark, tokenizer, rows, capacity):
    """Checks the laws of a packing and gives its sequences' lengths."""
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    out = windows.pack_windows(documents(spark, rows), capacity=capacity).collect()
    times = Counter(i for i, _, _ in rows)
    covered, sequences = Counter(), {}
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == Counter({(i, k): times[i] for i in ids for k in range(len(ids[i]))})
    sizes = []
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity and (end == capacity or end & (end - 1) == 0)
        sizes.append(end)
    return sizes


@pytest.mark.parametrize("capacity", [2048, 64, 100])
def test_windows_hold_every_id_once_without_padding(spark, tokenizer, capacity):
    rng = random.Random(capacity)
    text = lambda n: " ".join(rng.choice(["ab", "the", "zebra", "é", "日本", "x1", "..."]) for _ in range(n))
    rows = [(i, text(rng.randrange(60)), "en") for i in range(120)] + [(200, None, "en"), (201, "", None), (202, text(9000), "en"), (None, "no id", "en")]
    rows += [(300, "same", "en")] * 5
    sizes = packed(spark, tokenizer, rows, capacity)
    assert sum(1 for s in sizes if s < capacity) <= capacity.bit_length()


def test_windows_of_one_length_are_cut(spark, tokenizer):
    sizes = packed(spark, tokenizer, [(i, "a " * 40, "en") for i in range(77)], 64)
    assert sizes.count(64) == sum(sizes) // 64
    assert windows.op13_window_packing(documents(spark, [])).count() == 0


def test_a_very_long_text_in_windows(spark, tokenizer):
    assert sorted(set(packed(spark, tokenizer, [(1, "some words here. " * 80_000, "en"), (2, "x" * 30_000, "en")], 2048)))[-1] == 2048


def test_the_plan_of_windows_uses_each_length_once():
    rng = random.Random(1)
    for _ in range(50):
        capacity = rng.choice([10, 64, 100])
        counts = {k: rng.randrange(1, 50) for k in rng.sample(range(1, capacity + 1), rng.randrange(1, 9))}
        rows, bounds, _ = windows.plan(counts, capacity)
        taken = Counter()
        for length, lo, hi, *_ in sorted(rows, key=lambda r: r[:2]):
            assert lo == taken[length]
            taken[length] = hi
        assert taken == counts
        line = sum((hi - lo) * length for length, lo, hi, *_, place in rows if place is not None)
        assert bounds[-1] == line and bounds[0] % capacity == 0 and all((b - a).bit_count() == 1 for a, b in itertools.pairwise(bounds))


# -- long texts -----------------------------------------------------------------------------------------------------


def beside_generators(df):
    """What stands on the rows that a plan's generators make, besides what they generate."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"\), \[([^\[\]]*)\], (?:true|false), \[[^\[\]]*\]", plan)
    assert len(found) == plan.count("Generate ") > 0
    return [set(re.sub(r"#\d+L?", "", x).split(", ")) for x in found]


def test_nothing_but_keys_stands_beside_the_runs_of_a_text(spark):
    df = documents(spark, [(1, "a b c", "en")])
    assert beside_generators(linededup._lines(df, "doc_id", "text")) == [{"d", "t", "r"}]
    assert beside_generators(decontaminate._runs(df, "doc_id", "text", 100, 10)) == [{"doc_id", "thash"}]
    keys = [F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h")]
    assert beside_generators(minhash._sets(df, keys, F.col("text"), 3, 100, 10)) == [{"doc_id", "h"}]


def test_a_text_of_very_many_lines(spark):
    """A work quadratic in a text's lines would not end here."""
    half = [f"line {i} has some words of its own" for i in range(60_000)]
    once = {r.doc_id: r for r in linededup.op2_line_dedup(documents(spark, [(1, "\n".join(half + half), "en"), (2, "\n".join(half[:9]), "en")])).collect()}
    assert (once[1].n_lines, once[1].n_removed, once[1].text) == (120_000, 60_000, "\n".join(half))
    assert (once[2].n_removed, once[2].text) == (9, "")
