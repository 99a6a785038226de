"""Every operator against a brute-force version, with the odd rows that tables hold."""

import array
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.llm import audio, decontaminate, langid, linededup, minhash, packing, quality, secrets, sharding, toxicity
from logweave.llm.labelled import chosen, sample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n string, shard string, key string"


def docs(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [
        (i, t, (langs or itertools.repeat("en")).__getitem__(k) if langs else "en", sources[k] if sources else "s", None if t is None else len(t), "x", "y", "z", "k")
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rng():
    return random.Random(5)


# -- decontamination ------------------------------------------------------------------------------------------------

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def op1_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return SPLIT.findall(low)


def op1_brute(texts, items):
    out = []
    for t in texts:
        w, hit, found = op1_words(t), set(), set()
        for item_id, text in items:
            x = op1_words(text)
            size = min(13, len(x))
            for j in range(len(x) - size + 1 if x else 0):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == x[j : j + size]:
                        hit.update(range(i, i + size))
                        found.add("null" if item_id is None else str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("how", [{}, {"broadcast_rows": 0}, {"long_text": 100, "run_words": 16}, {"broadcast_rows": 0, "long_text": 100, "run_words": 16}])
def test_decontamination_equals_brute_force(spark, rng, how, monkeypatch):
    passage, other = words(rng, 40), words(rng, 13)
    items = [(7, passage), (8, passage.upper()), (10, other), (9, "Short One"), (None, words(rng, 20)), (11, ""), (12, None), (13, "É Ç one two"), (10, other)]
    texts = [
        None, "", "...!?", passage, f"{words(rng, 30)} {passage[30:180]} {words(rng, 30)}", f"x {other}, y {other.title()}", "a short ONE, b", "short", words(rng, 600),
        f"{passage} {passage}", "é ç one two", "É Ç One two " * 3, " ".join(passage.split()[:12]), f"{words(rng, 300)} {' '.join(passage.split()[5:18])}",
        "." * 300, f"{'...' * 90} {passage} {'?' * 90}", "x" * 500, " ".join([passage] * 5),
    ]
    items += [(14, words(rng, 100)), (15, " ".join([words(rng, 16), passage[:100]]))]
    texts += [items[-2][1][70:], items[-1][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    real = decontaminate.decontaminate
    monkeypatch.setattr(decontaminate, "decontaminate", lambda d, b, **kw: real(d, b, **how, **kw))
    rows = {r.doc_id: tuple(r)[1:] for r in decontaminate.op1_decontaminate(docs(spark, texts), bench).collect()}
    assert [rows[i] for i in range(len(texts))] == op1_brute(texts, items)


def test_decontamination_of_repeated_rows_and_empty_tables(spark, rng):
    passage = words(rng, 20)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    twice = docs(spark, [passage, passage, "clean", None], ids=[5, 5, None, 6])
    rows = sorted((r.doc_id or -1, r.contaminated) for r in decontaminate.op1_decontaminate(twice, bench).collect())
    assert rows == [(-1, False), (5, True), (5, True), (6, False)]
    assert decontaminate.op1_decontaminate(twice.limit(0), bench).count() == 0
    assert decontaminate.op1_decontaminate(twice, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_of_many_words_in_one_run(spark, rng):
    """Memory follows a run's words: not their square, and not the items that each of them meets."""
    passage = words(rng, 20)
    letters = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(65_000))
    template = " ".join([passage] * 750)
    assert max(len(letters) + 1 + len(passage), len(template)) <= decontaminate.LONG_TEXT
    bench = spark.createDataFrame([(i, f"{passage} {words(rng, 20)}") for i in range(100)], "item_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.op1_decontaminate(docs(spark, [f"{letters} {passage}", template]), bench).collect()}
    assert out == {0: (65_020, 20, 100), 1: (15_000, 15_000, 100)}


# -- line dedup -----------------------------------------------------------------------------------------------------


def dedup_brute(texts, least):
    """Maximal repeated runs by comparing every pair of places."""
    lines = []
    for d, t in enumerate(texts):
        lines.append([(i, x.strip(" \t\r\f\x0b")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\f\x0b")])
    gone = defaultdict(set)
    places = [(d, i) for d, ls in enumerate(lines) for i in range(len(ls))]
    for (d, i), (e, j) in itertools.combinations(places, 2):
        if i and j and lines[d][i - 1][1] == lines[e][j - 1][1]:
            continue
        n = 0
        while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n][1] == lines[e][j + n][1]:
            n += 1
        if n and sum(len(x.split()) for _, x in lines[e][j : j + n]) >= least:
            gone[e].update(lines[e][k][0] for k in range(j, j + n))
    return [t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in enumerate(texts)]


def test_line_dedup_equals_brute_force(spark, rng):
    block = [words(rng, rng.randrange(3, 30)) for _ in range(7)]
    header = "one short header line"
    texts = [
        None, "", "\n \n", "\n".join([header, *block]), "\n".join([header, words(rng, 60), *block, "tail"]), "\n".join([*block[2:5], header]),
        "\n".join([header, words(rng, 9)]), "\n".join(["a b c d e f g"] * 20), "\n".join([words(rng, 8), "", *block[:3], "", *block[3:], words(rng, 4)]), "  " + block[0] + "\r\n" + "\n".join(block[1:]),
    ]
    out = {r.doc_id: r for r in linededup.line_dedup(docs(spark, texts), min_words=40).collect()}
    want = dedup_brute(texts, 40)
    assert [out[i].text for i in range(len(texts))] == want
    assert out[4].n_removed > 0 and out[3].n_removed == 0 and out[3].h == "x"


def test_line_dedup_keeps_the_first_of_repeated_rows(spark, rng):
    text = "\n".join(words(rng, 30) for _ in range(3))
    rows = linededup.line_dedup(docs(spark, [text, text, text, "short", None, None], ids=[4, 4, 9, 1, None, None])).collect()
    assert sorted(r.text for r in rows if r.doc_id == 4) == ["", text]
    assert [r.text for r in rows if r.doc_id == 9] == [""] and sum(r.text is None for r in rows) == 2
    assert linededup.line_dedup(docs(spark, [text]).limit(0)).count() == 0


def test_line_dedup_doubles_only_adjacent_lines(spark):
    x, y, z, w, q = (" ".join(f"{n}{j}" for j in range(13)) for n in "xyzwq")
    u, v = (" ".join(f"{n}{j}" for j in range(13)) for n in "uv")
    texts = ["\n".join(t) for t in ([x, y, u, z, w, q], [x, y, v, z, w, q], [u], [v])]
    out = {r.doc_id: r for r in linededup.line_dedup(docs(spark, texts), min_words=50).collect()}
    assert [out[i].text for i in range(4)] == texts and all(r.n_removed == 0 for r in out.values())


def test_line_dedup_of_templated_texts_equals_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(f"l{n}w{j}" for j in range(rng.randrange(3, 9))) for n in range(14)]
    template = [rng.choice(pool) for _ in range(12)]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.2 else line for line in template) for _ in range(40)]
    out = {r.doc_id: r.text for r in linededup.line_dedup(docs(spark, texts), min_words=25).collect()}
    assert [out[i] for i in range(len(texts))] == dedup_brute(texts, 25)


def test_line_dedup_keeps_columns_of_its_own_names(spark, rng):
    text = "\n".join(words(rng, 30) for _ in range(3))
    frame = spark.createDataFrame([(1, text, 7, "a", 5), (2, text, 8, "b", 6)], "_d long, t string, _n int, _row string, n_lines int")
    rows = linededup.line_dedup(frame, doc_id="_d", text="t").collect()
    assert [(r._d, r._n, r._row, r.n_lines, r.n_removed) for r in sorted(rows)] == [(1, 7, "a", 3, 0), (2, 8, "b", 3, 3)]


def test_suffix_ranks_are_sorted_and_intervals_share_a_prefix(spark):
    rng = random.Random(4)
    pool = [" ".join(f"l{n}w{j}" for j in range(4)) for n in range(6)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(2, 14))) for _ in range(30)]
    lines = linededup.written(linededup._lines(docs(spark, texts), "doc_id", "text"), "test-lines")
    positions = linededup._positions(lines)
    ids = {r.pos: (r.h1, r.h2) for r in positions.collect()}
    rounds = [{r.pos: r.rank for r in level.collect()} for level in linededup.suffix_ranks(positions, 8)]
    assert len(rounds) == 4
    for k, ranks in enumerate(rounds):
        prefix = {p: tuple(ids.get(p + j) for j in range(1 << k)) for p in ids}
        count = Counter(x for x in prefix.values() if None not in x)
        assert set(ranks) == {p for p, x in prefix.items() if count[x] > 1}
        by_rank = sorted(ranks, key=lambda p: (ranks[p], p))
        assert by_rank == sorted(ranks, key=lambda p: (prefix[p], p))


# -- sharding -------------------------------------------------------------------------------------------------------


def test_best_fit_decreasing_is_that_item_by_item():
    rng = random.Random(3)
    classes = Counter(rng.randrange(1, 400) for _ in range(3000))
    plan = sharding.best_fit_decreasing(list(classes.items()), 7)
    share = -(-sum(s * n for s, n in classes.items()) // 7)
    room, took = [share] * 7, Counter()
    for size in sorted(classes.elements(), reverse=True):
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        r, b = min(fits) if fits else max((r, b) for b, r in enumerate(room))
        room[b] -= size
        took[b, size] += 1
    got = Counter()
    for size, lo, hi, b in plan:
        got[b, size] += hi - lo
    assert got == took


def test_sharding_law(spark, rng):
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(700)] + ["copy of one text " * 4] * 400 + [None, "", "é"]
    rows = sharding.op3_shard(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        by[r.shard].append(r)
    sizes = [sum(x.size for x in v) for v in by.values()]
    assert set(by) == set(range(40)) and max(sizes) - min(sizes) < 400
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for t, v in where.items() if t and not t.startswith("copy"))
    assert sharding.op3_shard(docs(spark, texts).limit(0)).count() == 0


def test_sharding_of_repeated_rows_and_a_large_text(spark):
    rows = sharding.op3_shard(docs(spark, ["a", "a", "b" * 9000, "c"], ids=[1, 1, None, 2])).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 4 and all(sorted(v) == list(range(len(v))) for v in by.values())


# -- near duplicates --------------------------------------------------------------------------------------------------


def near_brute(texts, size, similarity):
    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        if rng.random() < 0.5:
            del w[k]
        else:
            w[k] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark, rng):
    base, passage = words(rng, 150, 5000), words(rng, 60, 5000)
    texts = [None, "", " \t", "one", "One", "two words", "TWO words", base]
    texts += [edited(rng, base, k) for k in (1, 2, 3, 4, 5, 6, 8, 12) for _ in range(12)]
    chain = words(rng, 120, 5000)
    for _ in range(10):
        texts.append(chain)
        chain = edited(rng, chain, 2)
    texts += [f"{words(rng, 40, 5000)} {passage}" for _ in range(15)] + [base] * 3
    sizes, comps = near_brute(texts, 3, 85)
    rows = {r.doc_id: r for r in minhash.op4_near_duplicates(docs(spark, texts)).collect()}
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert [rows[i].component_id for i in range(len(texts))] == comps
    assert all(rows[i].kept == (rows[i].component_id == i) for i in rows)
    # the same in runs of words, for texts that count as long
    parts = minhash.near_duplicates(docs(spark, [*texts, " " * 900]), words=3, similarity=85, long_text=700, run_words=32).collect()
    parts = {r.doc_id: r for r in parts}
    assert [(parts[i].n_shingles, parts[i].component_id) for i in range(len(texts))] == list(zip(sizes, comps, strict=True))
    assert all(parts[i].kept == (parts[i].component_id == i) for i in parts) and parts[len(texts)].n_shingles == 0


def test_near_duplicates_take_ids_of_any_type(spark, rng):
    text = words(rng, 60)
    frame = spark.createDataFrame([("b", text), ("a", f"{text} more"), (None, "x y z"), ("c", None)], "doc_id string, text string")
    rows = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()}
    assert rows == {"b": ("a", False), "a": ("a", True), None: (None, True), "c": ("c", True)}


def test_near_duplicates_without_ids_keep_one_of_a_group(spark, rng):
    a, b = words(rng, 80), words(rng, 80)
    rows = minhash.near_duplicates(docs(spark, [a, edited(rng, a, 1), b, edited(rng, b, 1)], ids=[None, None, None, 4])).collect()
    assert len({r.group for r in rows}) == 2 and sorted((r.component_id or -1, r.kept) for r in rows) == [(-1, False), (-1, True), (4, False), (4, True)]


def test_near_duplicates_without_ids_and_rows(spark, rng):
    text = words(rng, 50)
    rows = minhash.op4_near_duplicates(docs(spark, [text, text, text, "alone", None], ids=[None, 8, 8, None, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, -1, True), (-1, 8, False), (8, 8, True), (8, 8, True)]
    assert minhash.op4_near_duplicates(docs(spark, [text]).limit(0)).count() == 0


def test_near_duplicates_of_different_texts_under_one_id(spark):
    rng = random.Random(31)
    a, b, c = (words(rng, 80, 5000) for _ in range(3))
    texts, ids = [a, b, edited(rng, a, 1), edited(rng, b, 1), c, edited(rng, c, 1), edited(rng, c, 1)], [5, 5, 7, 3, 9, None, 9]
    rows = minhash.near_duplicates(docs(spark, texts, ids=ids), words=3, similarity=85).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 9), (3, 3), (5, 3), (5, 5), (7, 5), (9, 9), (9, 9)]


def test_sketch_agreement_is_the_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 700, dtype=np.uint64)
    a, b = np.concatenate([both, rng.integers(0, 2**63, 150, dtype=np.uint64)]), np.concatenate([both, rng.integers(0, 2**63, 150, dtype=np.uint64)])
    got = minhash.sketches(np.concatenate([a, b, a[:1]]), np.array([len(a), len(b), 1]), 4096)
    assert abs((got[0] == got[1]).mean() - 0.7) < 0.04
    assert (got != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


# -- secrets --------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


def test_secret_spans_equal_brute_force(spark, rng):
    live = "Zk3" + "q9" * 10
    texts = [
        None, "", "PassWord='hunter22' token=abc token: abcdefg", f"😀 api_key = \"{live}\" é", f"see {live}, there", "AKIA" + "A1" * 9 + " AKIA123", "0123456789abcdef" * 2,
        "secret=token=abcdef secret : x", "password=token: abcdefghij", "apikey:" + "0a" * 13, "tokens: aaaa=bbbb", "password=changeme", "password=changeme now", "x password=changeme", "y password=changeme",
    ]
    texts += ["".join(rng.choice(["token", "=", ":", " ", "'", "a1b2c3", "AKIA", "Z9" * 8, "ff" * 12, "é", "secret", "\n"]) for _ in range(30)) for _ in range(60)]
    sources = [f"repo{i % 3}" for i in range(len(texts))]
    rows = {r.doc_id: r for r in secrets.op5_secrets(docs(spark, texts, sources=sources)).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t)
        kinds = Counter(s.split(":")[0] for s in base)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert rows[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, rows[i].spans.split(",")))
    assert rows[4].spans == f"reuse:4:{4 + len(live)}"
    assert rows[11].n_example == 1 and rows[3].n_live == 1
    for r in rows.values():
        rated = [x.rsplit(":", 1) for x in filter(None, r.ratings.split(","))]
        assert ",".join(x for x, _ in rated) == r.spans and Counter(x for _, x in rated) == Counter({"live": r.n_live, "example": r.n_example})


def test_secret_values_of_several_owners_are_examples(spark):
    texts = ["token=abcdef1"] * 5 + [f"token=abcdef2 {i}" for i in range(2)] + [f"token=abcdef3 {i}" for i in range(4)] + ["see abcdef1", "see abcdef2", "see abcdef3"]
    sources = ["a"] * 5 + ["a", "b"] + ["a"] * 4 + ["a"] * 3
    rows = {r.doc_id: r for r in secrets.op5_secrets(docs(spark, texts, sources=sources)).collect()}
    assert all(rows[i].ratings == "assign:0:13:live" for i in range(5))  # copies of one text are one repository
    assert all(rows[i].ratings == "assign:0:13:example" for i in range(5, 11))
    assert [rows[i].ratings for i in (11, 12, 13)] == ["reuse:4:11:live", "", ""]


def test_secrets_of_long_texts_in_pieces(spark, rng):
    parts = ["token=abcdef1", " ", "words, of é prose\n", "AKIA" + "Q7" * 9, "ff" * 12, "password : 'hunter22'", ", ", "x" * 90]
    text = "".join(rng.choice(parts) for _ in range(400))
    frame = spark.createDataFrame([(text,)], "t string")
    for kind, pattern, group in ((0, secrets.ASSIGN, 1), (1, secrets.ACCESS, 0), (2, secrets.HEX, 0)):
        least = secrets.LEAST[secrets.KINDS[kind]]
        whole, cut = frame.select(*[secrets._spans(F.col("t"), kind, pattern, group, least, piece=n) for n in (10**6, 200)]).first()
        assert whole == cut and len(whole) > 5


def test_secrets_of_a_very_long_text(spark):
    text = "Plain words, and more of them. " * 40_000 + "token=abcdef1"
    row = secrets.op5_secrets(docs(spark, [text])).first()
    assert row.spans == f"assign:{len(text) - 13}:{len(text)}"


def test_secrets_of_repeated_rows(spark):
    rows = secrets.op5_secrets(docs(spark, ["password=abcdef9", "password=abcdef9", None], ids=[1, 1, None])).collect()
    assert sorted(r.n_assign for r in rows) == [0, 1, 1]
    assert secrets.op5_secrets(docs(spark, ["x"]).limit(0)).count() == 0


def test_secrets_are_found_again_in_every_form(spark):
    values = ["hunter2xyz", "correct-horse-battery", "S3cr3tV4lue99zz", "c29tZXRoaW5n==", "abc123", "ends.with-dash-", "aaaa=bbbb"]
    forms = ["see {} there", "it was {}.", "({}), twice: {}...", "key={}", "key={}.", "a=b={}", "{}=name"]
    texts = [f"password={v}" for v in values] + [f.replace("{}", v) for v in values[:-1] for f in forms] + ["see aaaa=bbbb.", "x=aaaa=bbbb.", None, "xhunter2xyz hunter2xyz9 password=abc123 abc12"]
    out = {r.doc_id: r.spans for r in secrets.op5_secrets(docs(spark, texts)).collect()}
    at = len(values)
    for v in values[:-1]:
        for f in forms:
            t = f.replace("{}", v)
            assert out[at] == ",".join(f"reuse:{m.start()}:{m.end()}" for m in re.finditer(re.escape(v), t)), t
            at += 1
    assert [out[at], out[at + 1], out[at + 2]] == ["reuse:4:13", "reuse:2:11", ""] and out[at + 3] == "assign:24:39"


# -- classifiers ----------------------------------------------------------------------------------------------------


def labelled(spark, rng, make, n=500):
    texts, y = [], []
    for i in range(n):
        label = int(rng.random() < 0.4)
        texts.append(make(label))
        y.append(label)
    return texts, y


def _held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_learns_words_and_stems(spark, rng):
    def make(label):
        w = words(rng, 40).split()
        for _ in range(3 * label):
            w.insert(rng.randrange(len(w)), rng.choice(["zorgla", "zorglin", "blarf"]))
        return " ".join(w)

    texts, y = labelled(spark, rng, make)
    texts += [None, "", "..."]
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.op6_toxicity(docs(spark, texts), labels).collect()}
    held = [i for i in range(len(y)) if _held(i)]
    assert all(rows[i].held_out == _held(i) and rows[i].predicted == int(rows[i].score >= 0.5) for i in rows)
    assert sum(rows[i].predicted == y[i] for i in held) >= 0.95 * len(held)
    assert rows[len(y)].score == rows[len(y) + 1].score and 0 <= rows[len(y)].score < 0.5


def test_toxicity_grammar_weighs_clauses():
    model = toxicity.Model({})
    one = lambda t: sum(s for _, s in model.clauses(t))
    assert one("you idiot") > one("an idiot") > one("not an idiot") > 0
    assert one('he said "an idiot"') < one("an idiot")
    assert one("a quiet day. nothing more") == 0
    assert len(model.clauses("you idiot! you moron")) == 2


def test_classifiers_without_labels(spark):
    texts = docs(spark, ["you stupid idiot moron", "a b c", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.op6_toxicity(texts, none).collect()}
    assert scores[0] > 0.5 > scores[1]
    assert {r.score for r in quality.op10_quality(texts, none).collect()} == {0.5}
    assert quality.op10_quality(texts.limit(0), none).count() == 0


def test_quality_learns_structure(spark, rng):
    def make(label):
        w = words(rng, 40).split()
        return " ".join(w) + "." if label else rng.choice([" | ".join(w), " ".join(f"{x}!!" for x in w).upper(), " ".join(x for x in w[:4] for _ in range(10))])

    texts, y = labelled(spark, rng, make)
    texts += [None, ""]
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.op10_quality(docs(spark, texts), labels).collect()}
    held = [i for i in range(len(y)) if _held(i)]
    assert sum(rows[i].predicted == y[i] for i in held) >= 0.95 * len(held)
    assert rows[len(y)].score == rows[len(y) + 1].score


def test_factorisation_machine_is_the_sum_over_pairs(rng):
    texts = [words(rng, 12) for _ in range(40)]
    model = quality.fit([(t, i % 2) for i, t in enumerate(texts)], epochs=1)
    at, sizes, rows = quality.Featurizer()(texts[:3])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for i, got in enumerate(model.score(at, sizes, rows)):
        f = [*at[ends[i] : ends[i + 1]], *range(quality.BUCKETS, quality.BUCKETS + quality.STATS)]
        x = [1 / np.sqrt(sizes[i])] * sizes[i] + list(model.dense(rows)[i])
        raw = model.w0 + sum(model.w[a] * b for a, b in zip(f, x, strict=True))
        raw += sum(model.v[f[a]] @ model.v[f[b]] * x[a] * x[b] for a, b in itertools.combinations(range(len(f)), 2))
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9


def test_samples_leave_out_what_is_held(spark):
    long = "word " * 40_000
    texts = docs(spark, [f"text {i}" for i in range(60)] + [long, "other text of 60", None], ids=[*range(60), 60, 60, 61])
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(1, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = [r.asDict() for r in sample(texts, labels, "toxic", per_label=10).collect()]
    got = chosen(rows, 10)
    ids = [int(r["t"].split()[1]) for r in got if r["t"].startswith("text")]
    assert len(got) == 20 and not any(_held(i) for i in ids) and Counter(r["y"] for r in got) == {0: 10, 1: 10}
    assert got == chosen([r.asDict() for r in sample(texts, labels, "toxic", per_label=10).collect()], 10)
    whole = {r["t"] for r in chosen([r.asDict() for r in sample(texts, labels, "toxic").collect()])}
    assert (long in whole or "other text of 60" in whole) and len(whole) == 1 + sum(not _held(i) for i in range(60))


def test_equal_texts_are_learnt_once():
    rows = [{"k": 1, "y": 0, "h": 7}, {"k": 2, "y": 1, "h": 7}, {"k": 0, "y": 1, "h": 8}]
    assert chosen(rows, 5) == [{"k": 0, "y": 1, "h": 8}, {"k": 1, "y": 1, "h": 7}] and len(chosen(rows, 1)) == 1


def brute_clause(symbols, weights):
    """The grammar's rules read off the places of the symbols."""
    total = 0.0
    for i, (x, w) in enumerate(zip(symbols, weights, strict=True)):
        near = lambda marks, n: any(symbols[j] in marks for j in range(max(0, i - n), i))
        back = lambda marks, n: next((j for j in range(i - 1, max(-1, i - n - 1), -1) if symbols[j] in marks), None)
        emitted = w
        if x == toxicity.INSULT:
            emitted *= toxicity.REPEATED if near({toxicity.INSULT}, 3) else 1.0
            person = back({toxicity.TARGET}, 3)
            if person is not None:
                emitted *= toxicity.PREDICATED if toxicity.LINK in symbols[person + 1 : i] else toxicity.ADDRESSED
        last = back({toxicity.THREAT, toxicity.TARGET}, 3)
        if last is not None and (symbols[last], x) == (toxicity.TARGET, toxicity.THREAT):
            emitted += toxicity.INVERTED * toxicity.THREAT_WEIGHT
        if last is not None and (symbols[last], x) == (toxicity.THREAT, toxicity.TARGET):
            emitted += toxicity.DIRECT * toxicity.THREAT_WEIGHT
        kind = 0 if x == toxicity.INSULT else 1
        if x in (toxicity.INSULT, toxicity.THREAT, toxicity.TARGET):
            emitted *= toxicity.NEGATED[kind] if near({toxicity.NEGATION}, 3) else 1.0
            emitted *= toxicity.REPORTED[kind] if near({toxicity.REPORT}, 6) else 1.0
        emitted *= toxicity.QUOTED if symbols[:i].count(toxicity.QUOTE) % 2 else 1.0
        total += emitted
    return total


def test_toxicity_machine_equals_its_rules():
    rng, step = random.Random(8), toxicity.grammar().step
    for _ in range(2000):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(1, 16))]
        weights = [float(x == toxicity.INSULT) * 4 + (x == toxicity.THREAT) * rng.choice([0, 3]) for x in symbols]
        state, score = 0, 0.0
        for x, w in zip(symbols, weights, strict=True):
            state, own, bonus, scale = step[state][x]
            score += (w * own + bonus) * scale
        assert abs(score - brute_clause(symbols, weights)) < 1e-9


def test_threats_need_a_person():
    model = toxicity.Model({})
    one = lambda t: sum(s for _, s in model.clauses(t))
    assert one("kill time") == 0 and one("they kill") < one("i kill you") and one("i never kill you") < one("i kill you")
    assert one("you are an idiot") > one("you idiot") > one("idiot") and one("stupid idiot") > one("stupid. idiot")


def test_toxicity_of_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    texts = docs(spark, ["word " * 200_000 + "idiot", "word " * 200_000])
    scores = {r.doc_id: r.score for r in toxicity.op6_toxicity(texts, none).collect()}
    assert scores[0] > scores[1] and toxicity.op6_toxicity(texts.limit(0), none).count() == 0


# -- media ----------------------------------------------------------------------------------------------------------


def test_audio_round_trip(spark, rng):
    texts = [None, "", "a", "é" * 33, words(rng, 4000), words(rng, 4000)[:64], "same " * 99, "same " * 99]
    rows = {r.doc_id: r for r in audio.op7_audio(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(raw), len(payload))
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[i].tail_crc32 == zlib.crc32(payload[-64:])
        assert rows[i].media_sha256 == hashlib.sha256(audio.wav(payload)).hexdigest() and rows[i].media_bytes == len(payload) + 44
    assert rows[6].feature == rows[7].feature and rows[0].feature == rows[1].feature


def test_audio_features_are_tensors_with_spans(spark):
    rate = audio.RATE
    tone = lambda f, s, a: (128 + a * np.sin(2 * np.pi * f * np.arange(int(s * rate)) / rate)).astype(np.uint8).tobytes()
    sound = tone(500, 4, 3) + tone(500, 1, 100) + tone(500, 4, 3)
    media = spark.createDataFrame([(1, bytearray(audio.wav(sound))), (2, None)], "doc_id long, media binary")
    rows = audio.features(media).orderBy("chunk").collect()
    tensors = audio.as_tensors(pa.array([r.log_mel for r in rows]))
    assert tensors.type.shape == [audio.FRAMES, audio.MELS] and rows[0].from_ms == 0 and rows[-1].to_ms >= 8900
    (a, b), *rest = [(s.from_ms, s.to_ms) for r in rows for s in r.segments]
    assert not rest and abs(a - 4000) < 150 and abs(b - 5000) < 150
    mel = tensors.to_numpy_ndarray()[0][5]
    assert np.argmax(mel) == np.argmax(audio.mel_bank()[round(500 / (audio.RESAMPLED / 2) * audio.WINDOW / 2)])


def test_resampling_keeps_a_tone_and_drops_what_would_fold():
    t = np.arange(4000) / audio.RATE
    low, high = (audio.resample(np.sin(2 * np.pi * f * t), audio.low_pass())[100:-100] for f in (400, 3700))
    assert abs(np.abs(low).max() - 1) < 0.05 and np.abs(high).max() < 0.1


@pytest.mark.parametrize("up, down", [(3, 4), (1, 2), (5, 3), (1, 1)])
def test_polyphase_equals_filling_filtering_and_thinning(up, down):
    x = np.random.default_rng(0).normal(size=230)
    h = audio.low_pass(up, down)
    filled = np.zeros(len(x) * up)
    filled[::up] = x
    naive = np.convolve(filled, h)[: len(filled) : down]
    assert np.allclose(audio.resample(x, h, up, down), naive) and len(audio.resample(x[:1], h, up, down)) >= 1


def test_features_equal_a_naive_transform():
    x = (np.random.default_rng(1).integers(0, 256, 9000)).astype(np.uint8)
    steps, energy = audio.Analyser().frames(x.tobytes())
    y = audio.resample((x.astype(float) - 128) / 128, audio.low_pass())
    n = np.arange(audio.WINDOW)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(audio.WINDOW // 2 + 1), n) / audio.WINDOW)
    for f in (0, 7, len(energy) - 2):
        power = np.abs(dft @ (y[f * audio.HOP : f * audio.HOP + audio.WINDOW] * np.hanning(audio.WINDOW))) ** 2
        want = np.log10(np.maximum(power @ audio.mel_bank(), 10**audio.SILENCE)) * audio.STEP
        assert np.abs(steps.reshape(-1, audio.MELS)[f] - want).max() <= 0.5001
        assert abs(energy[f] - 10 * np.log10(power.sum())) <= 0.0501


def test_audio_of_repeated_rows_any_ids_and_no_rows(spark):
    frame = spark.createDataFrame([("x", "same", 1), ("x", "same", 2), (None, None, 3), ("x", "same\0", 4)], "doc_id string, text string, chunk int")
    rows = audio.op7_audio(frame).collect()
    assert sorted((r.doc_id or "", r.n_bytes) for r in rows) == [("", 0), ("x", 4), ("x", 4), ("x", 5)]
    assert audio.op7_audio(frame.limit(0)).count() == 0


def test_audio_tensors_are_stored_with_their_spans(spark, rng):
    media = audio.media_table(docs(spark, [words(rng, 9000), None, "é" * 40_000]))
    rows = audio.written(audio.features(media), "test-tensors")
    tensors = audio.as_tensors(rows.orderBy("doc_id", "chunk").select("log_mel").toArrow()["log_mel"])
    assert tensors.type.shape == [audio.FRAMES, audio.MELS] and len(tensors) == rows.count()
    assert all(r.from_ms < r.to_ms for r in rows.collect()) and rows.where("sound is not null").count() == 3


# -- packing --------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, fast = Tokenizer.from_file(path), packing.Encoder(path, memo=50)
    rng = random.Random(2)
    alphabet = "aébçΣσİ'sdtnv.,!? \t\n1²́ \x1d<|>😀ß-_Ⅷª"
    odd = ["", "it's I'LL 's. T", "ΟΔΟΣ ς.", "<|endoftext|> x<|endoftext|>", "日本語 नमस्ते", "ﬁn ½", "Ǻ é é"]
    for t in odd + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]:
        assert fast.encode(t) == array.array("I", whole.encode(t, add_special_tokens=False).ids).tobytes()


def test_encoder_of_other_settings_is_the_tokenizer(tmp_path):
    import json

    from tokenizers import Tokenizer

    settings = json.loads(Tokenizer.from_file(packing.default_tokenizer()).to_str())
    settings["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(settings))
    fast, whole = packing.Encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not fast.plain and packing.Encoder(packing.default_tokenizer()).plain
    assert fast.encode("E\u0301t\u00e9 it's") == array.array("I", whole.encode("E\u0301t\u00e9 it's", add_special_tokens=False).ids).tobytes()


def test_packing_takes_ids_of_any_type_and_many_equal_rows(spark):
    frame = spark.createDataFrame([("a", "one two"), (None, None)] + [("b", "three four five")] * 500, "doc_id string, text string")
    rows = packing.op8_pack(frame).collect()
    assert len(rows) == 502 and sorted({(r.sequence_id, r.offset) for r in rows}).__len__() == 502


def test_minimum_bin_slack_finds_the_fullest(rng):
    for _ in range(30):
        counts = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(1, 9)))
        room = rng.randrange(5, 60)
        sums = {sum(c) for n in range(sum(counts.values()) + 1) for c in itertools.combinations(list(counts.elements()), n)}
        got = packing._fullest(dict(counts), room)
        assert sum(a * b for a, b in got) == max(s for s in sums if s <= room) and all(n <= counts[a] for a, n in got)


def test_packing(spark, rng):
    texts = [None, "", words(rng, 5000)] + [words(rng, rng.randrange(1, 900)) for _ in range(150)] + ["same text"] * 5
    rows = packing.op8_pack(docs(spark, texts)).collect()
    seqs, lengths = defaultdict(list), defaultdict(dict)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id][r.piece] = r
    from tokenizers import Tokenizer

    whole, total = Tokenizer.from_file(packing.default_tokenizer()), 0
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        parts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert [(p, r.start, r.length, r.ids_crc32) for p, r in sorted(lengths[i].items())] == [
            (k, k * 2048, len(x), zlib.crc32(array.array("I", x).tobytes())) for k, x in enumerate(parts)
        ]
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    bins = []
    for n in sorted((r.length for r in rows), reverse=True):  # first-fit decreasing is no better
        b = next((b for b, used in enumerate(bins) if used + n <= 2048), None)
        if b is None:
            bins.append(n)
        else:
            bins[b] += n
    assert -(-total // 2048) <= len(seqs) <= len(bins)
    assert packing.op8_pack(docs(spark, texts).limit(0)).count() == 0


# -- languages ------------------------------------------------------------------------------------------------------


def test_language(spark, rng):
    syllables = {"aa": ["ba", "lo", "mi"], "bb": ["tsch", "ung", "er"], "cc": ["ção", "nho", "á"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    langs = [rng.choice(sorted(syllables)) for _ in range(150)]
    texts = [text(x, rng.randrange(5, 400)) for x in langs] + [None, "", "12 !?", "日本", text("bb", 3000)]
    frame = docs(spark, texts, langs=langs + [None, "aa", None, None, None])
    rows = {r.doc_id: r for r in langid.op9_language(frame).collect()}
    assert all(rows[i].lang_pred == x for i, x in enumerate(langs))
    assert [rows[150 + k].lang_pred for k in range(3)] == ["und"] * 3 and rows[153].lang_pred in syllables and rows[154].lang_pred == "bb"
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= rows[i].score <= 1 for i in rows)
    assert langid.op9_language(frame.limit(0)).count() == 0


def test_cross_parsing_takes_longest_phrases(rng):
    learnt = "".join(rng.choice("abc ") for _ in range(300)).strip()
    model = langid.Model({"x": [learnt], "y": ["zzz"]})
    symbols = model.reader()(learnt)
    read = "".join(" " if s == 0 else chr(s) for s in symbols)
    for _ in range(20):
        q = "".join(rng.choice("abcd ") for _ in range(60))
        s = model.reader()(q)
        t, phrases, at = "".join(" " if v == 0 else chr(v) for v in s), 0, 0
        while at < len(t):
            n = 1
            while at + n < len(t) and t[at : at + n + 1] in read:
                n += 1
            phrases, at = phrases + 1, at + n
        got = model.phrases(np.ascontiguousarray(s.astype(np.int32)[:, None]))
        # a symbol that was never learnt ends the phrase before it and is one itself
        unknown = sum(c not in read for c in t)
        assert abs(int(got[0, 0]) - phrases) <= unknown + 1


def test_cross_parsing_of_many_letters_is_exact():
    rng = random.Random(21)
    letters = [chr(0x4E00 + i) for i in range(200)] + list("abcdefgh")
    learnt = {"x": "".join(rng.choice(letters[:120] + [" "]) for _ in range(700)).strip(), "y": "".join(rng.choice(letters[80:] + [" "]) for _ in range(700)).strip()}
    model = langid.Model({k: [v] for k, v in learnt.items()})
    clean = {k: " ".join(v.split()) for k, v in learnt.items()}
    for _ in range(30):
        at = rng.randrange(500)
        q = " ".join((learnt["x"][at : at + 30] + "".join(rng.choice([*letters, "\u0416", "\u0429", " "]) for _ in range(30))).split())
        got = model.phrases(np.ascontiguousarray(model.reader()(q)[:, None]))[:, 0].tolist()
        want = []
        for lang in model.langs:
            i = n = 0
            while i < len(q):
                m = 1
                while i + m < len(q) and q[i : i + m + 1] in clean[lang]:
                    m += 1
                i, n = i + m, n + 1
            want.append(n)
        assert got == want


def test_languages_of_many_letters_and_copies(spark):
    rng = random.Random(22)
    word = lambda first, n: "".join(chr(first + rng.randrange(n)) for _ in range(3))
    shared = [word(0x4E00, 48) for _ in range(200)]
    own = {x: [word(first, 200) for _ in range(100)] for x, first in (("jj", 0x5000), ("kk", 0x6000))}
    text = lambda lang: " ".join(rng.choice(shared if rng.random() < 0.7 else own[lang]) for _ in range(80))
    langs = [rng.choice(["jj", "kk"]) for _ in range(90)]
    frame = docs(spark, [text(x) for x in langs], langs=langs)
    rows = {r.doc_id: r for r in langid.op9_language(frame).collect()}
    assert [rows[i].lang_pred for i in range(90)] == langs
    copies = docs(spark, ["kopie"] * 300 + list("uvwxyzq"), langs=["aa"] * 307)
    held = {i for i in range(300, 307) if zlib.crc32(str(i).encode()) % 3 == 1}
    model = langid.learn(copies, per_lang=8)
    assert set(model.alphabet) == set("kopie") | {c for i, c in enumerate("uvwxyzq", 300) if i not in held}
    assert model.bits[0] < 4


def test_languages_are_learnt_from_all_of_a_text(spark):
    rng = random.Random(23)
    text = "a" * 5000 + "".join(rng.choice("bcdefg ") for _ in range(200_000))
    frame = spark.createDataFrame([("x", text, "aa"), ("y", "zz", "bb"), (None, "zz", "bb")], "doc_id string, text string, lang string")
    frame = frame.where(~langid.held_out(F.col("doc_id")))
    rows = langid.passages(frame.selectExpr("lang", "text AS t"), 5, 100).collect()
    assert len([r for r in rows if r.lang == "aa"]) == 5 and [r.p for r in rows if r.lang == "bb"] in ([], ["zz"])
    assert any("b" in r.p for r in rows) and all(r.p in text or r.p == "zz" for r in rows)
    assert {r.doc_id for r in langid.op9_language(frame).collect()} <= {"x", "y", None}
