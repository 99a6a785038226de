"""Language identification by cross-parsing against suffix automata.

Per language, a suffix automaton of sampled labelled text recognises exactly the substrings of that text. A document
is parsed into the longest phrases that the automaton knows, one after another; the language whose automaton needs the
fewest phrases, normalised as the cross-parsing entropy phrases * log2(size of the text learnt) / symbols, wins, ties by name.
Texts are read as lower-case letters with one blank for anything between them, in blocks of BLOCK symbols that
are parsed side by side (a block ends a phrase, the same for all languages). Every letter that was learnt is a symbol;
the transitions by the DENSE most frequent ones are a table, those by the others are sorted and searched.

Learning is bounded: PASSAGES of PASSAGE_CHARS characters of each language, drawn by a hash from all passages that whole
texts fall into, so that any part of any document may be learnt; the model grows with the number of languages, by
about 16 MB each. Prediction reads whole texts and nothing but the text.

Defined cases: a null text, or one without a letter, is "und" with score 0, as is everything if no language can be
learnt; letters that a language never learnt are phrases of their own; equal passages are learnt once; repeated rows
get equal results; null ids are held in; ids are of any type.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import written

PASSAGES = 48
PASSAGE_CHARS = 800
#: So many times the wanted passages are drawn at first, by the last bits of their hash.
DRAWN, HASHES = 8, 1 << 40
DENSE = 48
BLOCK = 1024
#: Symbols that are parsed side by side.
AT_ONCE = 2_000_000
SHARPNESS = 12.0


class SuffixAutomaton:
    """States and transitions of the automaton of all substrings of a sequence of symbols."""

    def __init__(self, symbols: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        new = self._state({}, self.len[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.len[q] == self.len[p] + 1:
                self.link[new] = q
            else:
                clone = self._state(dict(self.next[q]), self.len[p] + 1, self.link[q])
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = clone
                    p = self.link[p]
                self.link[q] = self.link[new] = clone
        return new

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1


class Reader:
    """Texts as arrays of symbols: 0 blank, 1 letters never learnt, 2.. the alphabet, with the padding's symbol left out."""

    def __init__(self, alphabet: str) -> None:
        self.table = np.zeros(0x110000, np.int32)
        self.table[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        for i, c in enumerate(alphabet):
            self.table[ord(c)] = i + 2 if i < DENSE else i + 3

    def __call__(self, text: str) -> np.ndarray:
        s = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = s != 0
        if len(s):
            keep[1:] |= s[:-1] != 0
        return s[keep]


class Model:
    """Languages with one table: row of a state, column of a symbol, value (row of the next state) * 4 + phrases ended.
    rare has the transitions by symbols beyond the table: sorted keys of state and symbol, and their values."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        letters = Counter(c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha())
        self.alphabet = "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0])))
        self.width = min(len(self.alphabet), DENSE) + 3  # the last symbol is padding
        self.n_rare = max(len(self.alphabet) - DENSE, 1)
        read, self.langs = Reader(self.alphabet), sorted(texts)
        tables, self.roots, self.bits, at, rare = [], [], [], 0, []
        for lang in self.langs:
            symbols = np.concatenate([read(t) for t in texts[lang]] or [np.zeros(0, np.int32)]).tolist()
            auto = SuffixAutomaton(symbols)
            tables.append(self._table(auto, at))
            rare += [
                ((s + at) * self.n_rare + c - self.width, (t + at) * self.width * 4)
                for s, following in enumerate(auto.next) for c, t in following.items() if c >= self.width
            ]
            self.roots.append(at * self.width)
            self.bits.append(math.log2(len(symbols) + 2))
            at += len(tables[-1])
        kind = np.int32 if at * self.width * 4 < 2**31 - 4 else np.int64
        self.table = np.concatenate([t.astype(kind) for t in tables]).reshape(-1) if tables else np.zeros(0, kind)
        self.rare = np.array(sorted(rare), np.int64).reshape(-1, 2).T.copy()

    def _table(self, auto: SuffixAutomaton, at: int) -> np.ndarray:
        w = self.width
        # no transition ends the phrase; a letter that the root does not know either is one of its own
        root = [(auto.next[0][c] + at) * w * 4 + 1 if c in auto.next[0] else at * w * 4 + 2 for c in range(w)]
        out = np.tile(np.array(root, np.int64), (len(auto.next), 1))
        out[0] = [at * w * 4 + 1] * w
        for s, following in enumerate(auto.next):
            for c, t in following.items():
                if c < w:
                    out[s, c] = (t + at) * w * 4
        out[:, w - 1] = (np.arange(len(auto.next), dtype=np.int64) + at) * w * 4  # padding stays
        return out

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        """Phrases per language and block; blocks has a column for each block, padded below."""
        roots = np.array(self.roots, self.table.dtype)[:, None]
        state = np.repeat(roots, blocks.shape[1], axis=1)
        count = np.zeros(state.shape, np.int32)
        lanes = blocks.shape[1]
        for row, beyond in zip(blocks, (blocks >= self.width).any(axis=1), strict=True):
            while lanes and row[lanes - 1] == self.width - 1:  # blocks are sorted by falling length
                lanes -= 1
            if not lanes:
                break
            if beyond:
                here = row[:lanes]
                v = self.table[state[:, :lanes] + np.minimum(here, self.width - 1)]
                at = np.flatnonzero(here >= self.width)
                v[:, at] = self._rare(state[:, at], here[at], roots)
            else:
                v = self.table[state[:, :lanes] + row[:lanes]]
            count[:, :lanes] += v & 3
            state[:, :lanes] = v >> 2
        return count + (state != roots)

    def _rare(self, state: np.ndarray, symbols: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Values as in the table, for symbols beyond it."""
        keys, values = self.rare

        def look(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            wanted = rows.astype(np.int64) // self.width * self.n_rare + symbols - self.width
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return keys[at] == wanted, values[at]

        known, following = look(state)
        begins, first = look(np.broadcast_to(roots, state.shape))
        fresh = np.where(begins, first + 1, roots * 4 + np.where(state == roots, 1, 2))
        return np.where(known, following, fresh)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        read, out = self.reader(), []
        at = 0
        while at < len(texts):
            symbols, total = [], 0
            while at < len(texts) and (not symbols or total < AT_ONCE):
                symbols.append(read(texts[at] or ""))
                total, at = total + len(symbols[-1]), at + 1
            out += self._predict(symbols)
        return out

    def reader(self) -> Reader:
        if not hasattr(self, "_reader"):
            self._reader = Reader(self.alphabet)
        return self._reader

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_reader"}

    def _predict(self, symbols: list[np.ndarray]) -> list[tuple[str, float]]:
        sizes = np.array([len(s) for s in symbols])
        doc, parts = [], []
        for d, s in enumerate(symbols):
            if s.any():
                for i in range(0, len(s), BLOCK):
                    doc.append(d)
                    parts.append(s[i : i + BLOCK])
        if not parts or not self.langs:
            return [("und", 0.0)] * len(symbols)
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        blocks = np.full((len(parts), len(parts[order[0]])), self.width - 1, np.int32)
        for i, k in enumerate(order):
            blocks[i, : len(parts[k])] = parts[k]
        count = self.phrases(np.ascontiguousarray(blocks.T))
        per_doc = np.zeros((len(self.langs), len(symbols)))
        for lang in range(len(self.langs)):
            np.add.at(per_doc[lang], np.array(doc)[order], count[lang])
        entropy = per_doc * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        best = entropy.argmin(axis=0)
        share = np.exp(SHARPNESS * (entropy.min(axis=0) - entropy)).sum(axis=0)
        known = np.zeros(len(symbols), bool)
        known[doc] = True
        return [(self.langs[b], float(1 / s)) if k else ("und", 0.0) for b, s, k in zip(best, share, known, strict=True)]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def passages(rows: DataFrame, wanted: int, chars: int) -> DataFrame:
    """Stored rows (lang, n, p): of the passages of chars characters of all texts t, wanted different ones of each
    language, those of the least hash. Passages are drawn by a bound on their hash before they are dealt by language, so
    that no task gets a language; where copies leave too few, the bound is raised until there are enough."""
    total = rows.groupBy("lang").agg(F.sum(F.ceil(F.length("t") / chars)).alias("n"))
    bounds = written(total.withColumn("bound", F.least(F.lit(HASHES), F.ceil(DRAWN * wanted * F.lit(float(HASHES)) / F.col("n")))), "lang-bounds")
    every = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{chars}}}+"), F.lit(0))
    while True:
        each = rows.join(F.broadcast(bounds.select("lang", "bound")), "lang")
        some = F.filter(every, lambda p: F.pmod(F.xxhash64(p), F.lit(HASHES)) < F.col("bound"))
        each = each.select("lang", F.explode_outer(some).alias("p")).where("p is not null").distinct()
        drawn = written(each, "passages")
        counts = drawn.groupBy(F.col("lang").alias("_l")).agg(F.count(F.lit(1)).alias("c"))
        few = (F.col("bound") < HASHES) & (F.coalesce("c", F.lit(0)) < wanted)
        met = bounds.join(counts, F.col("lang") == F.col("_l"), "left")
        if not met.where(few).limit(1).count():
            break
        raised = F.when(few, F.least(F.lit(HASHES), F.col("bound") * 16)).otherwise(F.col("bound"))
        bounds = written(met.select("lang", "n", raised.alias("bound")), "lang-bounds")
    first = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("p"), F.lit(HASHES)), "p")
    return drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= wanted)


def learn(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_lang: int = PASSAGES,
    chars: int = PASSAGE_CHARS,
) -> Model:
    """Fits on the documents that are not held out."""
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0) & ~held_out(F.col(doc_id)))
    found = passages(rows.select(F.col(lang).alias("lang"), F.col(text).alias("t")), per_lang, chars)
    texts: dict[str, list[str]] = {}
    for r in sorted(found.select("lang", "n", "p").collect()):  # per_lang rows of each language
        texts.setdefault(r["lang"], []).append(r["p"])
    return Model(texts)


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages * PASSAGES * PASSAGE_CHARS

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column("text").to_pylist())
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            same = [batch.column(c) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*same, langs, scores], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def op9_language(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
