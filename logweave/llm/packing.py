"""Best-fit packing of token sequences by minimum bin slack.

Lengths are counted, and the driver fills one bin after another: the longest piece left seeds it, a subset-sum
dynamic programme over a bitset of the reachable fills finds the fullest completion from the lengths still
available, and that combination is removed, as often as the counts allow at once. Each removal uses up a length, so
there are at most as many combinations as lengths, whatever the number of documents. Combinations name ranges of
numbers within a length; a join carries sequence and offset to the pieces.

Defined cases: a null text is an empty one, whose only token is the closing id; every document has at least one
piece; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import array
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import small_batches, spread, written
from logweave.llm.ordinals import numbered

CAPACITY = 2048
CLOSING = (0).to_bytes(4, "little")
#: White-space-free chunks whose ids are remembered by a worker, about 150 bytes each.
MEMO_CHUNKS = 700_000
#: Marks that end a chunk as tokens of their own, and strings that are no words to the tokenizer.
CLOSING_MARKS = ".,;:!?%$*&#|)"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
SALTS = 256
PER_SALT = 200_000
#: The settings of a vocabulary whose chunks may be encoded one by one, and plain words by the model alone.
PLAIN_SETTINGS = {
    "truncation": None,
    "padding": None,
    "post_processor": None,
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Python's split() also cuts at these, which are no white space for the tokenizer.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian bytes.

    A vocabulary with PLAIN_SETTINGS splits at white space and drops it, so the ids of a text are those of its chunks in
    turn. Chunks are encoded once and remembered. A chunk of letters and closing punctuation is split there, as the
    tokenizer does, and its letters go straight to the tokenizer's model; any other chunk goes through the whole
    tokenizer. With a vocabulary of other settings whole texts do.
    """

    def __init__(self, path: str, memo: int = MEMO_CHUNKS) -> None:
        self.tokenizer, self.memo, self.most = _tokenizer(path), {}, memo
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        settings = json.loads(self.tokenizer.to_str())
        added = {x["content"] for x in settings["added_tokens"]}
        self.plain = added == set(SPECIAL) and all(settings[k] == v for k, v in PLAIN_SETTINGS.items())

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = self.memo[word] = array.array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def _chunk(self, chunk: str) -> bytes:
        core = chunk.rstrip(CLOSING_MARKS)
        if not core.isalpha() or chunk in SPECIAL or "\u03a3" in core:  # a capital sigma's lower case depends on its place
            return self._whole(chunk)
        tail, core = chunk[len(core) :], unicodedata.normalize("NFC", core).lower()
        if not core.isalpha():
            return self._whole(chunk)
        ids = self._letters(core)
        if tail:
            marks = self.memo.get(tail)
            if marks is None:
                marks = self.memo[tail] = self._whole(tail)
            ids += marks
        return ids

    def encode(self, text: str) -> bytes:
        if not self.plain or any(c in text for c in ODD_SPACE):
            return self._whole(text)
        memo, chunks = self.memo, text.split()
        if len(memo) > self.most:
            memo.clear()
        for c in set(chunks).difference(memo):
            memo[c] = self._chunk(c)
        return b"".join(map(memo.__getitem__, chunks))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary: a Python worker keeps what it has learnt from one task to the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY):
    """Rows (doc_id, h, piece, start, length, ids_crc32): the texts tokenized, closed and cut at capacity."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            row, cols = [], ([], [], [], [])
            for k, t in enumerate(batch.column("text").to_pylist()):
                ids = (encode(t) if t is not None else b"") + CLOSING
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    for col, value in zip(cols, (i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(value)
            found = [pa.array(col, t) for col, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            same = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "h")]
            yield pa.RecordBatch.from_arrays([*same, *found], names=["doc_id", "h", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {id_type}, h long, piece int, start long, length long, ids_crc32 long")


def _fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, times) of available lengths whose sum is the largest not above room; longer lengths first."""
    mask, reach, layers = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        layers.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left > 0:  # times 1, 2, 4, ... and the rest reach every number of them
            step = min(step, left)
            reach |= reach << step * length & mask
            left, step = left - step, step * 2
        if reach >> room & 1:
            break
    fill, out = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        times = 0
        while not before >> fill & 1:
            fill, times = fill - length, times + 1
        if times:
            out.append((length, times))
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Combinations (bins, [(length, times), ...]) that use up the counts."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        seed = max(counts)
        left = {k: v - (k == seed) for k, v in counts.items() if v > (k == seed)}
        combo = dict(_fullest(left, capacity - seed))
        combo[seed] = combo.get(seed, 0) + 1
        bins = min(counts[k] // n for k, n in combo.items())
        for k, n in combo.items():
            counts[k] -= bins * n
            if not counts[k]:
                del counts[k]
        out.append((bins, sorted(combo.items(), reverse=True)))
    return out


def _plan(combos: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, times, first sequence, first offset): numbers of a length from 0."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for bins, combo in combos:
        offset = 0
        for length, times in combo:
            at = used.get(length, 0)
            rows.append((length, at, at + bins * times, times, first, offset))
            used[length], offset = at + bins * times, offset + times * length
        first += bins
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most capacity; cut must be a stored table."""
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    plan = _plan(minimum_bin_slack(counts, capacity))
    plan_df = cut.sparkSession.createDataFrame(
        plan, "_length long, _lo long, _hi long, _times long, _first long, _offset long"
    )
    salts = spread(sum(counts.values()), PER_SALT, SALTS)
    order = [F.col(c) for c in ("doc_id", "h", "piece")]
    at = F.col("_at") - F.col("_lo")
    # at most two plan rows for each of the capacity's lengths and combinations: a few thousand rows
    return (
        numbered(cut, ["length"], order, "_at", salts, ties=True)
        .join(
            F.broadcast(plan_df),
            (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")),
        )
        .withColumn("sequence_id", (F.col("_first") + F.floor(at / F.col("_times"))).cast("long"))
        .withColumn("offset", (F.col("_offset") + F.pmod(at, F.col("_times")) * F.col("length")).cast("long"))
        .drop("_length", "_lo", "_hi", "_times", "_first", "_offset", "_at")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    with small_batches(docs.sparkSession):
        cut = written(pieces(docs, tokenizer_path or default_tokenizer(), capacity=capacity), "pieces")
    return pack(cut, capacity)


def op8_pack(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
