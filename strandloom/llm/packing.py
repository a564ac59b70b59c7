"""Packing of token sequences by minimum bin slack.

Documents become token ids, longer ones are cut into pieces of the capacity. Only the histogram of piece lengths (at
most ``capacity`` entries, whatever the input) reaches the driver. There, per bin, a bitset subset-sum programme over the
lengths still available finds the fullest bin that holds the longest remaining piece; the same combination is used as
often as the counts allow and removed. Pieces then find their bin by their rank among the pieces of equal length, which is
counted per partition and offset, so a length that many documents share never meets in one task.

Defined cases: a null or empty text is one piece with the end id alone; equal rows are packed as separate pieces; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT = PIECES + ", sequence_id long, offset long"

_PUNCT = b".,;:!?"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class WordCoder:
    """Token ids of words, as little-endian 32-bit ids; words seen before come from a bounded cache.

    Holds for tokenizers that drop white space and code each word by itself. New words go to the tokenizer many at a
    time, parted by a special token; ``lowercase`` says that it folds A-Z. The cache has two generations of at most
    ``keep`` words: when the younger is full it becomes the older, and words in use move on from there.
    """

    def __init__(self, path: str, keep: int = 600_000, lowercase: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        special = [t for t in spec.get("added_tokens", []) if t.get("special")]
        self.plain = None
        end = spec["model"].get("end_of_word_suffix")
        if end and r"[\\p{L}]+" in json.dumps(spec["pre_tokenizer"]):
            # Letters alone are one run for the pattern: they need neither it nor the normaliser, and end with a marked piece.
            byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
            self.plain = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(self.coder.get_vocab_size(), bool)
            self.ends[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(end)]] = True
        self.mark = (special[-1]["content"], special[-1]["id"]) if special else None
        self.keep, self.lowercase = keep, lowercase
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _letters(self, w: bytes) -> bool:
        """Whether a word is lower-case letters in the normal form."""
        if w.isascii():
            return w.isalpha() and w.islower()
        text = w.decode()
        return text.isalpha() and text.islower() and text.lower() == text and is_normalized("NFC", text)

    def _encode(self, words: list[bytes]) -> None:
        letters, plain, odd = [], [], []
        for w in words:
            if self.plain is not None and self._letters(w):
                letters.append(w)
            else:
                (odd if self.mark is None or b"<" in w else plain).append(w)
        for i in range(0, len(letters), 512):
            group = letters[i: i + 512]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(group).decode()], add_special_tokens=False)[0].ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) != len(group):
                plain += group
                continue
            self.known.update(zip(group, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        groups = [plain[i: i + 512] for i in range(0, len(plain), 512)]
        joined = [self.mark[0].encode().join(g).decode() for g in groups] if plain else []
        for group, coded in zip(groups, self.coder.encode_batch_fast(joined, add_special_tokens=False) if joined else []):
            ids = np.array(coded.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark[1])
            raw = ids.tobytes()
            first = [0, *(4 * cuts + 4).tolist()]
            last = [*(4 * cuts).tolist(), len(raw)]
            for w, a, b in zip(group, first, last):
                self.known[w] = raw[a:b]
        for w in odd:
            self.known[w] = np.array(self.coder.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, word: bytes) -> bytes:
        """A word without its closing punctuation where the two are coded apart."""
        core = word.rstrip(_PUNCT)
        if len(core) < len(word) and (not core or core[-1] not in _ALNUM):
            core = word
        return core.lower() if self.lowercase and core.isascii() else core

    def _recall(self, words: set[bytes]) -> list[bytes]:
        """Words in neither generation; those in the older one move on."""
        new = words.difference(self.known)
        if not self.older:
            return list(new)
        again = self.older.keys() & new
        self.known.update((w, self.older[w]) for w in again)
        return list(new - again)

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + 2 * len(words) > self.keep:
            self.older, self.known = self.known, {}
        whole, parted, parts = [], [], set()
        for w in self._recall(words):
            core = self._core(w)
            if core == w:
                whole.append(w)
                continue
            end = w[len(core):]
            parted.append((w, core, end))
            parts.add(core)
            if end:
                parts.add(end)
        parts.difference_update(whole)
        self._encode(whole + self._recall(parts))
        known = self.known
        for w, core, end in parted:
            known[w] = known[core] + known[end] if end else known[core]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_coders: dict[str, WordCoder] = {}


def _pieces(tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _coders:
            _coders[tokenizer] = WordCoder(tokenizer)
        coder = _coders[tokenizer]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: tuple[list, ...] = ([], [], [], [], [])
                texts = batch.column(text_col).cast(pa.binary()).fill_null(b"").to_pylist()
                for doc, ids in zip(batch.column(id_col).to_pylist(), coder.ids(texts)):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start: start + 4 * capacity]
                        for column, value in zip(out, (doc, k, start // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths, with multiplicity, that fill ``capacity`` best together with the longest one available.

    ``bits`` holds the reachable sums; lengths come in powers of two of copies, so a traceback needs one state for each.
    """
    seed = max(counts)
    rest = capacity - seed
    mask = (1 << (rest + 1)) - 1
    bits, steps = 1, []
    for length in sorted((x for x in counts if x <= rest), reverse=True):
        left = min(counts[length] - (length == seed), rest // length)
        size = 1
        while left > 0 and not bits >> rest & 1:
            k = min(size, left)
            steps.append((length, k, bits))
            bits |= bits << (k * length) & mask
            left -= k
            size *= 2
        if bits >> rest & 1:
            break
    used = {seed: 1}
    target = bits.bit_length() - 1
    for length, k, before in reversed(steps):
        if not before >> target & 1:
            used[length] = used.get(length, 0) + k
            target -= k * length
    return used


@dataclass(frozen=True)
class Plan:
    """Rows of the plan, by length and first rank: copies in a bin, first sequence, offset of the first copy."""

    key: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


_SHIFT = 48


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    counts = {k: v for k, v in histogram.items() if v > 0}
    given = dict.fromkeys(counts, 0)
    rows, sequences = [], 0
    while counts:
        used = fullest(counts, capacity)
        times = min(counts[x] // k for x, k in used.items())
        offset = 0
        for length, k in sorted(used.items(), reverse=True):
            rows.append((length, given[length], k, sequences, offset))
            offset += k * length
            given[length] += k * times
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
        sequences += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return Plan((table[:, 0] << _SHIFT) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4], sequences)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these ranks among the pieces of their lengths."""
    at = np.searchsorted(plan.key, (length << _SHIFT) + rank, "right") - 1
    own = rank - plan.first[at]
    return plan.sequence[at] + own // plan.copies[at], plan.offset[at] + own % plan.copies[at] * length


def _numbered(capacity: int):
    """Rank of every row among the rows of its length in this partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "local_rank"])

    return run


def best_fit_packing(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece with its sequence and place."""
    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    pieces = cut_lineage(slim.mapInArrow(_pieces(tokenizer, capacity, end_id, id_col, text_col), PIECES))
    pieces = pieces.withColumn("part", F.spark_partition_id())
    per_part = pieces.groupBy("length", "part").count()
    plan = make_plan({r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.mapInArrow(_numbered(capacity), PIECES + ", part int, local_rank long").join(bases, ["length", "part"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(plan, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[c.split(" ")[0] for c in RESULT.split(", ")])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank")).mapInArrow(placed, RESULT)
