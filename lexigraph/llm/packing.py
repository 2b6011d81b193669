"""Pack token streams into training windows: bounded-space online packing.

A task reads its documents once and keeps a fixed number of open windows. A document's rest goes
whole into the fullest window that has room (best fit); when none has and no window may be
opened, the fullest is topped up by a cut, emitted and closed. What stays open at a task's end is
packed together; the last, unfilled window of each task goes, with its ids, to a merge of
``MERGE_TASKS`` tasks' leftovers at a time. A merge's own last window is cut at powers of two, so
no sequence is padded. Memory is bounded by the open windows and a batch of documents.

Defined results: null texts are empty and consist of the end token; rows are packed one by one,
so equal rows and equal ids give separate pieces; null ids are kept; an empty table gives no
pieces; extra columns are ignored. Every id of every row is in exactly one piece.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from operator import add
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, ship, stage

ship(__name__)

WINDOW = 4096
OPEN_WINDOWS = 32
END_ID = 2
MERGE_TASKS = 64
CACHE_WORDS = 1_500_000
#: Of a counter; its words have numbers only, but its query has little memory left beside the JVM's.
COUNTED_WORDS = 250_000
#: Longer words, such as lines of a script without spaces, are encoded each time they come.
KEPT_LENGTH = 64
#: Characters of text that are encoded together, and of those that pass the whole tokenizer at once.
PORTION = 4_000_000
WHOLE_PORTION = 100_000
#: Words by line: lower-case Latin letters that no normalisation changes, then punctuation; two empty groups for other words.
PLAIN = re.compile(r"^(?:([a-zß-öø-ɏ]+)([!-/:-@\[-`{-~]*)|.*)$", re.M)
#: Byte-level models have a visible character for every byte: its own, or for blanks and controls those from 256 on.
BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def symbols(run: str) -> str:
    """The characters that a byte-level model has for a run of letters."""
    return run if run.isascii() else run.encode().decode("latin-1").translate(BYTES)


class WordEncoder:
    """Ids of texts as little-endian bytes.

    The tokenizer drops white space and never merges across it, nor between a run of letters and
    a run of punctuation. So texts are split at ASCII white space, many at a time, their distinct
    words are looked up, and the words' ids are laid out as the words stand in the texts. A new
    word of Latin letters, with or without punctuation after it, is looked up by its lower-case
    letters; the tokenizer's model is given new letter runs directly, if the steps before it do to
    letters what ``symbols`` does. Other words, among them those with white space beyond ASCII, pass through the whole
    tokenizer.
    """

    most, nothing = CACHE_WORDS, b""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.words: dict = {}
        self.letters: dict = {}
        self.marks: dict = {"": self.nothing}
        single = [run for run, _ in PLAIN.findall("\n".join(map(chr, range(0x250))).lower()) if run]
        self.direct = all(self.before_model(x) == [symbols(x)] for x in [*single, "".join(single)])

    def before_model(self, run: str) -> list[str] | None:
        """What the tokenizer gives its model for a run; None if it has no pre-tokenizer."""
        first, second = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        return [x for x, _ in second.pre_tokenize_str(first.normalize_str(run) if first else run)] if second else None

    def whole(self, text: str) -> bytes:
        return self.wholes([text])[0]

    def wholes(self, texts: list[str]) -> list[bytes]:
        out = []
        for part in portions(texts, WHOLE_PORTION):
            found = self.tokenizer.encode_batch_fast(texts[part], add_special_tokens=False)
            out += [np.array(x.ids, "<u4").tobytes() for x in found]
        return out

    def pieces(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of lower-case letters, one piece each."""
        model, out = self.model.tokenize, []
        for run in runs:
            ids = [x.id for x in model(symbols(run))]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def learn(self, own: list[str]) -> None:
        if len(self.letters) > self.most:
            self.letters.clear()
        if len(self.marks) > self.most // 10:
            self.marks = {"": self.nothing}
        parts = PLAIN.findall("\n".join(own).lower()) if own else []  # no word has a line end
        plain = [i for i, (run, _) in enumerate(parts) if run and len(own[i]) <= KEPT_LENGTH]
        rest = [w for w, (run, _) in zip(own, parts) if not run or len(w) > KEPT_LENGTH]
        self.words.update(zip(rest, self.wholes(rest)))
        runs, marks = [parts[i][0] for i in plain], [parts[i][1] for i in plain]
        new = list(set(runs).difference(self.letters))
        self.letters.update(zip(new, (self.pieces if self.direct else self.wholes)(new)))
        new = list(set(marks).difference(self.marks))
        self.marks.update(zip(new, self.wholes(new)))
        ids = map(add, map(self.letters.__getitem__, runs), map(self.marks.__getitem__, marks))
        self.words.update(zip(map(own.__getitem__, plain), ids))

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list]:
        """Where the words of each text begin and end, which distinct word stands at each place, and what is known of the distinct words."""
        words = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.string()))
        flat = words.flatten().dictionary_encode()
        own = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > self.most:
            self.words.clear()
        found = list(map(self.words.get, own))
        fresh = [i for i, ids in enumerate(found) if ids is None]
        self.learn([own[i] for i in fresh])
        for i in fresh:
            found[i] = self.words[own[i]] if len(own[i]) <= KEPT_LENGTH else self.words.pop(own[i])
        return words.offsets.to_numpy(), flat.indices.to_numpy(), found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        offsets, place, found = self.look_up(texts)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[place])])
        at = np.repeat(starts[place] - ends[:-1], sizes[place])
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        cuts = (4 * ends[offsets]).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]


class WordCounter(WordEncoder):
    """How many ids texts have: a word's number of ids is kept in place of its ids."""

    most, nothing = COUNTED_WORDS, 0

    def wholes(self, texts: list[str]) -> list[int]:
        return [len(ids) // 4 for ids in super().wholes(texts)]

    def pieces(self, runs: list[str]) -> list[int]:
        return [len(self.model.tokenize(symbols(run))) for run in runs]

    def count(self, texts: list[str | None]) -> list[int]:
        offsets, place, found = self.look_up(texts)
        ends = np.concatenate([[0], np.cumsum(np.array(found, np.int64)[place])])
        return np.diff(ends[offsets]).tolist()


def portions(texts: list[str | None], most: int = PORTION) -> Iterator[slice]:
    """Slices of texts with about so many characters, or one text, each; all texts are in one."""
    at = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def encoder_for(vocabulary: str, kind: type = WordEncoder) -> WordEncoder:
    """The encoder, or counter, of this Python process, which keeps what it learned from one task to the next."""
    kept = sys.modules.setdefault("_lexigraph_encoders", types.ModuleType("_lexigraph_encoders")).__dict__
    if (key := f"{kind.__name__} {vocabulary}") not in kept:
        kept[key] = kind(vocabulary)
    return kept[key]


class Packer:
    """The open windows of one task. Emits (sequence, offset, piece) for full windows; a piece is (doc_id, start, length, doc_tokens, ids)."""

    def __init__(self, window: int = WINDOW, most: int = OPEN_WINDOWS):
        self.window, self.most = window, most
        self.free: list[tuple[int, int]] = []  # (room, key) of the open windows, sorted
        self.open: dict[int, list] = {}
        self.keys = 0

    def place(self, doc_id, ids: bytes) -> Iterator[list]:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:  # whole windows of a long document
            yield [(doc_id, at, self.window, total, ids[4 * at : 4 * (at + self.window)])]
            at += self.window
        while at < total:
            size = total - at
            fit = bisect_left(self.free, (size, -1))
            if fit < len(self.free):
                room, key = self.free.pop(fit)
            elif len(self.free) < self.most:
                self.keys += 1
                room, key = self.window, self.keys
                self.open[key] = []
            else:  # none fits: top up the fullest and emit it
                room, key = self.free.pop(0)
                size = room
            self.open[key].append((doc_id, at, size, total, ids[4 * at : 4 * (at + size)]))
            at += size
            if room == size:
                yield self.open.pop(key)
            else:
                insort(self.free, (room - size, key))

    def leftovers(self) -> list:
        """The pieces of the open windows, fullest window first."""
        return [piece for _, key in sorted(self.free) for piece in self.open[key]]


def refill(pieces: list, sizes: Iterator[int]) -> Iterator[list]:
    """Fill windows of the given sizes with the pieces in order, cut as needed; the last may be short."""
    size, window, room = next(sizes), [], None
    room = size
    for doc_id, start, length, total, ids in pieces:
        at = 0
        while at < length:
            part = min(room, length - at)
            window.append((doc_id, start + at, part, total, ids[4 * at : 4 * (at + part)]))
            at, room = at + part, room - part
            if not room:
                yield window
                window, room = [], next(sizes)
    if window:
        yield window


def window_sizes(total: int, window: int) -> Iterator[int]:
    """Full windows, then powers of two for the rest."""
    while total >= window:
        yield window
        total -= window
    for bit in reversed(range(window.bit_length())):
        if total >> bit & 1:
            yield 1 << bit
    while True:
        yield window


def rows_of(sequence: int, pieces: list, keep: bool = False) -> list[tuple]:
    out, offset = [], 0
    for doc_id, start, length, total, ids in pieces:
        out.append((doc_id, start, length, zlib.crc32(ids), total, sequence, offset, ids if keep else None))
        offset += length
    return out


def _frame(rows: list[tuple], task: int | None = None) -> pd.DataFrame:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    frame = pd.DataFrame(rows, columns=names)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    if task is None:
        return frame.drop(columns="ids")
    frame["task"] = task
    frame.loc[frame["ids"].notna(), "sequence_id"] = -1
    return frame


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """The pieces (see PIECE) of every row of docs (doc_id, text). vocabulary: a file that executors can read."""
    need(docs, "doc_id", "text")
    path = vocabulary or default_vocabulary()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        own = path if Path(path).exists() else default_vocabulary()
        encoder, packer, done = encoder_for(own), Packer(window, open_windows), 0
        end = np.array([END_ID], "<u4").tobytes()
        rows: list[tuple] = []
        for batch in batches:
            ids_of = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            texts = list(batch["text"])
            for part in portions(texts):
                for doc_id, ids in zip(ids_of[part], encoder.encode(texts[part])):
                    for full in packer.place(doc_id, ids + end):
                        rows += rows_of((task << 32) + done, full)
                        done += 1
            yield _frame(rows, task)
            rows = []
        left = packer.leftovers()
        total = sum(p[2] for p in left)
        for group in refill(left, window_sizes(total // window * window, window)):
            if sum(p[2] for p in group) == window:
                rows += rows_of((task << 32) + done, group)
                done += 1
            else:
                rows += rows_of(-1, group, keep=True)
        yield _frame(rows, task)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["task", "offset"], kind="stable")
        pieces = [(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), int(r.length), int(r.doc_tokens), r.ids) for r in rows.itertuples()]
        total, out = sum(p[2] for p in pieces), []
        for n, group in enumerate(refill(pieces, window_sizes(total, window))):
            out += rows_of((1 << 62) + (int(key[0]) << 32) + n, group)
        return _frame(out)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = stage(source.mapInPandas(first, f"{PIECE}, ids binary, task long"), "pieces")
    columns = [c.split()[0] for c in PIECE.split(", ")]
    full = packed.where("sequence_id >= 0").select(columns)
    rest = packed.where("sequence_id < 0").groupBy(F.floor(F.col("task") / MERGE_TASKS).alias("part")).applyInPandas(merge, PIECE)
    return full.unionAll(rest)
