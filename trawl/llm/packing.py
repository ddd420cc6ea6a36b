"""Packing documents into fixed windows by order-preserving dynamic programming.

Each partition is a run of documents in its order. Window cuts are chosen among
document ends, sentence ends and, inside long sentences, forced points, so that
padding plus truncation penalties is least:

    f(j) = min over i, T_j - T_i <= window, of f(i) + padding(T_j - T_i) + penalty(j)

As padding is ``window - T_j + T_i``, the best i is the least ``f(i) + T_i`` of a
sliding window, which a monotone queue gives in amortised constant time. Only
the tail of a partition is cut into powers of two, which need no padding; all
other windows are filled. Tokens are held for one block at a time, and cuts are
the best of a block; documents are never moved, and no shuffle is needed.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trawl.llm.common import in_batches

WINDOW = 2048
END_ID = 1
#: What a cut costs, in tokens of padding.
SENTENCE_CUT, FORCED_CUT = 8, 64
#: Candidates stand this many tokens apart at least, forced ones this many.
SPACING, FORCED_SPACING = 8, 256
#: Tokens that the dynamic programme sees at once, and bytes of text tokenised at once.
BLOCK_TOKENS, BLOCK_BYTES = 1 << 17, 2 << 20
#: Words and parts of words that a worker remembers: some 12 and 15 MB.
CACHE_WORDS, CACHE_PARTS = 400_000, 100_000

PIECE = T.StructType().add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add(
    "sequence_id", "long").add("offset", "long")


def _byte_letters() -> dict[int, int]:
    """The printable letter that byte-level BPE writes for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in kept)}


BYTE_LETTERS = _byte_letters()


class WordTokenizer:
    """Ids of a ``tokenizers`` file whose words do not depend on their neighbours across white space.

    Equals ``encode(text, add_special_tokens=False).ids``: the library tokenises
    every distinct white-space run once and results are put together by arrays.
    Texts with separators on which white-space definitions differ are encoded whole.
    """

    #: White space other than that of ASCII, and controls that some definitions count.
    UNUSUAL = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]"

    #: The pre-token pattern that the direct way knows.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PRE_TOKENS = regex.compile(PATTERN)

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Words that are known, and their ids, word after word.
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), np.empty(0, np.uint32), np.zeros(1, np.int32)
        self.letters: dict[str, bytes] = {}
        #: Whether the file is a lower-casing byte-level BPE with these pre-tokens, so that the model can be asked directly.
        spec = json.loads(self.whole.to_str())
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pattern = next((x["pattern"].get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if "pattern" in x), None)
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and pattern == self.PATTERN

    def _tokenized(self, words: list[str]) -> list[bytes]:
        """The ids of each word: the model on each pre-token of Latin-1 words, the whole tokenizer for others."""
        out, others = [b""] * len(words), []
        known, model, table, split = self.letters, self.whole.model.tokenize, BYTE_LETTERS, self.PRE_TOKENS.findall
        if len(known) > CACHE_PARTS:
            known.clear()
        for i, w in enumerate(words):
            if not self.plain or "<|" in w or not (w.isascii() or max(w) <= "\xff"):
                others.append(i)
                continue
            ids = b""
            for part in split(w.lower()):
                if (got := known.get(part)) is None:
                    letters = part if part.isascii() else part.encode().decode("latin-1").translate(table)
                    got = known[part] = array("I", [t.id for t in model(letters)]).tobytes()
                ids += got
            out[i] = ids
        for i in range(0, len(others), 4096):
            some = others[i : i + 4096]
            for at, e in zip(some, self.whole.encode_batch_fast([words[j] for j in some], add_special_tokens=False), strict=True):
                out[at] = array("I", e.ids).tobytes()
        return out

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of the distinct ``words`` is among the known ones; the missing are tokenised and added.

        All are flat arrays, some thirty bytes a word. Beyond ``CACHE_WORDS`` only these words stay.
        """
        found = pc.index_in(words, value_set=self.known)
        missing = words.filter(found.is_null())
        at = found.fill_null(0).to_numpy().astype(np.int64)
        if len(missing):
            if len(self.known) + len(missing) > CACHE_WORDS:
                stay = words.filter(found.is_valid())
                keep = at[found.is_valid().to_numpy(zero_copy_only=False)]
                sizes = self.ends[keep + 1] - self.ends[keep]
                ends = np.cumsum(sizes)
                self.ids = self.ids[np.repeat(self.ends[keep] - (ends - sizes), sizes) + np.arange(sizes.sum())]
                self.known, self.ends = stay, np.concatenate([[0], ends]).astype(np.int32)
                at[found.is_valid().to_numpy(zero_copy_only=False)] = np.arange(len(stay))
            at[found.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(missing))
            made = self._tokenized(missing.to_pylist())
            sizes = np.fromiter(map(len, made), np.int64, len(made)) >> 2
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)]).astype(np.int32)
            self.known = pa.concat_arrays([self.known, missing])
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets per text); null texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.UNUSUAL).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        split = pc.ascii_split_whitespace(plain)
        runs = pc.dictionary_encode(split.flatten())
        places = self._places(runs.dictionary)
        lists = pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.ids))
        chosen = lists.take(pa.array(places).take(runs.indices))
        ids = chosen.flatten().to_numpy()
        ends = np.asarray(chosen.offsets) - chosen.offsets[0].as_py()
        offsets = ends[np.asarray(split.offsets) - split.offsets[0].as_py()]
        if odd.any():
            pieces = np.split(ids, offsets[1:-1])
            for i in np.flatnonzero(odd):
                pieces[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, offsets = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids.astype(np.uint32, copy=False), offsets

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its text ends with a full stop, exclamation or question mark."""
        vocabulary = self.whole.get_vocab()
        out = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            out[i] = bool(re.search(r"[.!?]+(</w>)?$", token))
        return out


_LOADED: dict[str, tuple[WordTokenizer, np.ndarray]] = {}


def _loaded(path: str) -> tuple[WordTokenizer, np.ndarray]:
    if path not in _LOADED:
        tokenizer = WordTokenizer(path)
        _LOADED[path] = tokenizer, tokenizer.sentence_ends()
    return _LOADED[path]


def powers(n: int) -> list[int]:
    """``n`` as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def choose_cuts(ends: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """Indices of the chosen cuts among ``ends`` (rising; 0 precedes them; no gap over ``window``), the last included.

    Minimises padding plus the penalties of the cuts. The final cut is free of padding.
    """
    position, cost, origin, queue = [0, *ends], [0.0], [0], deque([0])
    keys = [0.0]
    last = len(ends)
    for j in range(1, last + 1):
        t = position[j]
        while position[queue[0]] < t - window:
            queue.popleft()
        if j == last:
            i = min(queue, key=cost.__getitem__)
            best = cost[i]
        else:
            i = queue[0]
            best = keys[i] + window - t
        best += penalties[j - 1]
        cost.append(best)
        origin.append(i)
        key = best + t
        keys.append(key)
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], last
    while j:
        out.append(j - 1)
        j = origin[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of the cuts worth considering; document ends cost nothing."""
    marks = np.flatnonzero(sentence[np.minimum(ids, len(sentence) - 1)]) + 1
    keep = np.ones(len(marks), bool)
    if len(marks):
        # The last sentence end of every SPACING tokens.
        keep[:-1] = marks[:-1] // SPACING != marks[1:] // SPACING
    stops = np.union1d(marks[keep], doc_ends)
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else np.empty(0, np.int64)
    step = min(FORCED_SPACING, window)
    extra = np.maximum(0, (stops - starts - 1) // step)
    inside = np.repeat(starts, extra) + step * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    positions = np.union1d(stops, inside)
    penalties = np.full(len(positions), FORCED_CUT)
    penalties[np.isin(positions, marks, assume_unique=True)] = SENTENCE_CUT
    penalties[np.isin(positions, doc_ends, assume_unique=True)] = 0
    return positions, penalties


class Packer:
    """Packs a stream of documents; ``add`` and ``finish`` return finished pieces (row, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, sentence: np.ndarray, window: int, first_sequence: int):
        self.sentence, self.window, self.sequence = sentence, window, first_sequence
        self.docs: list[list] = []  # row, ids, tokens of it already given out
        self.waiting = 0

    def add(self, row, ids: np.ndarray) -> list[tuple]:
        self.docs.append([row, ids, 0])
        self.waiting += len(ids)
        return self._pack(False) if self.waiting >= BLOCK_TOKENS else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.docs else []

    def _pack(self, final: bool) -> list[tuple]:
        rest = [d[1][d[2] :] for d in self.docs]
        ids = np.concatenate(rest)
        positions, penalties = candidates(ids, np.unique(np.cumsum([len(r) for r in rest])), self.sentence, self.window)
        chosen = choose_cuts(positions.tolist(), penalties.tolist(), self.window)
        cuts = positions[chosen].tolist()
        spans = list(zip([0, *cuts[:-1]], cuts, strict=True))
        if not final:
            # What follows may still change the last windows.
            spans = spans[:-2]
        elif (size := spans[-1][1] - spans[-1][0]) & (size - 1):
            begin = spans.pop()[0]
            for p in powers(size):
                spans.append((begin, begin + p))
                begin += p
        out, at, k = [], 0, 0
        for begin, end in spans:
            offset = 0
            while at < end:
                row, whole, done = self.docs[k]
                size = min(len(whole) - done, end - at)
                crc = zlib.crc32(whole[done : done + size].astype("<u4", copy=False).tobytes())
                out.append((row, done, size, crc, len(whole), self.sequence, offset))
                offset += size
                at += size
                self.docs[k][2] += size
                k += self.docs[k][2] == len(whole)
            self.sequence += 1
        del self.docs[:k]
        self.waiting -= at
        return out


def pack(df: DataFrame, tokenizer_path: str, text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the columns of ``df`` but its text, then start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids followed by ``end_id``; null texts count as empty
    and so are one token long. Every token lies in one piece, a sequence holds at
    most ``window`` tokens, and only sequences whose length is not a power of two
    are padded. Order is that of the rows in each partition, and sequences never
    span partitions: ``sequence_id`` is the partition's number times 2^33 plus a
    running number, so a task that is run again gives the same rows. Columns of
    ``df`` that carry one of the new names are dropped. An empty table gives no rows.
    """
    others = [c for c in df.columns if c != text_col and c.lower() not in {f.name for f in PIECE.fields}]
    schema = T.StructType([*df.select(*others).schema.fields, *PIECE.fields])
    names = schema.fieldNames()

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        sources: dict[int, int] = {}
        batches: list[pa.RecordBatch] = []
        take = []
        for (batch, i), *_ in pieces:
            if id(batch) not in sources:
                sources[id(batch)] = sum(b.num_rows for b in batches)
                batches.append(batch)
            take.append(sources[id(batch)] + i)
        table = pa.Table.from_batches(batches).take(pa.array(take, pa.int64()))
        columns = [table.column(c).combine_chunks() for c in others]
        columns += [pa.array(x, pa.int64()) for x in list(zip(*pieces, strict=True))[1:]]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, sentence = _loaded(tokenizer_path)
        packer = Packer(sentence, window, TaskContext.get().partitionId() << 33)
        for batch in batches:
            plain = batch.select(others) if others else pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows)], ["_"])
            texts = batch.column(text_col)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                limit = (sizes[begin - 1] if begin else 0) + BLOCK_BYTES
                end = max(begin + 1, int(np.searchsorted(sizes, limit, side="right")))
                ids, offsets = tokenizer.encode(texts.slice(begin, end - begin))
                ready = []
                for i in range(end - begin):
                    doc = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id))
                    ready += packer.add((plain, begin + i), doc)
                if ready:
                    yield rows(ready)
                begin = end
        if ready := packer.finish():
            yield rows(ready)

    return in_batches(df.select(*others, text_col), run, schema)
