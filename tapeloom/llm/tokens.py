"""Token ids of whole texts, word by word, from a table of known words that each Python worker keeps."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KNOWN_WORDS = 200_000  # kept in each Python worker, some 20 MB; the half that is used least goes when there are more
JOINED = 500  # words encoded in one call, which stay in a core's cache
MARKS = ".,;:!?"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PLAIN = f"^[{_LETTERS}]+[.,;:!?]?$"
_LOWER = "^[a-zªµºß-öø-ÿ]+$"

_loaded: dict[str, Words] = {}


class Tokens(NamedTuple):
    """Ids of texts one after the other."""

    ids: np.ndarray  # unsigned 32-bit
    word_end: np.ndarray  # where each word's ids end, behind a leading 0
    word: np.ndarray  # each word's row in ``distinct``
    distinct: pa.Array
    text_words: np.ndarray  # where each text's words begin and end

    @property
    def bounds(self) -> np.ndarray:
        """Where each text's ids begin and end."""
        return self.word_end[self.text_words]


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of given begins and sizes, one run after the other."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class Words:
    """Known words with their ids; row 0 is the empty word and the marks follow it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.normalizer = self.tok.normalizer
        self.words, self.pool, self.size = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)
        self._add(pa.array(["", *MARKS]))

    def _encoded(self, words: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        if not plain:
            self.tok.normalizer = self.normalizer
            got = [np.array(e.ids, "<u4") for e in self.tok.encode_batch(words.to_pylist(), add_special_tokens=False)]
            return np.concatenate(got), np.array([len(g) for g in got], np.int64)
        self.tok.normalizer = None  # lower-case letters are in normal form
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
        e = self.tok.encode(line[0].as_py(), add_special_tokens=False)
        return np.array(e.ids, "<u4"), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))

    def _add(self, words: pa.Array) -> np.ndarray:
        """The rows that the words get."""
        plain = pc.match_substring_regex(words, _LOWER)
        rows = np.empty(len(words), np.int64)
        rows[np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")] = len(self.words) + np.arange(len(words))
        for part, kind in ((words.filter(plain), True), (words.filter(pc.invert(plain)), False)):
            ids, sizes = [self.pool], [self.size]
            for at in range(0, len(part), JOINED):
                i, s = self._encoded(part.slice(at, JOINED), kind)
                ids.append(i)
                sizes.append(s)
            self.words = pa.concat_arrays([self.words, part])
            self.pool, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.words) - len(self.uses), np.int64)])
        self.begin = np.cumsum(self.size) - self.size
        return rows

    def _trim(self):
        """Keep the half used most, by counts that halve each time."""
        fixed = len(MARKS) + 1
        order = np.argsort(-self.uses[fixed:], kind="stable")[: KNOWN_WORDS // 2] + fixed
        keep = np.concatenate([np.arange(fixed), np.sort(order)])
        self.words = self.words.take(pa.array(keep))
        self.pool = self.pool[runs(self.begin[keep], self.size[keep])]
        self.size, self.uses = self.size[keep], self.uses[keep] // 2
        self.begin = np.cumsum(self.size) - self.size

    def rows(self, words: pa.Array, times: np.ndarray) -> np.ndarray:
        """The row of each of the distinct words, which occur so often."""
        if len(self.words) > KNOWN_WORDS:
            self._trim()
        found = pc.index_in(words, value_set=self.words)
        at = np.array(pc.fill_null(found, 0), np.int64)
        if found.null_count:
            at[found.is_null().to_numpy(zero_copy_only=False)] = self._add(words.filter(found.is_null()))
        self.uses[at] += times
        return at


def tokenized(texts: pa.Array, path: str) -> Tokens:
    """The ids of texts (null: empty).

    This kind of tokenizer ignores case, parts words at white space, which has no ids of its
    own, and parts letters from punctuation.  So a text's ids are those of its words in order,
    a word of letters and one mark those of the letters and of the mark, and only the words
    that a worker doesn't know are encoded.
    """
    if path not in _loaded:
        _loaded[path] = Words(path)
    known = _loaded[path]
    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    bounds = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    word, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    # distinct words are lower-case letters and a mark, or taken as they are
    plain = pc.match_substring_regex(distinct, _PLAIN)
    core = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(distinct, MARKS)), distinct).dictionary_encode()
    last = pc.index_in(pc.utf8_slice_codeunits(distinct, -1), value_set=pa.array(list(MARKS)))
    mark = pc.fill_null(pc.add(pc.if_else(plain, last, None), 1), 0).to_numpy(zero_copy_only=False)
    code = core.indices.to_numpy(zero_copy_only=False)
    times = np.bincount(code, np.bincount(word, minlength=len(distinct)), len(core.dictionary)).astype(np.int64)
    rows = np.stack([known.rows(core.dictionary, times)[code], mark], axis=1).reshape(-1)
    size = known.size[rows]
    pool = known.pool[runs(known.begin[rows], size)]
    size = size.reshape(-1, 2).sum(axis=1)
    begin = np.cumsum(size) - size
    many = size[word]
    end = np.concatenate([[0], np.cumsum(many)])
    return Tokens(pool[runs(begin[word], many)], end, word, distinct, bounds - bounds[0])


def parts(texts: pa.Array, room: int = 3 << 20) -> Iterator[pa.Array]:
    """Slices of texts of about ``room`` bytes, at least one text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, before + room, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def slices(batch: pa.RecordBatch, room: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``room`` bytes of text, at least one row each."""
    at = 0
    for part in parts(batch.column("text"), room):
        yield batch.slice(at, len(part))
        at += len(part)
