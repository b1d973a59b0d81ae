"""Tokenizers in the workers: loaded once a process, each different piece encoded once."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words, ragged, strings

# A process keeps the result of so many different pieces; later ones are encoded anew.
CACHED_PIECES = 1_000_000
# It forgets its different words once it has more of them.
CACHED_WORDS = 1_000_000

# Not white space to every library, or not in every version: not taken as the start of a piece.
UNSURE = "\u180e\u200b\ufeff"


@functools.lru_cache(maxsize=4)
def load(path: str):
    """A tokenizers tokenizer; special strings in texts stay special (its default)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Letters of every Unicode version that stay one letter in lower case (U+0130 does not: its
# dot becomes a mark of its own).
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
# Such letters, then ASCII marks: split patterns that tell letters from other marks always
# cut between them.
LETTERS_MARKS = re.compile(rf"( ?[{LETTERS}]+)([!-/:-@\[-`{{-~]+)")
LETTER_MARK = rf"([{LETTERS}])([!-/:-@\[-`{{-~])"
ONLY_LETTERS = re.compile(rf"[{LETTERS}]+")
# So many words of letters are encoded as one text.
JOINED = 64
# Words whose lower case is that of every library, character by character.
PLAIN = re.compile(rf"[!-~{LETTERS}]+")


class Known:
    """What pieces encode to. A piece of letters and marks is put together from the two."""

    def __init__(self, encode):
        self.encode = encode
        self.known: dict = {}

    def __call__(self, pieces: list[str]) -> list:
        known = self.known
        missing = [p for p in pieces if p not in known]
        parts = []
        for piece in missing:
            cut = LETTERS_MARKS.fullmatch(piece)
            parts.append(cut.groups() if cut else (piece,))
        new = list({x for group in parts for x in group if x not in known})
        found = dict(zip(new, self.encode(new), strict=True))
        kept = len(known) < CACHED_PIECES
        if kept:
            known.update(found)
        of = (lambda x: known[x]) if kept else (lambda x: found[x] if x in found else known[x])
        made = {p: of(x[0]) if len(x) == 1 else of(x[0]) + of(x[1]) for p, x in zip(missing, parts, strict=True)}
        if kept:
            known.update(made)
            return [known[p] for p in pieces]
        return [made[p] if p in made else known[p] for p in pieces]


class Growing:
    """Numbers that are appended to, without a copy of all each time."""

    def __init__(self, kind: type):
        self.size, self.held = 0, np.empty(1 << 16, dtype=kind)

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.held):
            grown = np.empty(2 * (self.size + len(values)), dtype=self.held.dtype)
            grown[: self.size] = self.held[: self.size]
            self.held = grown
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)


def cuts_before_blanks(made: dict) -> bool:
    """Whether a tokenizer is byte-level with the usual split pattern, nothing before it, and no blank in an added token."""
    split = made.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    plain = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in made.get("added_tokens") or [])
    return bool(usual) and made.get("normalizer") is None and plain


class PieceCounts:
    """Token counts of whole texts under a byte-level BPE whose words take one blank before them.

    A text is cut before every blank that is followed by anything but white space. The
    split pattern of such tokenizers always has a boundary there: a word, number or
    symbol run ends before white space, and a run of white space leaves its last blank
    to what follows. Merges never cross a boundary and special strings hold no blank,
    so the counts of the pieces add up. A text with any other blank goes to the
    library whole, and so do all texts under a tokenizer of another make.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known = Known(self._encode)
        self.cuts = cuts_before_blanks(json.loads(self.tokenizer.to_str()))

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        return np.array(self.known(pieces), dtype=np.int64)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        if not len(texts):
            return np.zeros(0, dtype=np.int64)
        texts = strings(texts)
        if not self.cuts:
            return np.array(self._encode(texts.to_pylist()), dtype=np.int64)
        parts = pc.split_pattern(texts, pattern=" ")
        bounds = np.asarray(parts.offsets, dtype=np.int64)
        values = parts.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        encoded = values.dictionary_encode()
        codes, distinct = np.asarray(encoded.indices), encoded.dictionary.to_pylist()
        sure = np.array([bool(p) and not (p[0].isspace() or p[0] in UNSURE) for p in distinct], dtype=bool)
        first = np.zeros(len(codes), dtype=bool)
        first[bounds[:-1]] = True
        # Only pieces that stand after a blank need to begin without white space.
        whole = np.add.reduceat((~sure[codes] & ~first).astype(np.int64), bounds[:-1]) > 0
        later = np.zeros(len(distinct), dtype=bool)
        later[codes[~first]] = True
        counts = np.zeros(len(distinct), dtype=np.int64)
        wanted = np.flatnonzero(later & sure)
        counts[wanted] = self._pieces([" " + distinct[i] for i in wanted])
        each = np.where(first, 0, counts[codes])
        sums = np.add.reduceat(each, bounds[:-1])
        sums += self._pieces([distinct[i] for i in codes[bounds[:-1]]])
        for row in np.flatnonzero(whole):
            sums[row] = self._encode([texts[int(row)].as_py()])[0]
        return sums


class WordIds:
    """Token ids of whole texts under a tokenizer that drops white space.

    Its normalizer and split pattern treat what stands between ASCII white space apart:
    no word holds white space, blanks do not compose with marks, lower-casing looks at
    single characters, and special strings hold no blank. So the ids of a text are
    those of its words `[^\\x20\\x09-\\x0D]+`, one after the other.

    Words are numbers here: the ids of all different ones lie end to end, and a text is
    put together from them by position, without a Python object an occurrence.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        spelt = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        # Whether an id ends a word, where the tokenizer says so.
        self.ends = np.array([t.endswith(suffix) for t in spelt]) if suffix else None
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.starts, self.lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode new words, those that have the same lower case once."""
        plain = [w if w.isascii() or not PLAIN.fullmatch(w) else w.lower() for w in words]
        new = [w for w in dict.fromkeys(plain) if w not in self.words]
        single, joined = [], []
        for word in new:
            (joined if self.ends is not None and ONLY_LETTERS.fullmatch(word) else single).append(word)
        first = self.starts.size
        ids, lengths = self._encode_joined(joined)
        if len(lengths) != len(joined):  # a tokenizer that takes letters apart
            single, joined = single + joined, []
        else:
            self._append(ids, lengths)
        self._append(*self._flat(single))
        new = joined + single
        self.words.update(zip(new, range(first, first + len(new)), strict=True))
        self.words.update((w, self.words[p]) for w, p in zip(words, plain, strict=True) if w is not p)

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts.add(np.cumsum(lengths) - lengths + self.ids.size)
        self.lengths.add(lengths)
        self.ids.add(ids)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts end to end, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(lengths.sum()))
        return ids, lengths

    def _encode_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`_flat` of words of letters: many in one text, told apart by the ids that end a word."""
        ids, _ = self._flat([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1) if words else np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, and the bounds of each text in it."""
        if len(self.words) > CACHED_WORDS:
            self._forget()
        texts = strings(texts)
        # Fewer different words: lower case, and marks cut off, but in texts that may hold special strings.
        cut = pc.replace_substring_regex(texts, pattern=LETTER_MARK, replacement=r"\1 \2")
        words = Words(pc.if_else(pc.match_substring(texts, pattern="<|"), texts, pc.ascii_lower(cut)))
        distinct, known = words.distinct.to_pylist(), self.words
        # An empty word stands for the ends of texts and is never taken.
        self._learn([w for w in distinct if w and w not in known])
        places = np.fromiter((known[w] if w else 0 for w in distinct), dtype=np.int64, count=len(distinct))
        entries = places[words.codes]
        lengths = self.lengths.held[entries]
        ids = self.ids.held[ragged(self.starts.held[entries], lengths)]
        return ids, np.concatenate(([0], np.cumsum(lengths)))[words.rows]
