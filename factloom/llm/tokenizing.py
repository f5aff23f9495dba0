"""Token ids of whole texts by the ``tokenizers`` library, with its answers for words kept.

The library splits a text in pre-tokens and encodes each alone, so a text's ids
are its pre-tokens' ids in a row. Splitting here and asking the library
for each piece once is several times as fast as asking for each text. Texts with
characters for which Python's classes could differ from the library's, or with the string of
a special token, are given to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import cached_property

import numpy as np

from factloom.llm.common import kept_in_process

#: The white space of Unicode, as the library's patterns see it.
_SPACE = "\\t-\\r \\x85\\xa0"
#: Beyond these (ASCII without its four odd separators, and Latin letters whose classes and cases are plain) a text goes to the library whole.
_ODD = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0131-\\u017f]")


def _written_out(one: str) -> str:
    """The set of those plain characters that a pattern for one of them matches; Python finds a character in a set of listed ones sooner than in classes."""
    return "[" + "".join(re.escape(c) for c in map(chr, range(0x180)) if not _ODD.search(c) and re.fullmatch(one, c)) + "]"


_LETTER, _DIGIT, _OTHER = _written_out(r"[^\W\d_]"), _written_out(r"\d"), _written_out(rf"[^{_SPACE}\w]|_")
#: The pre-token patterns of the two vocabularies, which their files state, within the characters above; letters come first, as most pieces are words.
_BYTE_LEVEL = re.compile(rf" ?{_LETTER}+|'s|'t|'re|'ve|'m|'ll|'d| ?{_DIGIT}+| ?{_OTHER}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD_END = re.compile(rf"{_LETTER}+|'s|'t|'re|'ve|'m|'ll|'d|{_DIGIT}|{_OTHER}+")
#: Pieces kept by a process, about 170 MB; beyond them it forgets the later half, as frequent pieces come early.
MOST_PIECES = 600_000
PIECES_A_CALL = 1000
#: Characters of text that are split at a time.
CHARS_A_TIME = 1_000_000

_made: dict[tuple[str, bool], "WordCachedTokenizer"] = {}
kept_in_process.append(_made)


class _Kept(dict):
    """Pieces and the bytes of their ids. One that isn't kept is noted in ``new`` with an empty array, which stands for its bytes until they are known."""

    def __init__(self):
        super().__init__()
        self.new: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytearray:
        if word not in self.new:
            self.new[word] = bytearray()
        return self.new[word]


class WordCachedTokenizer:
    def __init__(self, path: str, special_as_text: bool = False):
        """``special_as_text``: a special token's string in a text is ordinary text; by default it is that token, as the library has it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's other tasks have the other cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.special_as_text = path, special_as_text
        self.pieces = Tokenizer.from_file(path)
        self.pieces.encode_special_tokens = True
        special = [] if special_as_text else [t.content for t in self.pieces.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        if self.pieces.normalizer is None and isinstance(self.pieces.pre_tokenizer, pre_tokenizers.ByteLevel):
            self.split, self.fold = _BYTE_LEVEL.findall, None
        elif "Lowercase" in repr(self.pieces.normalizer) and isinstance(self.pieces.pre_tokenizer, pre_tokenizers.Sequence):
            self.split, self.fold = _WORD_END.findall, str.lower
        else:
            self.split = None
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.size = self.pieces.get_vocab_size(with_added_tokens=True)
        vocabulary = self.pieces.get_vocab(with_added_tokens=True)
        suffix = getattr(self.pieces.model, "end_of_word_suffix", None) or ""
        #: How many bytes a token stands for, by its id: a byte-level vocabulary writes each byte as a character.
        self.n_bytes = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        for token, k in vocabulary.items():
            self.n_bytes[k] = len(token.removesuffix(suffix))
        self.kept = _Kept()

    @cached_property
    def whole(self):
        """The library's tokenizer as its file has it, loaded when the first odd text comes; most tables have none."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = self.special_as_text
        return found

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), PIECES_A_CALL):
            some = new[i:i + PIECES_A_CALL]
            # the fast call doesn't say whose a token is; bytes do
            ids = np.array(self.pieces.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            read, wanted = np.cumsum(self.n_bytes[ids]), np.cumsum([len(w.encode()) for w in some])
            ends = np.searchsorted(read, wanted) + 1
            if ends[-1] != len(ids) or (read[ends - 1] != wanted).any():  # not each byte has a token
                e = self.pieces.encode(some, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(e.ids, "<u4")
                ends = np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
            whole, start = ids.tobytes(), 0
            for word, end in zip(some, (ends * 4).tolist()):
                self.kept[word] = whole[start:end]
                start = end

    def ids(self, text: str) -> np.ndarray:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        return np.frombuffer(self.many([text])[0], "<u4")

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _some(self, texts: list[str]) -> list[bytes]:
        kept = self.kept
        kept.new = new = {}
        found: list[list | None] = []
        for x in texts:  # a text's pieces are looked up at once, while they are near
            odd = self.split is None or _ODD.search(x) or self.special is not None and self.special.search(x)
            found.append(None if odd else list(map(kept.__getitem__, self.split(self.fold(x) if self.fold else x))))
        if new:
            if len(kept) + len(new) > MOST_PIECES:
                for w in list(kept)[MOST_PIECES // 2:]:
                    del kept[w]
            self._learn(list(new))
            for w, ids in new.items():
                ids += kept[w]
            kept.new = {}
        return [self._whole(x) if parts is None else b"".join(parts) for x, parts in zip(texts, found)]

    def many(self, texts: Iterable[str | None]) -> list[bytes]:
        """The bytes of the ids (little-endian, 32 bits) of several texts, a null as an empty one."""
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for t in texts:
            some.append(t or "")
            size += len(t or "")
            if size >= CHARS_A_TIME:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some) if some else out


def tokenizer(path: str, special_as_text: bool = False) -> WordCachedTokenizer:
    """One for each file in a process, so that a worker's later tasks find its words."""
    if (path, special_as_text) not in _made:
        _made[path, special_as_text] = WordCachedTokenizer(path, special_as_text)
    return _made[path, special_as_text]
