"""Tokenisation with a public vocabulary file, memoised by word.

The word vocabulary splits a text at white space, between letters and marks, and around every digit before its
merges, so the ids of a text are the ids of these units in a row. A worker therefore encodes each new unit once
and joins the remembered ids. Texts with characters for which this argument would need a closer look at Unicode
(anything outside printable Latin-1, and texts holding a special token's string) are encoded whole; so are all
texts if the vocabulary splits otherwise.
"""
from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

# Vocabulary that the packing and the id files use by default.
VOCABULARY = "word_bpe_49k.json"

# Latin-1 characters whose white space, letters and normal form every Unicode version treats alike.
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])

_LOWER = bytes(ord(chr(c).lower()) for c in range(256))
_SPACE, _LETTER, _MARK, _DIGIT, _CLINGS = range(5)


def _kind(c: int) -> int:
    """What a (lower-case) character is to the splitting. Words with a clinging one (an apostrophe, which starts
    contractions, or any other character) stay whole."""
    if c in b"\t\n\r ":
        return _SPACE
    if unicodedata.category(chr(c)) == "Ll":
        return _LETTER
    if chr(c) in "0123456789":
        return _DIGIT
    return _MARK if 0x20 < c < 0x7F and chr(c) != "'" else _CLINGS


_KIND = bytes(_kind(c) for c in range(256))
# Texts looked at together.
_AT_ONCE = 2048

# Candidates for a separator word: it must be one id that no Latin-1 word can contain.
_SEPARATORS = "的一是不我の는中❤♥★☀✨😂😍"

# A text and its units, to see whether a vocabulary splits as described above.
_PROBE = ("Quick-brown (FOX), a1b22c.d_e; \u00c9l\u00e8ve--Stra\u00dfe/x=9",
          "quick - brown ( fox ), a 1 b 2 2 c . d _ e ; \u00e9l\u00e8ve -- stra\u00dfe / x = 9")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file on the machine that calls it."""
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts as little-endian byte strings (``dtype`` holds their width).

    ``memo_entries`` bounds the remembered words; a full memo is emptied.
    """

    def __init__(self, path: str | None = None, memo_entries: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path or vocabulary_path())
        vocab = self.tok.get_vocab()
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends_word = np.zeros(self.size, dtype=bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")
        self.light = self._light_tokenizer()
        # Of special tokens in lower case, as texts are searched; others than Latin-1 cannot be in a plain text.
        specials = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.specials = [t.encode("latin-1") for t in specials if max(t, default="") <= "\xff"]
        self.separator = self.separator_id = None
        whole, split = (self.tok.encode(" ".join(t.split()), add_special_tokens=False).ids for t in _PROBE)
        for ch in _SEPARATORS if whole == split else "":
            ids = self.tok.encode(ch, add_special_tokens=False).ids
            if len(ids) == 1:
                self.separator, self.separator_id = ch, ids[0]
                break
        self.memo: dict[bytes, bytes] = {}
        self.memo_entries = memo_entries

    def _light_tokenizer(self):
        """The tokenizer without the steps that lower-case words of letters do not need, if it then agrees with itself."""
        from tokenizers import Tokenizer, pre_tokenizers
        light = Tokenizer.from_str(self.tok.to_str())
        light.normalizer = None
        light.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "the quick brown fox jumps over straße élève año über antidisestablishmentarianism ß q"
        ids = [t.encode(probe, add_special_tokens=False).ids for t in (self.tok, light)]
        return light if ids[0] == ids[1] else self.tok

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in encoded]

    def _plain(self, text: str) -> bytes | None:
        """The text in lower-case Latin-1 if its units can be encoded one by one."""
        if self.separator is None:
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if raw.translate(None, _PLAIN):
            return None
        raw = raw.translate(_LOWER)
        return None if any(s in raw for s in self.specials) else raw

    def _learn(self, units: list[bytes]) -> None:
        """Remember new units."""
        stems, others = [], []
        for w in units:
            word = w.decode("latin-1")
            (stems if word.isalpha() else others).append(word)
        self._encode_stems(stems)
        self._encode_others(others)

    def _encode_stems(self, stems: list[str]) -> None:
        """A word of letters only is one word of the vocabulary: it ends at the end-of-word id."""
        width = self.dtype.itemsize
        for group in _groups(stems, 4000):
            raw = np.array(self.light.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()
            stops = np.flatnonzero(self.ends_word[np.frombuffer(raw, self.dtype)]) + 1
            if len(stops) != len(group):
                raise ValueError("the vocabulary does not split texts at white space")
            start = 0
            for word, stop in zip(group, (stops * width).tolist(), strict=True):
                self.memo[word.encode("latin-1")] = raw[start:stop]
                start = stop

    def _encode_others(self, words: list[str]) -> None:
        width, gap = self.dtype.itemsize, f" {self.separator} "
        for group in _groups(words, 4000):
            raw = self._whole([gap.join(group)])[0]
            cuts = (np.flatnonzero(np.frombuffer(raw, self.dtype) == self.separator_id) * width).tolist()
            if len(cuts) != len(group) - 1:
                raise ValueError("the separator word is not unique")
            start = 0
            for word, cut in zip(group, [*cuts, len(raw)], strict=True):
                self.memo[word.encode("latin-1")] = raw[start:cut]
                start = cut + width

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (None: empty), as bytes of ``dtype``."""
        out: list[bytes] = []
        for some in _groups(texts, _AT_ONCE):
            out += self._ids([t or "" for t in some])
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        words, firsts = _units([b"" if raw is None else raw for raw in plain])
        # Units as numbers of distinct units: only the distinct ones become Python values.
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.memo.get, distinct))
        new = [w for w, ids in zip(distinct, found, strict=True) if ids is None]
        if new:
            if len(self.memo) + len(new) > self.memo_entries:
                self.memo.clear()
            self._learn(new)
            found = [self.memo[w] if ids is None else ids for w, ids in zip(distinct, found, strict=True)]
        joined = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, data = joined.buffers()
        raw = data.to_pybytes() if data is not None else b""
        cuts = np.frombuffer(ends, np.int64)[firsts].tolist() if len(joined) else [0] * len(firsts)
        return [raw[cuts[k]:cuts[k + 1]] if p is not None else self._whole([texts[k]])[0] for k, p in enumerate(plain)]


def _units(raws: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Units of lower-case Latin-1 texts in a row, and the number of units before each text (and all of them)."""
    joined = b" ".join(raws)
    kind = np.frombuffer(joined.translate(_KIND), np.uint8)
    before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)[:len(kind)]
    inside = kind != _SPACE
    starts = inside & (before == _SPACE)
    words = np.flatnonzero(starts)
    if len(words):
        whole = np.maximum.reduceat(kind, words) == _CLINGS
        cuts = np.flatnonzero(inside & (before != _SPACE) & ((kind != before) | (kind == _DIGIT)))
        cuts = cuts[~whole[np.searchsorted(words, cuts, side="right") - 1]]
        starts[cuts] = True
    at = np.flatnonzero(starts)
    data = np.frombuffer(joined, np.uint8)[inside]
    offsets = np.append(np.cumsum(inside)[at] - 1, len(data)).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    begins = np.cumsum([0, *(len(raw) + 1 for raw in raws)])
    return units, np.searchsorted(at, begins)


def _groups(items: list, size: int):
    for k in range(0, len(items), size):
        yield items[k:k + size]


def worker_tokenizer(vocabulary: str | None) -> WordTokenizer:
    """One tokenizer per Python worker and vocabulary (workers are reused between tasks)."""
    key = vocabulary or VOCABULARY
    if key not in _WORKER:
        path = key if os.path.isabs(key) else vocabulary_path(key)
        _WORKER[key] = WordTokenizer(path)
    return _WORKER[key]


_WORKER: dict[str, WordTokenizer] = {}
