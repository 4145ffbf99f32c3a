"""Token ids by a public vocabulary, with a memory of words that lives as long as its Python worker.

Where a vocabulary's normaliser and splitter never look across white space (WORDWISE), the ids of a
text are those of its words in order: Arrow cuts a run of texts into words and numbers the distinct
ones, the library encodes a word once a worker, and all else is array look-ups. Words of letters are
encoded many at a time and told apart by the vocabulary's mark for the end of a word. A text that
holds a special token's string, and every text of another kind of vocabulary, goes to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.common import gather

#: The id that ends a document.
END = 1
#: Words that a worker remembers, words that are encoded as one text, and bytes of text encoded at once.
REMEMBERED, TOGETHER, RUN = 1_000_000, 500, 4 << 20
#: Words of letters, with ASCII symbols behind them or none: the splitter cuts between the two. The letters are
#: Latin, Greek, Cyrillic, Kana and Han ones that stay one letter when normalised and lower-cased (U+0130 does not).
LETTERS = r"[A-Za-zÀ-ÖØ-öø-\x{12F}\x{131}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{481}\x{48A}-\x{52F}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}]"
LETTERS_SYMBOLS = rf"^(?P<letters>{LETTERS}+)(?P<symbols>[!-/:-@\[-`{{-~]*)$"
#: Normaliser and splitter of a vocabulary whose words can be encoded one by one: fixed values of the public file.
WORDWISE = (
    ["NFC", "Replace", "Lowercase"],
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)

_codecs: dict[str, WordCodec] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _wordwise(spec: dict) -> bool:
    normal, split = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    return (kinds, (split[0].get("pattern") or {}).get("Regex")) == WORDWISE and split[0].get("behavior") == "Removed" and split[0].get("invert") is True


class WordCodec(dict):
    """Word (bytes) -> place in `ids`, packed one after the other; place 0 is the end of a document."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.codec = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.wordwise = _wordwise(spec)
        vocabulary = self.codec.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(spec["model"].get("end_of_word_suffix") or "\0")]] = True
        self.clear()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.codec.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        super().clear()
        self.ids = np.full(1 << 16, END, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)  # begin[k + 1] is where word k ends
        self.begin[1], self.count = 1, 1
        self[b""] = self.count
        self.begin[2], self.count = 1, 2

    def learn(self, words: pa.Array) -> None:
        """Remembers words that are not known yet: letters with symbols behind them from both parts."""
        parts = pc.extract_regex(words, LETTERS_SYMBOLS)
        plain = pc.is_valid(parts)
        letters, symbols = pc.struct_field(parts.filter(plain), "letters"), pc.struct_field(parts.filter(plain), "symbols")
        need = pc.unique(pa.concat_arrays([letters, symbols])).cast(pa.large_binary()).to_pylist()
        need = [w for w in need if w and w not in self]
        for lo in range(0, len(need), TOGETHER):
            self._single(need[lo : lo + TOGETHER])
        self._each([w for w in words.filter(pc.invert(plain)).cast(pa.large_binary()).to_pylist() if w not in self])
        two = pc.not_equal(symbols, "")
        pair = [x.filter(two).cast(pa.large_binary()).to_pylist() for x in (letters, symbols)]
        if pair[0]:
            at = np.array([[*map(self.__getitem__, x)] for x in pair], np.int64).T.ravel()
            size = self.begin[at + 1] - self.begin[at]
            self._add([a + b for a, b in zip(*pair, strict=True)], self.ids[gather(self.begin[at], size)], size[::2] + size[1::2])

    def _single(self, words: list[bytes]) -> None:
        """Words that the splitter leaves whole: each has one id that ends a word, its last."""
        own = np.array(self._plain([b" ".join(words).decode()])[0], np.uint32)
        ends = np.flatnonzero(self.ends_word[own]) + 1
        if len(ends) == len(words):
            self._add(words, own, np.diff(np.r_[0, ends]))
        else:
            self._each(words)

    def _each(self, words: list[bytes]) -> None:
        if words:
            each = self._plain([w.decode() for w in words])
            self._add(words, np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each]))

    def _add(self, words: list[bytes], ids: np.ndarray, per: np.ndarray) -> None:
        first, need = int(self.begin[self.count]), len(ids)
        while first + need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.count + len(words) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.ids[first : first + need] = ids
        self.begin[self.count + 1 : self.count + 1 + len(words)] = first + np.cumsum(per)
        self.update(zip(words, range(self.count, self.count + len(words)), strict=True))
        self.count += len(words)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each): every text ends with END; a null text is empty."""
        # a copy of its own: Arrow's ascii_lower reads the wrong bytes of a slice
        column = pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")
        low = pc.ascii_lower(column) if self.wordwise else column
        whole = np.zeros(len(column), bool)
        for s in self.special if self.wordwise else ():
            whole |= pc.match_substring(low, s.lower()).to_numpy(zero_copy_only=False)
        if not self.wordwise or whole.any():
            own = [np.array([*x, END], np.uint32) for x in self._plain(column.filter(pa.array(whole)).to_pylist() if self.wordwise else column.to_pylist())]
            if not self.wordwise or whole.all():
                return np.concatenate([np.empty(0, np.uint32), *own]), np.fromiter(map(len, own), np.int64, len(own))
            ids, n = self._by_word(low.filter(pa.array(~whole)))
            rest, ends = iter(own), np.cumsum(n)
            parts = iter(zip((ends - n).tolist(), ends.tolist(), strict=True))
            out = [next(rest) if w else ids[slice(*next(parts))] for w in whole.tolist()]
            return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))
        return self._by_word(low)

    def _by_word(self, low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(low):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        split = pc.ascii_split_whitespace(low)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        place = [*map(self.get, words)]
        if None in place:
            new = [i for i, p in enumerate(place) if p is None]
            if self.count + 3 * len(new) > REMEMBERED:  # a word may bring two parts
                self.clear()
                new = range(len(words))
            self.learn(coded.dictionary.take(pa.array(new, pa.int64())))
            for i in new:
                place[i] = self[words[i]]
        k = np.array(place, np.int64)[coded.indices.to_numpy()]
        of_text = np.diff(split.offsets.to_numpy())
        ends = np.cumsum(of_text)
        k = np.insert(k, ends, 0)  # a text's end is a word of its own
        per = self.begin[k + 1] - self.begin[k]
        after = np.cumsum(per)
        ids = self.ids[np.repeat(self.begin[k] - (after - per), per) + np.arange(after[-1])]
        n = np.diff(np.r_[0, after[ends + np.arange(len(ends))]])
        return ids, n


def forget(own: WordCodec) -> None:
    """What is left for the next task: not more than a part of what may be remembered."""
    if own.count > REMEMBERED // 2:
        own.clear()


def codec(path: str) -> WordCodec:
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a column of texts, of RUN bytes or one text each at least."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False), nan=0.0).astype(np.int64) + 16)
    cuts = [0, *(np.flatnonzero(np.diff(size // RUN)) + 1).tolist(), len(column)]
    yield from ((a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)
