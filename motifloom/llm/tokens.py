"""Token ids of texts, by the tokenizers library, with the ids of frequent words kept."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Words whose ids a Python worker keeps, besides as many former ones (about 50 MB in all); beyond that it starts anew.
KEPT_WORDS = 120_000
#: Characters of the longest word that is kept, so that unbroken texts do not stay in memory.
KEPT_CHARS = 64

# Fixed values of the word tokenizer's own pre-tokenizer, for texts of these characters only.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, others from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordTokenizer:
    """Encodes as tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False) does.

    For a lower-casing BPE vocabulary with word ends, a text's ids are those of its words in turn,
    so each word goes to the library once and its ids are kept. Texts of plain Latin characters are
    cut into words by the vocabulary's own pattern; others are cut at blanks, and the library cuts
    and normalises what lies between. A text that may hold a special token goes to the library
    whole, as does every text if the vocabulary is of another kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        self._model = self._t.model
        self._letters = _byte_letters()
        self._plain: dict[str, bytes] = {}
        self._former: dict[str, bytes] = {}
        self._other: dict[str, bytes] = {}
        self.splits = getattr(self._model, "end_of_word_suffix", None) == "</w>" and "Lowercase" in repr(self._t.normalizer)
        self.width = 2 if self._t.get_vocab_size() <= 1 << 16 else 4

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self._t.encode_batch(texts, add_special_tokens=False)]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; none for null or empty texts."""
        if not text:
            return b""
        if not self.splits or "<|" in text:
            return self._library([text])[0]
        if _PLAIN.search(text):
            return self._by_blanks(text)
        kept, words = self._plain, _WORD.findall(text.lower())
        try:
            return b"".join(map(kept.__getitem__, words))
        except KeyError:
            pass
        if len(kept) > KEPT_WORDS:  # start anew; what is still met comes over from the former words
            self._former, self._plain = kept, {}
            kept = self._plain
        long: dict[str, bytes] = {}
        for w in set(words).difference(kept):
            if w in self._former:
                kept[w] = self._former[w]
                continue
            spelt = w if w.isascii() else "".join(map(self._letters.__getitem__, w.encode()))
            (kept if len(w) <= KEPT_CHARS else long)[w] = np.asarray([x.id for x in self._model.tokenize(spelt)], "<u4").tobytes()
        return b"".join([long[w] if w in long else kept[w] for w in words])

    def _by_blanks(self, text: str) -> bytes:
        kept, words = self._other, [w for w in re.split("[ \t\r\n]+", text) if w]
        if len(kept) > KEPT_WORDS // 2:
            kept.clear()
        new = list(set(words).difference(kept))
        found = dict(zip(new, self._library(new), strict=True))
        kept.update((w, ids) for w, ids in found.items() if len(w) <= KEPT_CHARS)
        return b"".join([found[w] if w in found else kept[w] for w in words])


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's own tokenizer for path, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def rows(batches: Iterator, *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, a few hundred at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*[part.column(n).to_pylist() for n in names], strict=True)


def batched(items: Iterator[tuple], schema, size: int = 4096) -> Iterator:
    """Tuples as Arrow batches of the schema."""
    import pyarrow as pa

    held: list[tuple] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for x in items:
        held.append(x)
        if len(held) >= size:
            yield make()
            held = []
    if held:
        yield make()
