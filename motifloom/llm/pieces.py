"""SentencePiece BPE encoding by a merge-type prefix table, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from motifloom.llm.common import columns_of
from motifloom.llm.tokens import KEPT_CHARS, batched, rows

#: Words whose pieces a Python worker keeps, besides as many former ones (about 200 MB in all), and pairs whose compatibility it keeps.
KEPT_WORDS, KEPT_PAIRS = 400_000, 600_000
_BLANK, _LETTER, _SIGNS = "▁", "[A-Za-zÀ-ÖØ-öø-ÿ]", ".,;:!?|"


class _Singles(dict):
    """The number of a character's own piece, or for a character without one, its code point beyond `none`."""

    def __init__(self, ids: dict[str, int], none: int):
        super().__init__((p, i) for p, i in ids.items() if len(p) == 1)
        self._none = none

    def __missing__(self, char: str) -> int:
        return self._none + 1 + ord(char)


class PieceEncoder:
    """Encodes as SentencePieceProcessor(model_file=path).encode(text) does for a BPE model.

    Any text has one encoding, and so has each of its prefixes. A sequence of tokens is an encoding
    exactly if each pair of neighbours is what the merges make of the two tokens' joined text: of
    the merges that cross a boundary between tokens the first one would also be made with its two
    tokens alone. So the last token of a prefix is the one token that ends there (an automaton
    finds those) and is compatible with the last token of the prefix before it. The table of last
    tokens is filled from left to right and read from right to left.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self._score = {self.sp.id_to_piece(i): self.sp.get_score(i) for i in plain}
        self._id = {self.sp.id_to_piece(i): i for i in plain}
        self._byte = {int(self.sp.id_to_piece(i)[3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        self._automaton = ahocorasick.Automaton()
        for piece in self._id:
            if len(piece) > 1:
                self._automaton.add_word(piece, (len(piece), self._id[piece]))
        self._automaton.make_automaton()
        self._cut = re.compile(self._cuts())
        self._none = n
        self._text = [str(i) for i in range(n)]
        self._single = _Singles(self._id, n)
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, list[int]] = {}
        self._former: dict[str, list[int]] = {}

    def _cuts(self) -> str:
        """A pattern that cuts texts where no piece, and so no merge, crosses: before blanks, around line ends, after letters that a sign follows."""
        inside = {p[i : i + 2] for p in self._id for i in range(len(p) - 1)}
        if any((b == _BLANK and a != _BLANK) or "\n" in (a, b) for a, b in inside):
            return "(?s).+"
        signs = "".join(c for c in _SIGNS if not any(b == c and re.match(_LETTER, a) for a, b in inside))
        ends = f"[{_BLANK}\n{re.escape(signs)}]"
        return f"\n|{_BLANK}*+{_LETTER}++(?={ends}|\\Z)|{_BLANK}*[^{_BLANK}\n]+|{_BLANK}+"

    def merged(self, text: str) -> list[str]:
        """What merging neighbours makes of a short text: the best-scored pair first, the leftmost of equals."""
        parts, score, none = list(text), self._score.get, float("-inf")
        scores = [score(a + b, none) for a, b in pairwise(parts)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether left and right may be neighbours in an encoding, or, without a left one, right may begin it."""
        return self.merged(left + right) == [t for t in (left, right) if t]

    def tokens(self, text: str) -> list[int]:
        """The tokens of a normalised text: numbers of pieces, and for characters outside the vocabulary, `none` and beyond.

        The automaton holds pieces of two characters or more. Where none of those that end at a
        place is the last token of the prefix up to there, the single character is.
        """
        n, pairs, single = len(text), self._pairs, self._single
        number, size_of = [self._none] * (n + 1), [0] * (n + 1)  # the last token of each prefix, and its length
        done = 0  # prefixes that are settled
        for end, (size, token) in self._automaton.iter(text):
            if end < done:
                continue
            while done < end:
                number[done + 1], size_of[done + 1] = single[text[done]], 1
                done += 1
            at = end + 1 - size
            pair = number[at] << 22 | token
            good = pairs.get(pair)
            if good is None:
                if len(pairs) > KEPT_PAIRS:
                    pairs.clear()
                good = pairs[pair] = self.compatible(text[at - size_of[at] : at], text[at : end + 1])
            if good:
                done = end + 1
                number[done], size_of[done] = token, size
        for at in range(done, n):
            number[at + 1], size_of[at + 1] = single[text[at]], 1
        out = []
        while n:
            out.append(number[n])
            n -= size_of[n]
        return out[::-1]

    def _ids(self, text: str) -> list[int]:
        out: list[int] = []
        for t in self.tokens(text):
            if t < self._none:
                out.append(t)
            elif self._byte:
                out += [self._byte[b] for b in chr(t - self._none - 1).encode()]
            elif not out or out[-1] != self.sp.unk_id():  # a run of unknown characters is one id
                out.append(self.sp.unk_id())
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty texts."""
        if not text:
            return []
        words, kept = self._cut.findall(self.sp.normalize(text)), self._words
        try:
            return list(chain.from_iterable(map(kept.__getitem__, words)))
        except KeyError:
            pass
        if len(kept) > KEPT_WORDS:  # start anew; what is still met comes over from the former words
            self._former, self._words = kept, {}
            kept = self._words
        long: dict[str, list[int]] = {}
        for w in set(words).difference(kept):
            found = self._former.get(w)
            (kept if len(w) <= KEPT_CHARS else long)[w] = self._ids(w) if found is None else found
        return list(chain.from_iterable([long[w] if w in long else kept[w] for w in words]))

    def joined(self, ids: list[int]) -> str:
        """Ids as decimal numbers joined by commas."""
        names = self._text
        return ",".join([names[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The library's decoding of ids."""
        return self.sp.decode(ids) if ids else ""


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's own encoder for path, loaded once."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text; null texts count as empty; null and repeated ids are kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator) -> Iterator:
        e = encoder(model)
        found = ((doc, e.encode(text)) for doc, text in rows(batches, "doc_id", "text"))
        yield from batched(((doc, ids, e.decode(ids)) for doc, ids in found), schema, 256)

    return columns_of(docs, [(id_col, "doc_id"), (text_col, "text")]).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), but of ids and decoded text the SHA-256 alone: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator) -> Iterator:
        e = encoder(model)

        def one():
            for doc, text in rows(batches, "doc_id", "text"):
                ids = e.encode(text)
                yield doc, len(ids), hashlib.sha256(e.joined(ids).encode()).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()

        yield from batched(one(), schema)

    return columns_of(docs, [(id_col, "doc_id"), (text_col, "text")]).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
