"""Token ids of whole batches of texts, each distinct word encoded once."""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

# Words whose ids a task keeps between batches.
REMEMBERED = 300_000

# Letters with signs after them: two pre-tokens whatever the letters are. Words with an apostrophe (contractions) or
# with the signs of special tokens are left to the whole tokenizer.
_SIGNS = r"!-&(-/:;=?@\[-`{}~"
_PLAIN = re.compile(rf"([^\W\d_]*)([{_SIGNS}]*)")
# Of each byte: 1 for an ASCII letter, 2 for one of those signs. Between a 1 and a 2 there is always a pre-token's bound.
_KINDS = np.array([1 if bytes([b]).isalpha() else 2 if b < 128 and re.match(f"[{_SIGNS}]", chr(b)) else 0 for b in range(256)],
                  np.uint8)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others
    numbered from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """Ids by a tokenizer file whose pre-tokenizer never joins text across a space or line end.

    Texts are cut at spaces, line ends, and between ASCII letters and plain signs only; every other character, white
    space included, goes to the tokenizer. ASCII letters are lower-cased before that (the tokenizer does it too), so that
    a word has few writings.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[bytes, bytes] = {}  # the ids as bytes: small objects, joined in one go

    def encode(self, texts: list[str], closing: int | None = None) -> list[np.ndarray]:
        """uint32 ids of each text, with the closing id at the end."""
        if not texts:
            return []
        raw = [t.encode("utf-8") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        if b"<|" not in joined:  # special tokens are case-sensitive
            data = _lowered(data)
        kinds, space = _KINDS.take(data), (data == 32) | (data == 10)
        stop_here = space.copy()
        stop_here[1:] |= kinds[1:] + kinds[:-1] == 3
        ends = np.flatnonzero(stop_here)
        begins = np.concatenate([[0], ends[:-1] + space[ends[:-1]]])
        # the bounds of each word lie next to each other, so an array of every other entry has the words alone
        bounds = np.empty(2 * len(ends) + 1, np.int64)
        bounds[0:-1:2], bounds[1::2], bounds[-1] = begins, ends, len(data)
        pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(ends), [None, pa.py_buffer(bounds),
                                                                         pa.py_buffer(data)])
        words = pieces.take(pa.array(np.arange(0, 2 * len(ends), 2))).dictionary_encode()
        which = words.indices.to_numpy()
        ids = self._ids(_listed(words.dictionary))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        # ids of all words in order, gathered from the distinct ones
        length = sizes[which]
        stop = np.cumsum(length)
        at = np.repeat(first[which] - (stop - length), length) + np.arange(int(stop[-1]) if len(stop) else 0)
        every = flat[at]
        text_ends = np.searchsorted(ends, np.cumsum([len(r) + 1 for r in raw]) - 1, side="left")
        cuts = stop[text_ends]
        tail = np.array([] if closing is None else [closing], np.uint32)
        return [np.concatenate([x, tail]) for x in np.split(every, cuts)[:len(raw)]]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found, other = list(map(known.get, words)), []
        for place in [i for i, ids in enumerate(found) if ids is None]:
            w = words[place]
            # ASCII letters stand for themselves
            ids = self._model_ids(w.lower().decode()) if w.isalpha() else self._plain(w.decode("utf-8"))
            if ids is None:
                other.append(place)
            else:
                known[w] = found[place] = ids
        whole = self.tokenizer.encode_batch_fast([words[i].decode("utf-8") for i in other], add_special_tokens=False)
        for place, e in zip(other, whole):
            known[words[place]] = found[place] = array("I", e.ids).tobytes()
        return found

    def _plain(self, word: str) -> bytes | None:
        """Ids of letters and signs straight from the model; None for a word that needs the whole tokenizer."""
        found = _PLAIN.fullmatch(word)
        if not found or not (word.isascii() or found[1].lower().isalpha() and "\u03a3" not in word
                             and unicodedata.is_normalized("NFC", word)):
            return None
        return b"".join([self._model_ids(part.lower().encode("utf-8").decode("latin-1").translate(self.letters))
                         for part in found.groups() if part])

    def _model_ids(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


def _listed(words: pa.LargeBinaryArray) -> list[bytes]:
    """All words of an array without nulls, made sooner than by `to_pylist`."""
    _, bounds, data = words.buffers()
    at = np.frombuffer(bounds, np.int64, len(words) + 1, 8 * words.offset).tolist()
    joined = data.to_pybytes() if data else b""
    return [joined[a:b] for a, b in zip(at, at[1:])]


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, but those before another alphabet's byte, with which they may make one character."""
    upper = (data >= 65) & (data <= 90)
    upper[:-1] &= data[1:] < 128
    return data | (upper.view(np.uint8) << 5)
