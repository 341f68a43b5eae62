"""Token ids of whole texts, by the tokenizers library, with repeated words encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps, at most; later ones are encoded again in each batch.
KEPT = 800_000
# Cuts at places where byte-level BPE cuts too: after a run of letters and digits, after one of other signs, and in
# white space; what holds an apostrophe stays together up to the next white space, for the contractions.
STRETCH = re.compile(r" ?[^\W_]+| ?(?:[^\w\s']|_)++(?!')| ?(?:[^\w\s]|_)*'\S*| ?\S+|\s+(?!\S)|\s")
#: Signs of which a run at the end of a word is one stretch: what is neither letter, digit, white space nor apostrophe.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
BLANK = re.compile(r" (?=\S)")
ODD = re.compile(r" (?:\s|$)")
# White space to Python's patterns but not to the tokenizer's.
CONTROL = re.compile("[\x1c-\x1f]")
_open: dict = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE has for each byte: its own, or the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as bytes of little-endian numbers: uint16 for vocabularies that allow it, else uint32.

    With ``literal`` the strings of special tokens are ordinary text; without it they are their own ids, as the library
    has it by default. Memory: ``KEPT`` words, and the distinct words of one batch.
    """

    def __init__(self, path: str, literal: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        added = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: Ids of words with a space in front, and of stretches as they are.
        self.words: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _put(self, names: list[str], ids: Iterable[list[int]], known: dict[str, bytes]) -> None:
        ids = list(ids)
        ends = (np.cumsum([len(x) for x in ids], dtype=np.int64) * self.dtype.itemsize).tolist()
        flat = np.fromiter(chain.from_iterable(ids), dtype=self.dtype).tobytes()
        known.update(zip(names, [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _learn(self, new: Iterable[str], space: bool) -> None:
        """Ids of stretches that no other stretch of a word shares a token with."""
        easy, hard = [], []
        for w in new:
            (easy if w.isalpha() else hard).append(w)
        before, known = (" ", self.words) if space else ("", self.bare)
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        first = letters[32] if space else ""
        # One pre-token each: the model alone gives the ids.
        spelled = [first + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)) for w in easy]
        self._put(easy, ([t.id for t in tokenize(s)] for s in spelled), known)
        self._put(hard, (e.ids for e in self.tokenizer.encode_batch_fast([before + w for w in hard], add_special_tokens=False)), known)

    def _learn_words(self, new: Iterable[str], space: bool) -> None:
        """Ids of words, those of several stretches from their stretches."""
        one, ended, several = [], [], []
        for w in new:
            if w.isalpha():
                one.append(w)
            elif (stem := w.rstrip(SIGNS)).isalpha():
                ended.append((w, stem, w[len(stem) :]))
            else:
                c = STRETCH.findall(" " + w if space else w)
                (one if len(c) < 2 else several).append(w if len(c) < 2 else (w, c))
        rest = set(chain.from_iterable(c[1:] for _, c in several))
        rest.update(tail for _, _, tail in ended)
        heads = {c[0] for _, c in several}
        spaced = {h[1:] for h in heads if h[:1] == " " and space}
        rest.update(h for h in heads if not (space and h[:1] == " "))
        bare, words = self.bare, self.words
        known = words if space else bare
        self._learn({*one, *spaced, *(stem for _, stem, _ in ended)}.difference(known), space)
        if not space:
            self._learn({h[1:] for h in heads if h[:1] == " "}.difference(words), True)
        self._learn(rest.difference(bare), False)
        for w, stem, tail in ended:
            known[w] = known[stem] + bare[tail]
        for w, c in several:
            known[w] = b"".join([words[c[0][1:]] if space and c[0][:1] == " " else bare[c[0]], *map(bare.__getitem__, c[1:])])

    def encode(self, texts: list[str]) -> list[bytes]:
        # A text splits before each space that a word follows; only its first part has no space in front.
        out: list = [self._whole(t) if CONTROL.search(t) or (self.special and self.special.search(t)) else None for t in texts]
        at = [i for i, x in enumerate(out) if x is None]
        had, had_bare = len(self.words), len(self.bare)
        odd = self._joined(out, at, pc.split_pattern(pa.array([texts[i] for i in at], pa.large_string()), " "))
        if odd:
            cuts = [BLANK.split(texts[i]) for i in odd]
            ends = pa.array(np.cumsum([0, *map(len, cuts)]))
            self._joined(out, odd, pa.LargeListArray.from_arrays(ends, pa.array(chain.from_iterable(cuts), pa.large_string())))
        for known, before in ((self.words, had), (self.bare, had_bare)):
            if len(known) > KEPT:  # what this batch added goes again
                for w in list(known)[before:]:
                    del known[w]
        return out

    def _joined(self, out: list, at: list[int], parts: pa.Array) -> list[int]:
        """Put the ids of the parts of each text (a list of strings, the first without a space in front) at its place in out. Gives the
        places of texts that must split elsewhere, as a part is empty or begins with white space. Each distinct part is looked up once."""
        starts = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [names[i] for i in code[starts[:-1]].tolist()]
        code[starts[:-1]] = np.arange(len(names), len(names) + len(heads))
        ids = list(map(self.words.get, names))
        new = [i for i, x in enumerate(ids) if x is None]
        none = [i for i in new if not names[i] or names[i][0].isspace()]
        bad = np.zeros(len(names) + len(heads), dtype=bool)
        bad[none] = True
        self._learn_words([names[i] for i in new if not bad[i]], True)
        self._learn_words(set(heads).difference(self.bare), False)
        for i in new:
            ids[i] = self.words.get(names[i], b"")
        ids += map(self.bare.__getitem__, heads)
        skip = np.zeros(len(at), dtype=bool)
        if none:
            skip[np.searchsorted(starts, np.flatnonzero(bad[code]), side="right") - 1] = True
        flat = pa.array(ids, pa.large_binary()).take(pa.array(code))
        ends = np.frombuffer(flat.buffers()[1], dtype="<i8", count=len(flat) + 1)[starts].tolist()
        data = memoryview(flat.buffers()[2] or b"")
        for i, gone, a, b in zip(at, skip.tolist(), ends, ends[1:], strict=False):
            if not gone:
                out[i] = bytes(data[a:b])
        return [i for i, gone in zip(at, skip.tolist(), strict=True) if gone]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


def encoder(path: str, literal: bool = False) -> Encoder:
    """The process's encoder for a tokenizer file, opened once."""
    if (path, literal) not in _open:
        _open[path, literal] = Encoder(path, literal)
    return _open[path, literal]
