"""Token ids of a public byte-level BPE vocabulary, for whole texts.

``ids(texts)`` are those that the tokenizers library gives for the vocabulary
file with ``add_special_tokens=False``; tests compare the two. That option adds
no tokens around a text, but the strings of the file's added tokens (such as
``<|endoftext|>``) that a text holds still become their ids; the operators
(``Encoder.shared``) do the same. With the library's switch
``encode_special_tokens`` those strings are ordinary text. The merging itself is
done by tiktoken, which reads the same file's vocabulary as ranks and is several
times faster; the stretches between added tokens are encoded each by itself.

A byte-level BPE never merges across the end of a word, so a text may be cut
wherever white space follows something else. A run of ``LONG`` or more white
space characters is one word, but for its last character where text follows;
the tokenizers library encodes it by itself, as tiktoken's pattern search ends
the process on a run of a million. The chunks repeat often: a worker
encodes a chunk once while it remembers it, and all new chunks of a batch in
one call.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

#: Chunks that a worker remembers; then it starts anew.
REMEMBERED = 200_000
#: The published pre-tokenizer pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern has it (the Unicode property; Python's own class holds more).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space before a blank or line end: such texts are cut by the pattern below.
_LOOSE = re.compile(f"[{SPACE}][ \n]")
_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
LONG = 10_000
_LONG_RUN = re.compile(f"(?<![{SPACE}])[{SPACE}]{{{LONG},}}")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary file: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Encodes texts with the vocabulary file at ``path`` (a tokenizers JSON file).

    ``encode_special_tokens``: strings of added tokens are ordinary text.
    """

    _shared: dict[str, Encoder] = {}

    def __init__(self, path: str, encode_special_tokens: bool = True):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        special, letters = {t["content"]: t["id"] for t in saved["added_tokens"]}, byte_letters()
        ranks = {bytes(letters[c] for c in token): n for token, n in saved["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)  # bytes of each token
        for token, n in ranks.items():
            self.width[n] = len(token)
        if encode_special_tokens:
            special = {}
        elif any(t[k] for t in saved["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added tokens that take white space or whole words only: {path}")
        # of two that begin at one place the longer one counts
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.fixed = {c: np.array([n], dtype="<u4").tobytes() for c, n in special.items()}
        self.known: dict[str, bytes] = dict(self.fixed)
        self.path, self._library = path, None

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """The encoder of this Python worker, with the ids of the tokenizer as loaded."""
        if path not in cls._shared:
            cls._shared[path] = cls(path, encode_special_tokens=False)
        return cls._shared[path]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The uint32 ids of each text."""
        parts = [self._parts(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = dict(self.fixed)
        new = set(chain.from_iterable(parts)).difference(self.known)
        # a chunk that begins with white space and doesn't end with it can follow another one
        runs = [c for c in new if c[0] in SPACE and c[-1] not in SPACE]
        self._learn(runs)
        long = {}
        for c in new.difference(self.known):
            if len(c) >= LONG - 1 and not c.strip(SPACE):
                long[c] = self._space(c)
            else:
                self.known[c] = np.array(self.bpe.encode_ordinary(c), dtype="<u4").tobytes()
        look = self.known.__getitem__ if not long else (self.known | long).__getitem__
        return [np.frombuffer(b"".join(map(look, p)), dtype="<u4") for p in parts]

    def _space(self, run: str) -> bytes:
        """The ids of a long run of white space."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return np.array(self._library.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, runs: list[str]) -> None:
        """Encode the chunks as one text, and cut its ids where the chunks end."""
        if runs:
            ids = np.array(self.bpe.encode_ordinary("".join(runs)), dtype="<u4")
            ends = np.cumsum([len(c.encode()) for c in runs])
            at = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            raw, start = ids.tobytes(), 0
            for c, stop in zip(runs, (4 * at).tolist(), strict=True):
                self.known[c] = raw[start:stop]
                start = stop

    def _parts(self, text: str) -> list[str]:
        """The chunks of the stretches between added tokens, and those tokens."""
        stretches = self.special.split(text) if self.special else [text]
        if len(stretches) == 1:
            return self._stretch(text)
        return [c for k, s in enumerate(stretches) for c in ([s] if k % 2 else self._stretch(s))]

    def _stretch(self, text: str) -> list[str]:
        """The chunks of a stretch without added tokens; long runs of white space are chunks of their own."""
        if len(text) < LONG:
            return self._chunks(text)
        out, start = [], 0
        for m in _LONG_RUN.finditer(text):
            stop = m.end() - (m.end() < len(text))  # the last one goes with what follows
            out += self._chunks(text[start: m.start()]) + [text[m.start(): stop]]
            start = stop
        return out + self._chunks(text[start:])

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """Pieces that put together are the text; each but the first begins with the white space at a cut."""
        if not text:
            return []
        if _LOOSE.search(text):
            return _CUT.split(text)
        out = []
        for k, line in enumerate(text.split("\n")):
            first, *words = line.split(" ")
            out.append("\n" + first if k else first)
            out += [" " + w for w in words]
        return out if out[0] else out[1:]


def batches_of(texts: list[str], most: int = 1_500_000):
    """Runs of texts of about ``most`` characters, so that one batch of ids stays small."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield texts[at: k + 1]
            at, held = k + 1, 0
    if at < len(texts):
        yield texts[at:]
