"""Ids of whole texts exactly as the tokenizers library gives them, encoding a segment once while it keeps coming.

A text is cut only where no token can span the cut: before a single space or line feed between two other
characters. Both vocabularies split at such a place themselves (the byte-level one keeps the white space with what
follows, the word one drops it), and their special strings hold no white space, so the ids of the segments, joined,
are those of the text. ``tests/llm/test_tokens.py`` compares them with the library on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain, filterfalse, islice

import numpy as np

from .memory import trim

#: A space or line feed beside other white space: such texts are cut by the stricter pattern.
RUN = re.compile(r"[ \n]\s|\s[ \n]|\0")
SEPARATORS = re.compile("[\x1c-\x1f]")
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Marks at the end of a segment, after a letter, are tokens of their own.
MARKS = ".,;:!?#%&*$"
#: Segments that a worker keeps, and their greatest length: some 120 MB at most, whatever the texts.
KEPT, LONGEST = 500_000, 64
AT_ONCE = 20_000
#: Up to here every library agrees on letters and their cases.
LATIN = "\u00ff"
BEYOND = re.compile("[^\x00-\xff]")


def segments(text: str) -> list[str]:
    if RUN.search(text):
        return CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


class Encoder:
    """``encode(texts)``: for each text the ids as a numpy array, by the library, without added special tokens."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kept = Tokenizer.from_file(path), kept
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre, norm = kind.get("pre_tokenizer") or {}, kind.get("normalizer")
        parts = pre.get("pretokenizers", [pre])
        byte_level = parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex") and not parts[0].get("add_prefix_space") and norm is None
        by_word = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and "\\s" in str(parts[0].get("pattern"))
        self.can_cut = bool(byte_level or by_word)
        self.strip = by_word and not byte_level
        self.folds = self.strip and '"Lowercase"' in json.dumps(norm)
        self.type = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = {2: "H", 4: "I"}[self.type.itemsize]
        self.cache: dict[str, bytes] = {}

    def of(self, text: str) -> list[str]:
        if not self.can_cut:
            return [text]
        if not self.strip:
            return segments(text)
        if SEPARATORS.search(text):  # white space for Python, but not for the library
            return [s.lstrip(" \n") for s in segments(text)]
        return text.split()

    def _library(self, some: list[str]) -> dict[str, bytes]:
        out = {}
        for i in range(0, len(some), AT_ONCE):
            part = some[i : i + AT_ONCE]
            for s, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                out[s] = array(self.code, e.ids).tobytes()
        return out

    def _parts(self, segment: str) -> tuple[str, str]:
        """A segment without the marks at its end, in lower case, and the marks."""
        core = segment.rstrip(MARKS)
        if len(core) == len(segment) or not core or not core[-1].isalpha() or core[-1] > LATIN:
            core = segment
        folded = core.lower() if not BEYOND.search(core) and "<|" not in core else core
        return folded, segment[len(core) :]

    def _new(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of new segments. If case is folded, the library gets each distinct core and run of marks."""
        if not self.folds:  # where case counts, too few segments share a core
            return self._library(missing)
        parts, cache = [self._parts(s) for s in missing], self.cache
        cores = self._library(list(set(filterfalse(cache.__contains__, chain.from_iterable(parts)))))
        get = lambda s: cores[s] if s in cores else cache[s]
        return cores | {s: get(a) + get(b) for s, (a, b) in zip(missing, parts)}

    def encode(self, texts: list[str]):
        """Yields one array of ids per text; texts are taken in groups of a few MB."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 4 << 20:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]):
        cut, cache = [self.of(t) for t in texts], self.cache
        new = self._new(list(set(chain.from_iterable(filterfalse(cache.__contains__, c) for c in cut))))
        cache.update(new)
        for c in cut:
            yield np.frombuffer(b"".join(map(cache.__getitem__, c)), self.type)
        for s in filter(lambda s: len(s) > LONGEST, new):
            del cache[s]
        if len(cache) > self.kept:  # frequent segments that go with the oldest third soon come again
            self.cache = dict(islice(cache.items(), len(cache) - self.kept * 2 // 3, None))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its table outlives the task, until another file or operator comes."""
    if path not in _ENCODERS:
        release()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Gives the memory of encoders back, before an operator that needs none."""
    if _ENCODERS:
        _ENCODERS.clear()
        trim()
