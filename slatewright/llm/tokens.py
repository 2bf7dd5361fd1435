"""Vocabulary files and a bounded cache of encoded chunks, for the operators that
tokenise.  A vocabulary's path is a parameter; files are read on each executor from
the installed package and never copied."""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import keeps

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_table() -> tuple[list[str], dict[str, int]]:
    """The character that stands for each byte in byte-level vocabularies, and back:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, moved = [], 0
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(256 + moved))
            moved += 1
    return out, {c: b for b, c in enumerate(out)}


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def from_ranks(path: str, pattern: str):
    """A tokenizer of the tokenizers library that encodes by a rank file.  Every way to
    cut a token in two known tokens is a merge, in order of the token's rank, so that the
    adjacent pair whose join has the lowest rank is merged first."""
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    table, known = byte_table()[0], ranks(path)
    spell = lambda b: "".join(table[x] for x in b)
    merges = []
    for token, _ in sorted(known.items(), key=lambda kv: kv[1]):
        for i in range(1, len(token)):
            if token[:i] in known and token[i:] in known:
                merges.append((spell(token[:i]), spell(token[i:])))
    made = Tokenizer(BPE(vocab={spell(t): r for t, r in known.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@lru_cache(maxsize=4)
def from_json(path: str):
    """A tokenizer file; strings of its special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@lru_cache(maxsize=4)
def token_strings(path: str) -> tuple[str, ...]:
    """The string of each id in byte characters, which is what the library's model has."""
    table = byte_table()[0]
    vocab = from_json(path).get_vocab(with_added_tokens=False) if path.endswith(".json") else {"".join(table[x] for x in t): r for t, r in ranks(path).items()}
    out = [""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = token
    return tuple(out)


@lru_cache(maxsize=1)
def _back() -> dict[int, str]:
    return {ord(c): chr(b) for c, b in byte_table()[1].items()}


def spelt_bytes(spelt: str) -> bytes:
    """The bytes that byte characters stand for; one of no byte is an error."""
    return spelt.translate(_back()).encode("latin-1")


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """Bytes of each id of a byte-level vocabulary, by the reversed byte table."""
    return tuple(spelt_bytes(t) for t in token_strings(path))


_LATIN = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))


#: ASCII marks but the apostrophe, which may begin a match with letters.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


@lru_cache(maxsize=1)
def _latin_spelling() -> dict[int, str]:
    """Byte characters of the letters of _LATIN beyond ASCII."""
    table = byte_table()[0]
    return {ord(c): "".join(table[x] for x in c.encode()) for c in _LATIN if not c.isascii()}


def _forget() -> None:
    for made in (ranks, from_ranks, from_json, token_strings, token_bytes):
        made.cache_clear()


keeps(__name__, _forget)


class Chunks(dict):
    """Ids of chunks as little-endian unsigned 32-bit integers, encoded by the library
    when first met.  Two generations of up to ``room`` chunks are kept, so memory is
    bounded while frequent ones stay; chunks over ``longest`` characters are not kept."""

    MARKS = (",", ".")

    def __init__(self, tokenizer, room: int = 300_000, longest: int = 48, drops_blanks: bool = False):
        super().__init__()
        self.tokenizer, self.room, self.longest, self.drops_blanks = tokenizer, room, longest, drops_blanks
        self.model, self.old = tokenizer.model, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, chunk: str) -> bytes:
        """Letters below U+0130 (after a blank or not) are one match of the pattern and,
        in lower case where the tokenizer asks for it, their own normal form: such a chunk
        goes straight to the library's model, spelt in byte characters.  So does one with
        a comma or full stop after it, which is a second match; any other goes through
        the whole tokenizer."""
        body, mark = (chunk[:-1], chunk[-1]) if chunk[-1:] in self.MARKS else (chunk, "")
        letters = body if self.drops_blanks or body[:1] != " " else body[1:]
        if letters.isalpha() and (self.drops_blanks or body is not letters) and (letters.isascii() or max(letters) < "\u0130"):
            if mark:
                return self[body] + self[mark]
            word = letters.lower() if self.drops_blanks else body
            table = byte_table()[0]
            if letters.isascii():
                word = word.replace(" ", table[32])
            else:
                word = "".join([table[x] for x in word.encode()])
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words of lower-case Latin letters, for tokenizers that drop
        blanks: encode() without its tests."""
        out = list(map(self.get, words))
        old, put = self.old.get, self.__setitem__
        tokenize, spell = self.model.tokenize, _latin_spelling()
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            ids = old(w)
            if ids is None:
                ids = array("I", [t.id for t in tokenize(w if w.isascii() else w.translate(spell))]).tobytes()
            if len(w) <= self.longest:
                put(w, ids)
            out[i] = ids
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        return out

    def of(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as chunks that are encoded apart."""
        return [b"".join(map(self.__getitem__, t)) for t in texts]


#: White space besides the ASCII blanks, and separators that some engines count as it.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
DOUBLE_SPACE = re.compile(r"[ \t-\r][ \t-\r]")
RUNS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def spaced_chunks(text: str) -> list[str]:
    """Cut before blanks that follow a non-blank.  A pattern none of whose matches goes
    on from a non-blank into a blank gives each chunk the matches it has in the whole."""
    if not text:
        return []
    if ODD_SPACE.search(text):
        return [text]
    if DOUBLE_SPACE.search(text):
        return RUNS.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


#: Bytes that an ODD_SPACE character has in UTF-8 (and some others have too).
_MAYBE_ODD = np.zeros(256, bool)
_MAYBE_ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def _strings(words: pa.Array) -> list[str]:
    """A list of the strings, none of which has a newline; quicker than one by one."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(whole, "\n")[0].as_py().split("\n")


def encode_words(column: pa.Array, cache: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin and end, for tokenizers that
    drop white space between words and case.  A-Z become lower case first, so that fewer
    words differ.  Arrow cuts the texts and numbers their distinct words; the cache is asked once for
    each of those, and ids are gathered by number."""
    n = len(column)
    raw = pc.fill_null(column.take(pa.array(np.arange(n))).cast(pa.large_string()), "")  # copied: no slice
    bounds = np.frombuffer(raw.buffers()[1], np.int64, n + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    odd = np.zeros(n, bool)
    for i in np.unique(np.searchsorted(bounds - bounds[0], np.flatnonzero(_MAYBE_ODD[data]), "right") - 1).tolist():
        odd[i] = ODD_SPACE.search(raw[i].as_py()) is not None
    plain = pc.if_else(pa.array(odd), "", pc.replace_substring(pc.ascii_lower(raw), "\n", " "))
    parts = pc.split_pattern(plain, " ")
    first = np.asarray(parts.offsets)
    numbered = parts.flatten().dictionary_encode()
    number = np.array(numbered.indices)
    words = numbered.dictionary
    # Lower-case Latin letters, and perhaps marks after them (one match of its own).
    simple = pc.match_substring_regex(words, f"^[a-z\u00df-\u00f6\u00f8-\u00ff]+[{re.escape(_MARKS)}]*$")
    easy = words.filter(simple)
    bodies, marks = pc.utf8_rtrim(easy, _MARKS).dictionary_encode(), pc.utf8_ltrim(easy, _LATIN).dictionary_encode()
    known = [b"", *cache.letters(_strings(bodies.dictionary))]
    body, mark = np.zeros((2, len(words)), np.int64)
    chosen = np.asarray(simple)
    body[chosen], mark[chosen] = np.asarray(bodies.indices) + 1, np.asarray(marks.indices) + len(known)
    known += [cache[m] for m in _strings(marks.dictionary)]
    body[~chosen] = len(known) + np.arange(len(words) - len(easy))
    known += [cache[w] for w in _strings(words.filter(pc.invert(simple)))]
    # Odd texts are encoded whole, as one more word of their own.
    whole = np.flatnonzero(odd)
    number[first[whole]] = len(words) + np.arange(len(whole))
    body, mark = np.append(body, len(known) + np.arange(len(whole))), np.append(mark, np.zeros(len(whole), np.int64))
    known += [cache[raw[i].as_py()] for i in whole.tolist()]
    flat, end = np.frombuffer(b"".join(known), "<u4"), np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 4)
    flat, end = _gathered(flat, end, np.stack([body, mark], 1).ravel())
    out, end = _gathered(flat, end[1::2], number)
    return out, np.concatenate([[0], end])[first]


def _gathered(flat: np.ndarray, end: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, given by their ends, in the order of ``number``, and their ends there."""
    size = np.diff(end, prepend=0)
    count = size[number]
    at = np.cumsum(count)
    return flat[np.repeat((end - size)[number] - (at - count), count) + np.arange(int(at[-1]) if len(at) else 0)], at
