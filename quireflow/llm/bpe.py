"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token sequences: it accepts exactly those into which byte pair encoding cuts some string. It is
compiled from the merges by one gadget after the other. Over the symbols alone, every symbol may follow every other. The
gadget of a merge (u, v) -> w splits the state behind u, takes the arc v from the split state, and adds an arc w beside
every arc u, into the state behind v. Each gadget is kept as a few table entries: which arc went, from which label the arcs
w were taken, of which state the state behind w is a copy, and when. ``may_follow`` reads any transition from these tables.

A pre-split word is encoded from left to right: behind each prefix stands the label of the one arc by which an accepted
path arrives there, the longest token that ends there and may follow the label behind its own beginning. A word's path is
kept, so that a word seen before costs one look-up. Decoding emits the labels of the arcs.

A worker of each core has the tables and paths to itself, so they are packed: numbers in arrays, a path as its ids alone.

Case and classes of characters are those of this Python; texts with code points that its tables lack are split by the
tokenizers library, whose tables may be newer.

Defined results: a null or empty text, and one of white space alone, has no tokens and decodes to the empty text. Repeated
rows each get their own row. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from array import array
from dataclasses import dataclass, field
from functools import cache
from hashlib import sha256

import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Paths of at most so many words are kept by a worker, of words up to this length.
CACHE_WORDS, CACHE_LENGTH = 300_000, 64


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


@dataclass
class Automaton:
    """Tables of the merge gadgets over label numbers (token ids), and the labels themselves.

    ``left``, ``right`` and ``made`` hold -1 for labels that no merge makes; ``known`` has answers of ``may_follow`` under
    p * len(labels) + w.
    """

    labels: list[str]
    left: array
    right: array
    made: array
    taken: dict[tuple[int, int], int]
    by_text: dict[str, int]
    end_mark: str
    known: dict[int, bool] = field(default_factory=dict)

    @classmethod
    def compile(cls, vocab: dict[str, int], merges: list[tuple[str, str]], end_mark: str) -> Automaton:
        size = max(vocab.values(), default=-1) + 1
        labels = [""] * size
        for text, i in vocab.items():
            labels[i] = text
        left, right, made, taken = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size, {}
        for time, (u, v) in enumerate(merges):
            w = vocab[u + v]
            if made[w] >= 0:
                raise ValueError(f"two merges make {u + v!r}")
            left[w], right[w], made[w], taken[vocab[u], vocab[v]] = vocab[u], vocab[v], time, time
        return cls(labels, left, right, made, taken, vocab, end_mark)

    def may_follow(self, p: int, w: int) -> bool:
        """Whether the state behind label p has an arc w after the last gadget."""
        key = p * len(self.labels) + w
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[key] = self._arc(p, w)
        return found

    def _arc(self, p: int, w: int) -> bool:
        # Time 2k is just before gadget k takes its arc, 2k + 1 just after.
        now = 2 * len(self.taken) + 2
        while True:
            gone = self.taken.get((p, w))
            if gone is not None and 2 * gone < now:
                return False
            tp, tw = self.made[p], self.made[w]
            if tp < 0 and tw < 0:
                return True
            if tp > tw:  # the state behind p was made as a copy of the state behind its right part
                now, p = 2 * tp, self.right[p]
            elif tw > tp:  # arc w was set beside arc u
                now, w = 2 * tw + 1, self.left[w]
            else:
                now, p, w = 2 * tp, self.right[p], self.left[w]

    def encode(self, symbols: list[str]) -> list[int]:
        """Labels of the path that spells the symbols (the last one carries the end mark)."""
        n, by_text = len(symbols), self.by_text
        word, marked = "".join(s[0] for s in symbols), "".join(symbols)
        behind, back = [-1] * (n + 1), [0] * (n + 1)
        longest, known, size = self.longest, self.known, len(self.labels)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                label = by_text.get(marked[j:] if i == n else word[j:i])
                if label is not None:
                    if j and (ok := known.get(behind[j] * size + label)) is not True and (ok is False or not self.may_follow(behind[j], label)):
                        continue
                    behind[i], back[i] = label, j
                    break
        out, i = [], n
        while i:
            out.append(behind[i])
            i = back[i]
        return out[::-1]

    @property
    def longest(self) -> int:
        if "_longest" not in self.__dict__:
            self.__dict__["_longest"] = max(len(t.removesuffix(self.end_mark)) for t in self.by_text)
        return self.__dict__["_longest"]


@dataclass
class Tokenizer:
    """A lower-casing word BPE as its JSON file describes it: special tokens, normalisation, words, automaton."""

    automaton: Automaton
    specials: dict[str, int]
    #: The file without its vocabulary: how the tokenizers library normalises and splits.
    splitting: str = ""

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bare = {**spec, "added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        return cls(Automaton.compile(model["vocab"], merges, model["end_of_word_suffix"]), specials, json.dumps(bare))


#: White space that counts as a separator, as in the pattern class of white space by Unicode.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: For texts without letters or digits beyond the Latin-1 range, the same words by a faster pattern.
FAST = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
BEYOND = re.compile("[^\x00-\x1b\x20-\xff]")


#: Below, every code point is assigned; a search for a plain range costs next to nothing.
HIGH = re.compile("[^\x00-\u0377]")


@cache
def unassigned() -> re.Pattern:
    """Code points that this Python's Unicode tables do not know; the library's may."""
    spans: list[list[int]] = []
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def normalise(text: str) -> str:
    """NFC, runs of white space to one space, lower case of each code point by itself."""
    text = SPACE.sub(" ", unicodedata.normalize("NFC", text))
    return text.replace("Σ", "σ").lower()


class Paths(dict):
    """Words to the ids of their paths, packed. Nothing refers back to it, so it goes with its encoder at once."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.auto, self.alphabet = automaton, byte_alphabet()

    def __missing__(self, word: str) -> bytes:
        symbols = [self.alphabet[b] for b in word.encode("utf-8")]
        symbols[-1] += self.auto.end_mark
        ids = self.auto.encode(symbols)
        path = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = path
        return path


class Encoder:
    """Words to paths, with the paths of words seen before."""

    def __init__(self, tokenizer: Tokenizer):
        self.auto = tokenizer.automaton
        self.specials = tokenizer.specials
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.labels = self.auto.labels + [""] * (max(self.specials.values(), default=-1) + 1 - len(self.auto.labels))
        for label, i in self.specials.items():
            self.labels[i] = label
        self.splitting, self.library = tokenizer.splitting, None
        self.paths = Paths(self.auto)
        self.stands_for = {c: b for b, c in self.paths.alphabet.items()}

    def plain(self, text: str) -> list[bytes]:
        if not text.isascii() and HIGH.search(text) and unassigned().search(text):
            return list(map(self.paths.__getitem__, self.words_by_library(text)))
        text = normalise(text)
        return list(map(self.paths.__getitem__, (WORD if BEYOND.search(text) else FAST).findall(text)))

    def words_by_library(self, text: str) -> list[str]:
        """Words of a text with code points newer than this Python, by the library's own tables."""
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_str(self.splitting)
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.stands_for[c] for c in word).decode("utf-8") for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a text and the text that they decode to: the labels with a space between."""
        found = []
        at = 0
        if self.special and "<|" in text:
            for m in self.special.finditer(text):
                found += self.plain(text[at : m.start()])
                found.append(struct.pack("<I", self.specials[m[0]]))
                at = m.end()
        found += self.plain(text[at:] if at else text)
        packed = b"".join(found)
        ids = array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return packed, " ".join(map(self.labels.__getitem__, ids))


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", keep=("doc_id",), columns=("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """The ``keep`` columns and any of: n_tokens, ids (little-endian unsigned 32-bit), decoded, and the digests of both."""
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer.load(path))  # as large as the vocabulary
    kinds = {"n_tokens": "bigint", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def make_kernel():
        encoder = Encoder(shared.value)
        make = {
            "n_tokens": lambda i, d: len(i) // 4, "ids": lambda i, d: i, "decoded": lambda i, d: d,
            "ids_sha256": lambda i, d: sha256(i).hexdigest(), "decoded_sha256": lambda i, d: sha256(d.encode()).hexdigest(),
        }
        of = [make[c] for c in columns]

        def kernel(texts):
            rows = []
            for text in texts:
                i, d = encoder.encode(text)
                rows.append([f(i, d) for f in of])
            return [list(x) for x in zip(*rows, strict=True)]

        return kernel

    return map_texts(docs, text_col, make_kernel, [(c, kinds[c]) for c in columns], list(keep))
