"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary yields, for each position of a word, the longest token that
starts there.  The encoder takes it, checks it against its left neighbour in the pair-compatibility table
(two tokens may stand side by side only if merging their concatenation in rank order would leave them
apart) and otherwise falls back to the next shorter prefix token or steps back one token.  Positions
known to lead nowhere are marked, so a word takes linear time, however long it is.

The tokenizer file gives vocabulary, merges, normalisers and the split pattern; it is only read.

Defined cases.  Null is empty; an empty text has no tokens and decodes to the empty string.  Texts of any
length are encoded whole.  Strings of special tokens become those tokens, as in the library; of those that begin
at one place the longest counts.  Rows are independent: repeated rows, null ids and other columns don't matter.  An
empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import as_text, batches, give_back, slices, two

#: In a word's internal form each byte is one character; the last one, which carries the word end, is shifted by this.
LAST = 0x100
CACHE_WORDS = 150_000
CACHE_PAIRS = 300_000


def printable_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def default_tokenizer() -> str:
    """The place of the public vocabulary file that the registered query encodes with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def character_classes() -> dict[str, str]:
    """Letters, numbers and white space as ranges for a character class, as the library's pattern engine has them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = {}
    for name, kind in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s")):
        runs = Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(every)
        found[name] = "".join(f"\\U{ord(t[0]):08x}-\\U{ord(t[-1]):08x}" for t, _ in runs)
    return found


@lru_cache(maxsize=1)
def unassigned() -> list[tuple[int, int]]:
    """Ranges of code points that Python's character tables don't have."""
    runs: list[tuple[int, int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1] = runs[-1][0], c
            else:
                runs.append((c, c))
    return runs


class _Kept(dict):
    """word -> what ``make`` gives for it; forgets all at a bounded number of words."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, word: str):
        found = self.make(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class BacktrackingBPE:
    """Encoder and decoder for a vocabulary file of the word-end kind."""

    def __init__(self, spec: str, classes: tuple[tuple[str, str], ...] | None = None) -> None:
        import ahocorasick

        data = json.loads(spec)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        to_byte = {c: b for b, c in printable_bytes().items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        inner = {}
        for token, i in vocab.items():
            if i in self.special.values():
                continue
            ended = token.endswith(self.suffix)
            chars = [chr(to_byte[c]) for c in (token[: -len(self.suffix)] if ended else token)]
            if ended:
                chars[-1] = chr(ord(chars[-1]) + LAST)
            inner["".join(chars)] = i
        self.size_of = [0] * size
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.left, self.right = list(range(size)), list(range(size))
        self.joined: dict[int, int] = {}
        self.rank = [-1] * size  # merge order; -1: a single symbol
        self.automaton = ahocorasick.Automaton()
        for word, i in inner.items():
            self.size_of[i] = len(word)
            self.automaton.add_word(word, i)
            self.shorter[i] = next((inner[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in inner), -1)
        self.automaton.make_automaton()
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            self.left[i], self.right[i], self.rank[i] = vocab[a], vocab[b], rank
            self.joined[vocab[a] << 32 | vocab[b]] = rank
        self.compatible: dict[int, bool] = {}
        blob = [s.encode() for s in self.strings]
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in blob])]).tolist()
        self.blob = b"".join(blob)
        self.ids_of = _Kept(self._ids)
        self.said_of = _Kept(lambda word: self.decode(np.frombuffer(self.ids_of[word], "<u4").tolist()))
        # The file's pattern, with its classes spelt out; its alternatives start with different characters, so the most frequent comes first.
        c = dict(classes or character_classes().items())
        pattern = "[{L}]+|'(?:s|t|re|ve|m|ll|d)|[{N}]|[^{s}{L}{N}]+"
        self.words = re.compile(pattern.format_map(c)).findall
        # Python's engine is several times faster with classes inside the basic plane, which hold for texts inside it.
        basic = {k: "".join(r for r in re.findall(r"\\U.{8}-\\U.{8}", v) if r < r"\U00010000") for k, v in c.items()}
        self.basic_words = re.compile(pattern.format_map(basic)).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        # Characters younger than Python's tables, which the library may know how to compose and lower-case.
        young = [f"\\U{a:08x}-\\U{b:08x}" for a, b in unassigned()]
        self.unknown = re.compile(f"[{''.join(young)}]").search
        self.basic_unknown = re.compile(f"[{''.join(r for r in young if r < '\\U00010000')}]").search
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def forget(self) -> None:
        """Drop what was remembered of words and pairs."""
        self.ids_of.clear()
        self.said_of.clear()
        self.compatible.clear()

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the symbols of a and b in rank order leaves exactly these two tokens.

        Walks the merge trees on both sides of the border, latest merge first.  A pair that stands at the
        border and could be merged before the merges that hide it means that a and b don't stay apart.
        """
        key = a << 32 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        rank, joined, never = self.rank, self.joined, 1 << 60
        # From here on, pairs at the border of rank below `until` would have been merged while both stood there.
        until = (never, 0)
        while True:
            r = joined.get(a << 32 | b)
            if r is not None and (r, 0) < until:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            # Equal ranks mean the same merge on both sides, and that on the left comes first: the right one is undone before.
            if rank[a] > rank[b]:
                until = (rank[a], 0)
                a = self.right[a]
            else:
                until = (rank[b], 1)
                b = self.left[b]

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word in internal form."""
        n = len(word)
        size_of, shorter, apart = self.size_of, self.shorter, self.apart
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(word):
            longest[end + 1 - size_of[token]] = token  # later ends are longer
        whole = longest[0]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, whole
        while True:
            while token >= 0:
                end = at + size_of[token]
                if not dead[end] and (not out or apart(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                dead[at] = 1
                last = out.pop()
                at -= size_of[last]
                token = shorter[last]

    def _ids(self, word: str) -> bytes:
        """Ids of one split word as little-endian 32-bit integers."""
        raw = word.encode().decode("latin-1")
        return np.array(self.encode_word(raw[:-1] + chr(ord(raw[-1]) + LAST)), "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        if not text.isascii() and (self.unknown if self.beyond(text) else self.basic_unknown)(text):
            from tokenizers.normalizers import NFC, Lowercase

            text = Lowercase().normalize_str(NFC().normalize_str(text))
        else:
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # lower-casing is by character, with no final sigma
            text = text.lower()
        return self.words(text) if self.beyond(text) else self.basic_words(text)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text as bytes, and what they decode to."""
        ids, said = [], []
        for k, part in enumerate(self.specials.split(text) if self.special else [text]):
            if k % 2:
                ids.append(self.special[part].to_bytes(4, "little"))
                said.append(self.decode([self.special[part]]))
            elif part:
                words = self.pieces(part)
                ids += map(self.ids_of.__getitem__, words)
                said += map(self.said_of.__getitem__, words)
        return b"".join(ids), " ".join(said)

    def decode(self, ids: list[int]) -> str:
        """Token strings by the offset table; this kind of file names no decoder, so they are joined by spaces."""
        blob, offsets = self.blob, self.offsets
        return b" ".join([blob[offsets[i] : offsets[i + 1]] for i in ids]).decode()


@lru_cache(maxsize=2)
def _loaded(spec: str, classes: tuple[tuple[str, str], ...]) -> BacktrackingBPE:
    return BacktrackingBPE(spec, classes)


def _encode(shared):
    schema = pa.schema([("_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.binary()), ("decoded", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(*shared.value)

        def one(i, text: str) -> tuple:
            ids, said = bpe.encode(text)
            return i, len(ids) // 4, ids, said

        for batch in slices(it):
            yield from batches((one(*row) for row in zip(batch.column(0).to_pylist(), as_text(batch.column(1)), strict=True)), schema, 1024)
        bpe.forget()
        give_back()

    return run


def encode_bpe(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, token_ids (little-endian unsigned 32-bit integers) and the decoded text.

    ``tokenizer_json`` is the path of the vocabulary file on the driver; its contents (a few MB, fixed) are broadcast.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), tuple(character_classes().items())))
    src = two(docs, id_col, text_col)
    return src.select(src["_id"].cast("long").alias("_id"), "_text").mapInArrow(_encode(shared), "_id long, n_tokens long, token_ids binary, decoded string").withColumnRenamed("_id", id_col)
