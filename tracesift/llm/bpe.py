"""BPE encoding and decoding by a prefix-sharing trie.

The distinct new words of a batch make a trie. A depth-first walk gives every node the last token of
the encoding of its prefix; a prefix that many words share is thus encoded once. The last token at a
node is the one suffix of the prefix that is a vocabulary entry and forms a stable pair with the last
token of what remains: the merges applied to the two tokens' symbols give just these two tokens.
Following last tokens back from a word's end yields its ids.

Covers vocabularies of the kind "byte-level BPE with an end-of-word suffix", in which words never
hold white space, as JSON files of the tokenizers library. The library itself is asked only to
normalize and split words with characters beyond ASCII.

Defined cases: a null text is an empty one; an empty text has no ids and decodes to an empty text;
null ids decode to an empty text; ids outside the vocabulary are left out when decoding. Repeated
rows stay, other columns pass through unchanged.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, list_array

#: Entries that a Python worker keeps of words, of their parts and of stable pairs; all are caches only.
WORDS_KEPT = 60_000
PARTS_KEPT = 150_000
#: Characters and bytes of the words and parts kept.
CHARS_KEPT = 16_000_000
PAIRS_KEPT = 250_000

_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_ASCII_TEXT = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-z0-9 \t\n\r\x0b\x0c]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


class Recent:
    """A cache of two generations: what a whole generation didn't ask for is dropped."""

    def __init__(self, size: int):
        self.size, self.now, self.old, self.chars = size, {}, {}, 0

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The keys that aren't kept; the others are then in now."""
        if len(self.now) > self.size or self.chars > CHARS_KEPT:
            self.now, self.old, self.chars = {}, self.now, 0
        now, old, out = self.now, self.old, []
        for key in keys:
            if key not in now:
                found = old.get(key)
                if found is None:
                    out.append(key)
                else:
                    now[key] = found
                    self.chars += len(key) + len(found)
        return out

    def add(self, made: dict[str, bytes]) -> None:
        self.now.update(made)
        self.chars += sum(len(k) + len(v) for k, v in made.items())


class TrieEncoder:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        if not self.suffix or model["continuing_subword_prefix"] or model["dropout"]:
            raise ValueError("a BPE vocabulary with an end-of-word suffix is needed")
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.named = np.array([i in names for i in range(max(names) + 1)])
        self.name_array = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        self.plain = spec["normalizer"] == {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
        self.joined = spec["decoder"] is None
        self.words, self.part_ids = Recent(WORDS_KEPT), Recent(PARTS_KEPT)
        self.forget_pairs()
        self.set_reach()

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.suffix) or token
        out = list(body)
        if body != token:
            out[-1] += self.suffix
        return out

    def stable(self, first: str, second: str) -> bool:
        """Whether the merges, in order of rank and the leftmost first, leave the two tokens as they are
        side by side; with "" for first, whether they build second alone."""
        rank, never = self.ranks.get, 1 << 60
        if (first, second) in self.ranks:
            return False
        parts = self.symbols(first) if first else []
        border = len(parts)
        parts += self.symbols(second)
        while len(parts) > 1:
            ranks = [rank(pair, never) for pair in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == never:
                break
            at = ranks.index(least)
            if at == border - 1:
                return False
            border -= at < border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == ([first, second] if first else [second])

    def encode_trie(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids, as packed 32-bit integers, of each distinct word part.

        The trie is held as its words in order: a node is a prefix, and the words below it are neighbours. Going
        through them is the depth-first walk; last is the path's stack, and what two neighbours share stays on it.
        """
        out: dict[str, bytes] = {}
        last, before = [""], ""  # by depth: the last token of the path's prefix
        vocab, suffix, find = self.vocab, self.suffix, self.last_token
        for word in sorted(parts):
            size = len(word)
            shared, most = 0, min(len(last), size) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, size):
                last.append(find(word, depth, last, self.inner, self.inner_reach, ""))
            token = find(word, size, last, self.final, self.final_reach, suffix)
            ids, left = [vocab[token + suffix]], size - len(token)
            while left:
                token = last[left]
                ids.append(vocab[token])
                left -= len(token)
            ids.reverse()
            out[word] = array("i", ids).tobytes()
            before = word
        return out

    def last_token(self, word: str, depth: int, last: list[str], table: dict[str, dict[str, bool]], reach: dict[str, int], end: str) -> str:
        """The last token, without its end, of the word's prefix of this depth."""
        size = min(depth, reach.get(word[depth - 4 : depth], 3)) if depth > 3 else depth
        while size:
            token = word[depth - size : depth]
            known = table.get(token)
            if known is not None:
                first = last[depth - size]
                fits = known.get(first)
                if fits is None:
                    fits = known[first] = self.stable(first, token + end)
                    self.pairs += 1
                if fits:
                    return token
            size -= 1
        raise ValueError(f"no token ends {word[:depth]!r}")

    def forget_pairs(self) -> None:
        """Empties the tables of stable pairs: by second token, then by first."""
        ends = {t.removesuffix(self.suffix) for t in self.vocab if t.endswith(self.suffix) and t != self.suffix}
        self.inner: dict[str, dict[str, bool]] = {t: {} for t in self.vocab if not t.endswith(self.suffix) or t == self.suffix}
        self.final: dict[str, dict[str, bool]] = {t: {} for t in ends}
        self.pairs = 0

    def set_reach(self) -> None:
        """By the last four characters, how long tokens get."""
        self.inner_reach, self.final_reach = {}, {}
        for table, reach in ((self.inner, self.inner_reach), (self.final, self.final_reach)):
            for token in table:
                if len(token) > 3:
                    reach[token[-4:]] = max(len(token), reach.get(token[-4:], 3))

    def parts(self, word: str) -> list[str | int]:
        """What a word without ordinary white space is made of: parts to encode, and ids of special tokens."""
        if self.special_split and "<|" in word or self.special_split and not self.plain:
            pieces = self.special_split.split(word)
        else:
            pieces = [word]
        out: list[str | int] = []
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece])
            elif self.plain and piece.isascii() and piece.isprintable():
                out += _ASCII_PARTS.findall(piece.lower())
            elif piece:
                normal = self.library.normalizer.normalize_str(piece)
                out += [part for part, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. Texts in printable ASCII are split into parts at once, others word by word."""
        simple = [self.plain and t.isascii() and "<|" not in t and not _CONTROL.search(t) for t in texts]
        split = [_ASCII_TEXT.findall(t.lower()) if easy else _WORD.findall(t) for t, easy in zip(texts, simple, strict=True)]
        if self.pairs > PAIRS_KEPT:
            self.forget_pairs()
        wanted = dict.fromkeys(p for parts, easy in zip(split, simple, strict=True) if easy for p in parts)
        new = self.words.missing(dict.fromkeys(w for words, easy in zip(split, simple, strict=True) if not easy for w in words))
        made = {word: self.parts(word) for word in new}
        wanted.update(dict.fromkeys(p for parts in made.values() for p in parts if isinstance(p, str)))
        fresh = self.part_ids.missing(wanted)
        self.part_ids.add(self.encode_trie(fresh))
        ids, words = self.part_ids.now, self.words.now
        self.words.add({word: b"".join([ids[p] if isinstance(p, str) else array("i", [p]).tobytes() for p in parts]) for word, parts in made.items()})
        return [b"".join(map((ids if easy else words).__getitem__, parts)) for parts, easy in zip(split, simple, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of rows of ids. Without a decoder in the vocabulary file, tokens are joined by spaces."""
        if not self.joined:
            return pa.array([self.library.decode(row or [], skip_special_tokens=False) for row in ids.to_pylist()], pa.string())
        ids = ids.fill_null(pa.scalar([], ids.type)) if ids.null_count else ids
        flat, lengths = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False)
        known = (flat >= 0) & (flat < len(self.name_array))
        if not known.all() or not self.named[flat].all():
            known[known] &= self.named[flat[known]]
            row = np.repeat(np.arange(len(lengths)), lengths)[known]
            flat, lengths = flat[known], np.bincount(row, minlength=len(lengths))
        names = self.name_array.take(pa.array(flat, pa.int32()))
        offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=offsets[1:])
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), names), pa.scalar(" ", names.type)).cast(pa.string())


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The encoder of this Python worker; its caches live on from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def bpe_encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ids_col, the token ids of the whole text. vocabulary: a path that every worker can open.
    keep: the columns that stay, all unless given."""

    def make(texts: pa.Array) -> list[pa.Array]:
        packed = encoder(vocabulary).encode([t or "" for t in texts.to_pylist()])
        return [list_array(np.frombuffer(b"".join(packed), dtype="<i4"), np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed)), pa.int32())]

    return add_columns(df, text_col, [(ids_col, T.ArrayType(T.IntegerType()))], make, keep, most=2 << 20)


def bpe_decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds out_col, the text that the ids stand for, special tokens included."""

    def make(ids: pa.Array) -> list[pa.Array]:
        return [encoder(vocabulary).decode_all(ids)]

    return add_columns(df, ids_col, [(out_col, T.StringType())], make, keep)
