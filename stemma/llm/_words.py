"""Encoding of white-space separated words with a public tokenizer file.

The vocabulary's pre-tokenizer drops white space and never joins across it, and its normalizers work
on characters, so a text's ids are its words' ids one after another.  A word is split further, as
the vocabulary's own pattern does, so that ``Word,`` and ``word`` share their pieces' ids.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import regex

#: Fixed by the vocabulary: its pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same over words that stand on lines of their own.
LINES = regex.compile(r"\n|" + PIECES)
#: Fixed by the vocabulary: what a token at the end of a word ends with.
END = "</w>"
#: Characters from this one on may be composed or lower-cased in other ways by the tokenizer's normalizers.
ODD = "[̀-\U0010ffff]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[int, str]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


def spread(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of the entries ``at`` of a table whose entries have ``sizes`` ids each, one after another."""
    begin, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
    ends = np.cumsum(n)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)], n


class Encoder:
    """Words and pieces as (ids of all, one after another; how many each has)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        load = lambda: Tokenizer.from_file(path)
        self.tokenizer, self.plain = load(), load()
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        # pieces are normalized and split already, so their encoder only has to merge
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.plain.model._resize_cache(0)  # pieces come once each
        self.alphabet = byte_alphabet()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([ODD, *added]))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(END) for i in range(size)])

    def vocabulary(self) -> list[bytes]:
        """The id-to-piece table, by id."""
        return [(self.tokenizer.id_to_token(i) or "").encode() for i in range(len(self.ends))]

    def whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the whole tokenizer, normalizers included."""
        made = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.array([i for ids in made for i in ids], "<u4"), np.array([*map(len, made)], np.int64)

    def pieces(self, pieces: list[str], at_once: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces are encoded at once as one text: a piece's last id is one that ends a word."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), at_once):
            part = pieces[k : k + at_once]
            spelled = [p if p.isascii() and p.isprintable() else p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet) for p in part]
            (made,) = self.plain.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)
            found = np.array(made.ids, "<u4")
            cuts = np.flatnonzero(self.ends[found]) + 1
            found, n = (found, np.diff(cuts, prepend=0)) if len(cuts) == len(part) else self.whole(part)
            ids.append(found)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def split(self, words: list[bytes]) -> tuple[np.ndarray, list[str], list[str]]:
        """(which words only the whole tokenizer encodes, those words, the others' pieces with "\n" after each word)."""
        text = b"\n".join([*words, b""]).decode("utf-8", "surrogatepass")
        if not self.odd.search(text):
            return np.zeros(len(words), bool), [], LINES.findall(text.lower())
        lines = text.split("\n")[:-1]
        is_odd = [self.odd.search(line) is not None for line in lines]
        rest = "\n".join([*(line for line, o in zip(lines, is_odd, strict=True) if not o), ""])
        return np.array(is_odd), [line for line, o in zip(lines, is_odd, strict=True) if o], LINES.findall(rest.lower())

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes ``words``, best distinct ones; equal pieces are encoded once."""
        return put_together(*self.split(words), self.pieces, self.whole) if words else (np.zeros(0, "<u4"), np.zeros(0, np.int64))


def put_together(is_odd: np.ndarray, odd: list[str], parts: list[str], of_pieces, of_odd) -> tuple[np.ndarray, np.ndarray]:
    """ids of words split by ``Encoder.split``, from the ids of their distinct pieces and of the odd words."""
    names = dict.fromkeys(parts)
    names.pop("\n", None)
    ids, sizes = of_pieces(list(names))
    names = dict(zip(names, range(len(names)), strict=True)) | {"\n": len(names)}
    code = np.fromiter(map(names.__getitem__, parts), np.int64, len(parts))
    ids, n = spread(ids, np.append(sizes, 0), code)
    sizes = np.diff(np.cumsum(n)[code == len(names) - 1], prepend=0)
    if not odd:
        return ids, sizes
    more, n = of_odd(odd)
    place = np.empty(len(is_odd), np.int64)
    place[~is_odd], place[is_odd] = np.arange(len(sizes)), len(sizes) + np.arange(len(n))
    return spread(np.concatenate([ids, more]), np.concatenate([sizes, n]), place)


class Numbers(dict):
    """Numbers words in the order in which they first appear."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process; it keeps no words."""
    return Encoder(path)
