"""Token ids and token bytes of three kinds of public vocabularies, for use inside tasks.

A byte-level BPE file of the tokenizers library is read once a worker. Its ids are made by tiktoken from the same ranks
and pattern, which is several times as fast and gives the same ids (a test compares all codepoints); a text that
tiktoken's pattern matcher gives up on, such as a million spaces in a row, goes to the library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Sequence
from itertools import chain, compress

import numpy as np
import public_tokenizers
import regex
import sentencepiece
import tiktoken


class TokenBytes:
    """The bytes of every id, end to end."""

    def __init__(self, tokens: Sequence[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.places[ids] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.data[at]


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes of Latin-1 as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of = _bytes_of_characters()
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        tokens = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, i in chain(ranks.items(), ((t.encode(), i) for t, i in special.items())):
            tokens[i] = token
        self.path, self.bytes = path, TokenBytes(tokens)
        self.coder = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str, special: bool) -> np.ndarray:
        """Ids; strings of special tokens in the text are such tokens where ``special``, else ordinary text."""
        try:
            return self.coder.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
        except ValueError:
            return np.array(_library(self.path, special).encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def _library(path: str, special: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = not special
    return made


class Pieces:
    """A sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = TokenBytes([self._token(i) for i in range(self.coder.get_piece_size())])

    def _token(self, i: int) -> bytes:
        piece = self.coder.id_to_piece(i)
        return bytes.fromhex(piece[3:5]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


class WordBpe:
    """A BPE file of the tokenizers library whose words end with ``</w>``.

    Most words are coded by tiktoken: a byte that words do not hold stands for the end of a word, ranks are the order of
    merges, and many words are one text. That gives the library's ids, several times as fast, for words of printable Latin
    characters without special tokens; the rest, and every word of a file with other rules than these, goes to the library.
    """

    END = b"\x01"
    #: Characters up to Latin Extended-B that no matcher takes for white space or controls; a dotted capital I has two in
    #: lower case.
    SAFE = re.compile("[\u0021-\u007e\u00a1-\u012f\u0131-\u024f]+")
    #: The normaliser that makes of a composed word of these characters its lower case.
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.library, self.size = _library(path, True), 1 + max(vocab.values())
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = [
            (spec.get("normalizer") or {}).get("normalizers") == self.NORMALIZER, model.get("end_of_word_suffix") == "</w>",
            not model.get("dropout"), not model.get("continuing_subword_prefix"), not model.get("ignore_merges"),
            [s.get("type") for s in steps] == ["Split", "ByteLevel"], steps[0].get("behavior") == "Removed", steps[0].get("invert"),
        ]
        self.coder = None
        if all(known):
            self.pieces = regex.compile(steps[0]["pattern"]["Regex"])
            self.coder = self._coder(vocab, model["merges"])

    def _coder(self, vocab: dict[str, int], merges: list) -> tiktoken.Encoding:
        of = _bytes_of_characters()
        character = {b: c for c, b in of.items()}

        def raw(token: str) -> bytes:
            inner = token.removesuffix("</w>")
            return bytes(map(of.__getitem__, inner)) + self.END * (inner != token)

        ranks, ids = {}, []
        # single bytes, then bytes that end a word, then merges in their order
        singles = [(bytes([b]), character[b]) for b in range(256)]
        singles += [(x + self.END, c + "</w>") for x, c in singles]
        merged = ("".join(m.split(" ") if isinstance(m, str) else m) for m in merges)
        for token, name in chain(singles, ((raw(t), t) for t in merged)):
            if token not in ranks:
                ranks[token] = len(ids)
                ids.append(vocab.get(name, 0))
        self.ids = np.array(ids, np.int64)
        return tiktoken.Encoding("words", pat_str=r"[^\x01\n]*\x01|\n", mergeable_ranks=ranks, special_tokens={})

    def _plain(self, word: str) -> bool:
        return self.SAFE.fullmatch(word) is not None and (word.isascii() or unicodedata.is_normalized("NFC", word))

    def encode(self, words: list[str], dtype: str) -> list[bytes]:
        """Ids of each word, as ``dtype``."""
        plain = list(map(self._plain, words)) if self.coder else [False] * len(words)
        some = list(compress(words, plain))
        if any(t in "\n".join(some) for t in self.special):
            plain = [ok and not any(t in w for t in self.special) for ok, w in zip(plain, words)]
            some = list(compress(words, plain))
        rest = [w for w, ok in zip(words, plain) if not ok]
        library = self.library.encode_batch_fast(rest, add_special_tokens=False) if rest else []
        coded, others = iter(self._ranked(some, dtype)), iter([np.array(x.ids, dtype).tobytes() for x in library])
        return [next(coded) if ok else next(others) for ok in plain]

    def _ranked(self, words: list[str], dtype: str) -> list[bytes]:
        if not words:
            return []
        # pieces of a word each get the end byte, words lie between line feeds, which are tokens of their own
        text = self.pieces.sub(r"\g<0>" + self.END.decode(), "\n".join(words).lower())
        ranks = self.coder.encode_to_numpy(text)
        raw, width = self.ids[ranks].astype(dtype).tobytes(), np.dtype(dtype).itemsize
        stops = [*np.flatnonzero(ranks == ord("\n")).tolist(), len(ranks)]
        starts = [0, *[s + 1 for s in stops[:-1]]]
        return [raw[a * width : b * width] for a, b in zip(starts, stops)]


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """The worker's own, kept across tasks."""
    return WordBpe(path)


@functools.cache
def byte_level(path: str) -> ByteLevel:
    """The worker's own, kept across tasks."""
    return ByteLevel(path)


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)
