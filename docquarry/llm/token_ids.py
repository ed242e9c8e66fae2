"""Token ids of whole texts, word by word, as the tokenizer library gives them.

The tokenizer of ``word_bpe_49k.json`` drops white space and never makes a
token across it, so the ids of a text are the ids of its space-separated words
in turn. Each Python worker keeps a bounded table of words it has met; only
words that are not in it go through the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np
import regex

#: Words kept by one worker, some 150 bytes each besides what they hold themselves, and the bytes
#: that they and their ids may hold. A full table starts anew.
WORDS_KEPT, BYTES_KEPT = 600_000, 80_000_000
#: Characters from which on a word is never kept.
LONG = 256
#: Characters encoded by one call within a long word.
STEP = 65_536
#: Words encoded by one call, held apart by MARK, which is one token where it stands alone.
CALL_WORDS = 1000
MARK = "\x01"

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None
        #: Strings that the library takes for special tokens only in their own case.
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        suffix = spec["model"].get("end_of_word_suffix") or ""
        #: Bytes of each token: a token has a letter for each.
        self.width = np.zeros(1 + max(spec["model"]["vocab"].values()), np.int64)
        #: Tokens that end a piece.
        self.ends = np.zeros(len(self.width), bool)
        for token, i in spec["model"]["vocab"].items():
            self.width[i] = len(token.removesuffix(suffix))
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.table: dict[str, bytes] = {}
        self.bytes_held = 0

    def _library(self, words: list[str]) -> list[bytes]:
        """The ids (little-endian 32 bits) of each word."""
        out: list[bytes] = []
        for at in range(0, len(words), CALL_WORDS):
            some = words[at : at + CALL_WORDS]
            joined = f" {MARK} ".join(some)
            if self.mark_id is None or joined.count(MARK) >= len(some):
                out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.mark_id)
            starts, ends = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(ids)]))
            out += [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """The same for words of letters alone, in lower case too: each is one piece, so its last token tells where it ends."""
        out: list[bytes] = []
        for at in range(0, len(words), CALL_WORDS):
            some = words[at : at + CALL_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(cut) != len(some):
                out += self._library(some)
                continue
            cut = cut.tolist()
            out += [ids[a:b].tobytes() for a, b in zip([0, *cut[:-1]], cut, strict=True)]
        return out

    def _very_long(self, word: str) -> bytes:
        """The ids of a word of any length, STEP characters at a time: pieces of the tokenizer are
        never encoded across, and a piece is cut where both sides agree on a token."""
        if len(word) <= STEP or not unicodedata.is_normalized("NFC", word) or any(x in word.lower() for x in self.special):
            return self._library([word])[0]
        # letter by letter, as the tokenizer does
        text = "".join("".join(map(str.lower, word[at : at + STEP])) for at in range(0, len(word), STEP))
        out, begin = [], 0
        for piece in self.pieces.finditer(text):
            if piece.end() - begin > STEP:
                if piece.start() > begin:
                    out.append(self._library([text[begin : piece.start()]])[0])
                begin = piece.start()
            if piece.end() - begin > STEP:
                out += self._cut_piece(piece.group())
                begin = piece.end()
        if begin < len(text):
            out.append(self._library([text[begin:]])[0])
        return b"".join(out)

    def _cut_piece(self, piece: str) -> list[bytes]:
        """Ids of a piece, in parts. Tokens before one that also begins the encoding of what
        follows are those of the whole: neighbours decide whether tokens stand together."""
        out, at, size = [], 0, STEP
        while at + size < len(piece):
            part = piece[at : at + size]
            ids = np.frombuffer(self._library([part])[0], "<u4")
            places = np.cumsum(self.width[ids]) - self.width[ids]  # in bytes
            starts = np.cumsum([0, *(len(c.encode()) for c in part)])
            for k in range(len(ids) - 64, 0, -64):
                char = int(np.searchsorted(starts, places[k]))
                if starts[char] != places[k]:
                    continue
                follows = np.frombuffer(self._library([piece[at + char : at + char + 256]])[0], "<u4")
                if len(follows) > 64 and follows[0] == ids[k]:
                    out.append(ids[:k].tobytes())
                    at, size = at + char, STEP
                    break
            else:
                size *= 2
        out.append(self._library([piece[at:]])[0])
        return out

    def _learn(self, words: set[str]) -> None:
        """Put unknown words into the table. A comma or stop after a word of
        letters is split off first, as the tokenizer does: fewer words are
        left to encode."""
        table, parts = self.table, []
        for w in words:
            if w[-1:] in (",", ".") and w[:-1].isalpha() and w[:-1].lower().isalpha():
                parts.append((w, w[:-1], w[-1]))
        asked = words.difference(w for w, _, _ in parts)
        asked.update(x for _, base, tail in parts for x in (base, tail))
        asked = asked.difference(table)
        plain = [w for w in asked if w.isalpha() and w.lower().isalpha()]
        other = list(asked.difference(plain))
        ask, ids = plain + other, self._letters(plain) + self._library(other)
        table.update(zip(ask, ids, strict=True))
        for w, base, tail in parts:
            table[w] = table[base] + table[tail]
        self.bytes_held += 2 * (sum(map(len, ask)) + sum(map(len, ids)))

    def words(self, text: str) -> list[str]:
        """Words between spaces and newlines. Latin-1 texts are put into lower case
        as the tokenizer does, letter by letter, so lengths stay; not those
        that would then hold a special token."""
        try:
            text.encode("latin-1")
            lower = text.lower()
            if not any(x in lower for x in self.special):
                text = lower
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")

    def ids_by_word(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its words, as bytes of 32-bit numbers."""
        split = [self.words(t) for t in texts]
        if len(self.table) > WORDS_KEPT or self.bytes_held > BYTES_KEPT:
            self.table.clear()
            self.bytes_held = 0
        new = set(chain.from_iterable(split)).difference(self.table)
        long = [w for w in new if len(w) >= LONG]
        new.difference_update(long)
        if new:
            self._learn(new)
        if not long:
            known = self.table.__getitem__
            return [list(map(known, s)) for s in split]
        passing = {w: self._very_long(w) for w in long}
        return [[passing[w] if w in passing else self.table[w] for w in s] for s in split]

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each word; none of them is kept."""
        return [len(x) // 4 for x in (self._library(words) if all(len(w) <= STEP for w in words) else map(self._very_long, words))]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def free_encoders() -> None:
    """Gives back the words and tables that this Python worker holds from earlier stages."""
    _encoders.clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
