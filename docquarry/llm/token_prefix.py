"""Exact token counts at every prefix of a text, by prefix dynamic programming.

Between words: ``count[end of word w] = count[end of word w - 1] + tokens of w``, kept
as an array. Inside a run of letters or signs: the last token of a prefix is the one
that is compatible with the last token of the prefix before it (the pair, encoded
together, stays that pair), so ``count[i] = count[i - len(last[i])] + 1``. With
it, "how many tokens has the text up to here" and "how much of the text fits a
budget" need no second encoding of the text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from docquarry.llm import token_ids
from docquarry.llm.shared import narrow
from docquarry.llm.token_ids import WordEncoder, default_path, encoder

#: Words whose prefix counts are remembered.
PREFIXES_KEPT = 100_000
#: Pairs of tokens whose compatibility is remembered.
PAIRS_KEPT = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class RunCounts:
    """Counts at every prefix of a run (a piece that the tokenizer does not split), by dynamic programming."""

    def __init__(self, enc: WordEncoder):
        spec = json.loads(enc.tokenizer.to_str())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.rank = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        self.letters = byte_letters()
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t.content for t in enc.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[tuple[str, str, bool], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens of a short run, merge by merge."""
        while True:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(symbols, symbols[1:])]
            if not ranks or min(ranks) == len(self.rank):
                return symbols
            k = ranks.index(min(ranks))
            symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]

    def fits_after(self, left: str, right: str, final: bool) -> bool:
        """Whether ``right`` follows ``left`` in an encoding; final: it ends the run."""
        known = self.known.get((left, right, final))
        if known is None:
            symbols = [*left, *right]
            end = right
            if final:
                symbols[-1] += self.suffix
                end += self.suffix
            known = self.merged(symbols) == ([left, end] if left else [end])
            if len(self.known) > PAIRS_KEPT:
                self.known.clear()
            self.known[(left, right, final)] = known
        return known

    def last_token(self, text: str, last: list[int], end: int, final: bool) -> int:
        """Length of the last token of ``text[:end]``."""
        suffix = self.suffix if final else ""
        for size in range(min(self.longest, end), 0, -1):
            token = text[end - size : end]
            if token + suffix in self.vocab:
                before = end - size
                if self.fits_after(text[before - last[before] : before], token, final):
                    return size
        raise ValueError("the vocabulary lacks a byte")

    def of_run(self, run: str, most: int | None = None) -> list[int]:
        """Tokens of the first 1, 2, ... characters; ends early where every longer prefix has over ``most``."""
        out, text, last, count = [], "", [0], [0]
        for char in run:
            for b in char.encode():
                text += self.letters[b]
                last.append(self.last_token(text, last, len(last), False))
                count.append(count[-last[-1]] + 1 if last[-1] < len(count) else 1)
            out.append(count[len(text) - self.last_token(text, last, len(text), True)] + 1)
            # any longer prefix goes through one of the last places
            if most is not None and min(count[-self.longest :]) >= most:
                break
        return out

    def of_piece(self, piece: str, most: int | None) -> list[int]:
        if len(piece) < 4:  # a contraction falls apart where it is cut
            return [sum(self.of_run(p)[-1] for p in self.pieces.findall(piece[:k])) for k in range(1, len(piece) + 1)]
        return self.of_run(piece, most)

    def of_text(self, text: str, most: int | None) -> list[int]:
        """Tokens of the first 1, 2, ... characters of plain text in lower case; ends early where every longer prefix has over ``most``."""
        out: list[int] = []
        before = 0
        for piece in self.pieces.finditer(text):
            if most is not None and before >= most:
                break
            own = self.of_piece(piece.group(), None if most is None else most - before)
            out += [before + x for x in own]
            if len(own) < len(piece.group()):
                break
            before += own[-1]
        return out

    def of_word(self, word: str, most: int | None = None) -> list[int]:
        """Tokens of the first 1, 2, ... characters of a word in normal form C (no white space);
        ends early where every longer prefix has over ``most``."""
        parts = regex.split("(" + "|".join(regex.escape(x) for x in self.special) + ")", word) if self.special else [word]
        out: list[int] = []
        base = 0
        for part, special in zip(parts[::2], [*parts[1::2], ""]):
            # no token is longer than `longest`, so prefixes of over this many characters go beyond `most`
            reach = len(word) if most is None else (most - base + 1) * self.longest + 1
            if len(part) > reach:
                part, special = part[:reach], ""
            # a cut special token is plain text
            chars = [c.lower() for c in part + special[:-1]]
            ends = np.cumsum([len(c) for c in chars]).tolist()
            own = ends[len(part) - 1] if part else 0
            counts = self.of_text("".join(chars), None if most is None else most - base)
            if len(counts) < own or not special:
                return out + [base + counts[e - 1] for e in ends if e <= len(counts)]
            if ends and len(counts) < ends[-1]:  # the whole special token may count less than a cut one
                counts = self.of_text("".join(chars), None)
            out += [base + counts[e - 1] for e in ends]
            if special:
                base += (counts[own - 1] if part else 0) + 1
                out.append(base)
                if most is not None and base >= most:
                    break
        return out


_runs: dict[int, RunCounts] = {}


def runs_of(enc: WordEncoder) -> RunCounts:
    if id(enc) not in _runs:
        _runs[id(enc)] = RunCounts(enc)
    return _runs[id(enc)]


class PrefixCounts:
    """The table of one text: ``ends[i]`` characters and ``counts[i]`` tokens up to word i's end.

    Inside a word the dynamic programme counts, once for each distinct word that is asked about; no text is encoded again.
    """

    #: Counts at the prefixes of words, shared by the texts of a Python worker.
    kept: dict[str, np.ndarray] = {}

    def __init__(self, enc: WordEncoder, text: str, by_word: list[bytes] | None = None):
        self.enc, self.text = enc, text
        self.words = enc.words(text)
        by_word = enc.ids_by_word([text])[0] if by_word is None else by_word
        n = len(self.words)
        self.counts = np.cumsum(np.fromiter(map(len, by_word), np.int64, n) // 4)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, n) + 1) - 1
        self.total = int(self.counts[-1])

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters of the text."""
        if chars <= 0:
            return 0
        if chars >= len(self.text):
            return self.total
        w = int(np.searchsorted(self.ends, chars))
        before = int(self.counts[w - 1]) if w else 0
        start = int(self.ends[w - 1]) + 1 if w else 0
        if chars <= start:
            return before
        word = self.words[w]
        if len(word) >= token_ids.LONG:  # its prefixes are not kept: only as far as asked
            return before + self.in_word(word[: chars - start])[-1]
        return before + int(self.of_word(word)[chars - start - 1])

    def of_word(self, word: str) -> np.ndarray:
        """``in_word`` of a word of under LONG characters, kept for each distinct word."""
        known = self.kept.get(word)
        if known is None:
            if len(self.kept) > PREFIXES_KEPT:
                self.kept.clear()
            known = self.kept[word] = np.array(self.in_word(word), np.int32)
        return known

    def in_word(self, word: str, most: int | None = None) -> list[int]:
        """Tokens of the first 1, 2, ... characters of a word; may end where every longer prefix has over ``most``."""
        runs = runs_of(self.enc)
        out: list[int] = []
        base = 0
        for part in regex.split(r"(\s)", word):  # white space other than blanks and line ends parts words too
            if regex.fullmatch(r"\s", part):
                out.append(base)
                continue
            left = None if most is None else most - base
            if unicodedata.is_normalized("NFC", part):
                own = runs.of_word(part, left)
            elif len(part) < token_ids.LONG:
                own = [runs.of_word(unicodedata.normalize("NFC", part[:k]))[-1] for k in range(1, len(part) + 1)]
            else:
                own = self._composed(part, left)
            out += [base + n for n in own]
            if len(own) < len(part):
                break
            base = out[-1] if own else base
        return out

    def _composed(self, word: str, most: int | None) -> list[int]:
        """``in_word`` of a long word that is not in normal form, in parts that no composition crosses: a prefix that ends inside one counts as the one after it."""
        parts = regex.findall(r"\P{M}?\p{M}+|[\u1100-\u115F]?[\u1160-\u11FF]+|.", word, regex.DOTALL)
        whole = [unicodedata.normalize("NFC", p) for p in parts]
        counts = runs_of(self.enc).of_word("".join(whole), most)
        out: list[int] = []
        for part, end in zip(parts, np.cumsum([len(x) for x in whole]).tolist()):
            if end > len(counts):
                break
            out += [counts[end - 1]] * len(part)
        return out

    def every(self) -> np.ndarray:
        """Tokens at each of the prefixes of 0, 1, ... characters."""
        out = np.empty(len(self.text) + 1, np.int64)
        out[0], start, before = 0, 0, 0
        for word, count in zip(self.words, self.counts.tolist(), strict=True):
            if word:
                out[start + 1 : start + len(word) + 1] = before + (self.of_word(word) if len(word) < token_ids.LONG else np.array(self.in_word(word)))
            if start + len(word) < len(self.text):
                out[start + len(word) + 1] = count
            before, start = count, start + len(word) + 1
        return out

    def fits(self, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens.

        Only the word that goes beyond is looked into, and of a long one no more than the budget asks for.
        """
        if self.total <= budget:
            return len(self.text)
        w = int(np.searchsorted(self.counts, budget, "right"))  # the first word that goes beyond
        before = int(self.counts[w - 1]) if w else 0
        start = int(self.ends[w - 1]) + 1 if w else 0
        most = budget - before
        best = max((k for k, n in enumerate(self.in_word(self.words[w], most), 1) if n <= most), default=0)
        return min(start + best, len(self.text))


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, word_ends array<int>, word_counts array<int>"


def prefix_token_counts(docs: DataFrame, budget: int = 2048, tokenizer: str | None = None, store: bool = True) -> DataFrame:
    """Per document: bytes, tokens, whether it goes over ``budget``, the
    characters that fit it, and (``store``) the table of prefix counts at the
    ends of words.

    A null text counts as empty; an empty text has 0 tokens. Repeated rows
    come out as often as they came in; other columns are not read, and an empty table gives
    no rows. In a word of LONG characters and more that is not in normal form C, a
    prefix that ends inside a composed character counts as the one at its end.
    """
    path = tokenizer or default_path()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for frame in frames:
            for at in range(0, len(frame), 256):
                some = frame.iloc[at : at + 256]
                texts = some["text"].tolist()
                tables = []
                for lo in range(0, len(texts), 64):
                    part = texts[lo : lo + 64]
                    tables += [PrefixCounts(enc, text, by_word) for text, by_word in zip(part, enc.ids_by_word(part), strict=True)]
                n = np.array([t.total for t in tables], np.int64)
                yield pd.DataFrame({
                    "doc_id": some["doc_id"].to_numpy(), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": n > budget, "fit_chars": [t.fits(budget) for t in tables],
                    "word_ends": [t.ends.astype(np.int32) if store else None for t in tables], "word_counts": [t.counts.astype(np.int32) if store else None for t in tables],
                }).astype({"doc_id": "Int64"})

    return narrow(docs).mapInPandas(count, SCHEMA)


def token_totals(tables: DataFrame, budget: int = 2048) -> DataFrame:
    """Answers from stored tables of prefix counts, without the texts or the tokenizer: tokens, whether
    they go over ``budget``, and the words that fit it. Repeated rows come out each; an empty table gives no rows."""
    from pyspark.sql import functions as F

    last = F.element_at("word_counts", -1).cast("long")
    fit = F.size(F.filter("word_counts", lambda n: n <= budget)).cast("long")
    return tables.select("doc_id", "n_bytes", last.alias("n_tokens"), (last > budget).alias("over_limit"), "fit_chars", fit.alias("fit_words"), F.size("word_ends").cast("long").alias("n_words"))
