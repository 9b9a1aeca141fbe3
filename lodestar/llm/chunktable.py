"""Tokenise whole texts through a table of distinct chunks.

A chunk is what lies between two lone spaces. Where the tokenizer never lets a token cross the start of such a chunk,
every distinct chunk is tokenised once per worker and the ids are joined back by position with array gathers.
Texts where that doesn't hold go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20
TABLE_ROWS = 700_000
Ids = tuple[np.ndarray, np.ndarray]


class ChunkTable:
    """ids of texts from ids of distinct chunks.

    encode: list of strings -> (their ids one after another, number of ids of each). irregular: RE2 pattern of texts that
    must be encoded whole, None if every text can be cut at every space. prepare: a change of the other texts that doesn't
    change their ids. opening: a text's first chunk has ids of its own, and encode gets it with a space before it. When the
    table would hold over `rows` chunks, those go that only one slice of rows has asked for. Chunks that a slice of rows
    has once only are encoded for it alone.
    """

    def __init__(self, encode: Callable[[list[str]], Ids], irregular: str | None, rows: int = TABLE_ROWS, prepare: Callable[[pa.Array], pa.Array] = lambda texts: texts, opening: bool = False):
        self.encode_batch, self.irregular, self.limit, self.prepare, self.opening = encode, irregular, rows, prepare, opening
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.values = np.empty(1 << 16, np.uint16)
        self.used = 0
        self.starts, self.counts, self.asked = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def _store(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        base, at = len(self.index), self.used
        while at + len(flat) > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        while base + len(words) > len(self.starts):
            self.starts, self.counts, self.asked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.asked))
        self.values[at : at + len(flat)] = flat
        self.used += len(flat)
        self.counts[base : base + len(words)] = counts
        self.starts[base : base + len(words)] = at + np.cumsum(counts) - counts
        self.index.update(zip(words, range(base, base + len(words)), strict=True))

    def _trim(self) -> None:
        """Keep the chunks that several slices have asked for, up to half of the rows."""
        kept = [(w, i) for w, i in self.index.items() if self.asked[i] > 1][: self.limit // 2]
        rows = np.fromiter((i for _, i in kept), np.int64, len(kept))
        counts, ends = self.counts[rows], np.cumsum(self.counts[rows])
        flat = self.values[np.repeat(self.starts[rows] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        self._clear()
        self._store([w for w, _ in kept], flat, counts)

    def _find(self, words: list[str], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each distinct word's ids begin, their number, ids); words that aren't frequent here don't enter the table."""
        rows = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        there = rows >= 0
        self.asked[rows[there]] += 1
        starts, counts, values = self.starts[rows], self.counts[rows], self.values[: self.used]
        missing = np.flatnonzero(~there)
        if len(missing):
            flat, n = self.encode_batch([words[i] for i in missing])
            starts[missing], counts[missing] = len(values) + np.cumsum(n) - n, n
            values = np.concatenate([values, flat])
            kept = often[missing]
            if kept.any():
                if len(self.index) + int(kept.sum()) > self.limit:
                    self._trim()
                self._store([words[i] for i in missing[kept]], flat[np.repeat(kept, n)], n[kept])
        return starts, counts, values

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(self.prepare(texts), " ")
        bounds = np.asarray(parts.offsets, np.int64)
        bounds = bounds - bounds[0]
        coded = parts.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
        first = bounds[:-1]
        if self.opening:
            opening, place = np.unique(at[first], return_inverse=True)
            at[first] = len(words) + place
            words += [f" {words[i]}" for i in opening]
        starts, counts, values = self._find(words, np.bincount(at, minlength=len(words)) > 1)
        counts = counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(starts[at] - (ends - counts), counts) + np.arange(total)
        lengths = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
        return values[take], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of ids of each text); a null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, self.irregular)) if self.irregular else np.zeros(len(texts), bool)
        if not odd.any():
            return self._regular(texts)
        lead = " " if self.opening else ""
        return _merged(~odd, *self._regular(texts.filter(pa.array(~odd))), *self.encode_batch([lead + t for t in texts.filter(pa.array(odd)).to_pylist()]))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text; a longer text has a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    group = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(group, group[at] + most, "right")) - 1)
        yield at, end
        at = end


def _path(name: str) -> str:
    """A file name of the installed tokenizers, or a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def as_ids(lists: list[list[int]]) -> Ids:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint16, int(counts.sum())), counts


def _merged(mask: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> Ids:
    """Ids of texts in order: a and their numbers na where mask holds, else b and nb."""
    counts = np.empty(len(mask), np.int64)
    counts[mask], counts[~mask] = na, nb
    out, own = np.empty(len(a) + len(b), np.uint16), np.repeat(mask, counts)
    out[own], out[~own] = a, b
    return out, counts


#: A sign that gets a word of its own between joined chunks; chunks that hold it are encoded alone.
SIGN, JOINED = "\u241e", 1500


def joined_encoder(tokenizer) -> Callable[[list[str]], Ids]:
    """Encodes many chunks in one call of the library, with a sign between them, and cuts the ids at the sign's ids.

    The sign stands between spaces and so is a word of its own; the tokenizer must drop white space.
    """

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int64) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    gap = f" {SIGN} "
    sign = encode([gap])[0]

    def plain(chunks: list[str]) -> Ids:
        flats, counts = [], []
        for at in range(0, len(chunks), JOINED):
            part = chunks[at : at + JOINED]
            (ids,) = encode([gap.join(part)])
            is_sign = np.ones(max(0, len(ids) - len(sign) + 1), bool)
            for k, value in enumerate(sign):
                is_sign &= ids[k : len(ids) - len(sign) + 1 + k] == value
            ends = np.flatnonzero(is_sign)
            if len(ends) != len(part) - 1:
                raise ValueError("the chunks can't be told apart")
            starts = np.concatenate([[0], ends + len(sign)])
            counts.append(np.concatenate([ends, [len(ids)]]) - starts)
            keep = np.ones(len(ids), bool)
            for k in range(len(sign)):
                keep[ends + k] = False
            flats.append(ids[keep].astype(np.uint16))
        return np.concatenate(flats), np.concatenate(counts)

    def alone(chunks: list[str]) -> Ids:
        return as_ids([x.tolist() for a in range(0, len(chunks), 256) for x in encode(chunks[a : a + 256])])

    def run(chunks: list[str]) -> Ids:
        odd = [SIGN in c for c in chunks]
        if not any(odd):
            return plain(chunks)
        a, na = plain(usual) if (usual := [c for c, o in zip(chunks, odd, strict=True) if not o]) else as_ids([])
        b, nb = alone([c for c, o in zip(chunks, odd, strict=True) if o])
        return _merged(~np.array(odd), a, na, b, nb)

    return run


#: A lower-case word whose letters no normaliser changes.
_SIMPLE = re.compile("[a-zß-öø-ÿ]+")
#: A word of letters, and signs after it that are the tokenizer's next word.
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Byte-level vocabularies show a byte as its Latin-1 character, except that later ones stand in for those without a sign.
_UNSIGNED = [*range(33), *range(127, 161), 173]
_SHOWN = "".join(chr(256 + _UNSIGNED.index(b)) if b in _UNSIGNED else chr(b) for b in range(256))


def _shown(w: str) -> str:
    return w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN)


def _as_words(texts: pa.Array) -> pa.Array:
    """For a tokenizer that lowers case and drops white space: fewer distinct chunks, with the same ids.

    A comma or full stop after a letter and before a space is a word of its own there, and so may stand apart.
    """
    texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
    return pc.replace_substring_regex(texts, r"([a-z\x{DF}-\x{F6}\x{F8}-\x{FF}])([.,])( |$)", r"\1 \2\3")


def word_encoder(tokenizer) -> Callable[[list[str]], Ids]:
    """Encodes chunks of a lower-casing tokenizer: simple words by its model alone, other chunks by the whole tokenizer."""
    model, other = tokenizer.model, joined_encoder(tokenizer)

    def ids_of(w: str) -> list[int]:
        return [t.id for t in model.tokenize(_shown(w))]

    def run(chunks: list[str]) -> Ids:
        mask = np.array([_SIMPLE.fullmatch(c) is not None for c in chunks], bool)
        a, na = as_ids([ids_of(c) for c, simple in zip(chunks, mask, strict=True) if simple])
        hard = [c for c, simple in zip(chunks, mask, strict=True) if not simple]
        b, nb = other(hard) if hard else as_ids([])
        return _merged(mask, a, na, b, nb)

    return run


#: White space next to a space: there the byte-level tokenizer's pieces don't begin at the space.
_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_OPENED: dict[str, ChunkTable] = {}


def _library(name: str):
    """(the tokenizer of a file as it is, its description). Strings of its special tokens in a text become those tokens."""
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_path(name))
    return t, json.loads(t.to_str())


def word_table(name: str) -> ChunkTable:
    """A chunk table over a tokenizers file that lowers case and drops white space."""
    if name not in _OPENED:
        t, about = _library(name)
        steps = [x["type"] for x in (about["normalizer"] or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the tokenizer doesn't lower case and drop white space")
        # Special tokens are found before case is lowered, so texts with anything like them go whole.
        special = "|".join(re.escape(x["content"]) for x in about["added_tokens"])
        _OPENED[name] = ChunkTable(word_encoder(t), f"(?i){special}" if special else None, prepare=_as_words)
    return _OPENED[name]


def byte_table(name: str) -> ChunkTable:
    """A chunk table over a byte-level tokenizers file: a lone space opens a chunk, which begins with it."""
    if name not in _OPENED:
        t, about = _library(name)
        kind = about["pre_tokenizer"] or {}
        if about["normalizer"] or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in about["added_tokens"]):
            raise ValueError("the tokenizer isn't a plain byte-level one")

        opens = np.zeros(t.get_vocab_size(), bool)  # ids that begin with a space
        opens[[i for piece, i in t.get_vocab().items() if piece.startswith(_SHOWN[32])]] = True
        special = "|".join(re.escape(x["content"]) for x in about["added_tokens"])
        plain = re.compile(rf"(?!.*(?:{special}))\S(?:.*\S)?" if special else r"\S(?:.*\S)?", re.S)

        def alone(texts: list[str]) -> Ids:
            return as_ids([x.ids for a in range(0, len(texts), 256) for x in t.encode_batch_fast(texts[a : a + 256], add_special_tokens=False)])

        def joined(chunks: list[str]) -> Ids:
            flats, counts = [], []
            for a in range(0, len(chunks), JOINED):
                part = chunks[a : a + JOINED]
                ids = np.array(t.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
                starts = np.flatnonzero(opens[ids])
                if len(starts) != len(part):
                    raise ValueError("the chunks can't be told apart")
                flats.append(ids)
                counts.append(np.diff(np.append(starts, len(ids))))
            return np.concatenate(flats), np.concatenate(counts)

        model, signs = t.model, {"": []}

        def of_letters(found: re.Match) -> list[int]:
            ids, end = [x.id for x in model.tokenize(_SHOWN[32] + _shown(found[1]))], found[2]
            if end not in signs:
                if len(signs) > 10_000:
                    signs.clear()
                signs[end] = [x.id for x in model.tokenize(end)]
            return ids + signs[end]

        def other(chunks: list[str]) -> Ids:
            easy = [plain.fullmatch(c) is not None for c in chunks]
            a, na = joined([c for c, e in zip(chunks, easy, strict=True) if e]) if any(easy) else as_ids([])
            b, nb = alone([c[1:] if c.startswith(" ") else f" {c}" for c, e in zip(chunks, easy, strict=True) if not e])
            return _merged(np.array(easy, bool), a, na, b, nb)

        def encode(chunks: list[str]) -> Ids:
            found = list(map(_LETTERS.fullmatch, chunks))
            a, na = as_ids([of_letters(m) for m in found if m is not None])
            b, nb = other([c for c, m in zip(chunks, found, strict=True) if m is None])
            return _merged(np.array([m is not None for m in found], bool), a, na, b, nb)

        _OPENED[name] = ChunkTable(encode, f"^ | $|{_WHITE} | {_WHITE}", opening=True)
    return _OPENED[name]
