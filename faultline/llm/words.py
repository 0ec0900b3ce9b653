"""Ids of whole texts by way of their distinct words.

A library call per distinct word instead of per word: texts are cut only where
no token of the library can cross, each distinct piece is encoded once per
worker (up to a bound of remembered pieces), and the ids of texts are gathered
with numpy. Two kinds of tokenizers files are known, by how they cut and
lower-case; others are refused.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import BLANKS, STEP_BYTES

#: Pieces that a worker remembers, at about 200 bytes each; beyond, it keeps those of the present step that it knew already.
REMEMBERED = 600_000
_BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
#: Texts with a blank at an end or beside a space, and empty ones.
_ODD = rf"\A(?:\z|{_BLANK})|{_BLANK}\z| {_BLANK}|{_BLANK} "
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = rf" ?[{_LETTERS}]+[{re.escape(_MARKS)}]*"
#: A word of Latin letters with the marks after it, if any; two of them with a line break between. The known tokenizers cut before marks and around the break.
_PLAIN, _TWO, _BARE = rf"\A{_WORD}\z", rf"\A{_WORD}\n{_WORD[2:]}\z", rf"\A ?[{_LETTERS}]+\z"
_IN_WORDS = "".join(c for c in map(chr, range(32, 256)) if re.fullmatch(f"[ {_LETTERS}]", c))


def strings(column: pa.StringArray) -> list[str]:
    """The column as a list, made in one step rather than by scalars."""
    return column.to_numpy(zero_copy_only=False).tolist()


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each start and size, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def _true(mask: pa.BooleanArray) -> np.ndarray:
    return mask.to_numpy(zero_copy_only=False)


def _ids_of(tokens: list) -> list[int]:
    return [t.id for t in tokens]


class Memory:
    """Slots of pieces with their ids, in arrays that grow.

    encode gives the ids of all pieces, one piece after the other, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype=np.int32, limit: int = REMEMBERED):
        self.encode, self.limit, self.dtype = encode, limit, dtype
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.used, self.n = np.zeros(1 << 16, self.dtype), 0, 0
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _store(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        at, n = self.n, len(pieces)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[at : at + n] = sizes
        self.starts[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), at + n
        self.slot.update(zip(pieces, range(at, at + n), strict=True))

    def _find(self, pieces: list[str]) -> np.ndarray:
        """Slots, -1 for unknown pieces."""
        return np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))

    def _forget(self, pieces: list[str]) -> None:
        """Keep the pieces that recur, those known and needed again, up to half the limit."""
        again = list(dict.fromkeys(x for x in pieces if x in self.slot))[: self.limit // 2]
        at = self._find(again)
        sizes = self.sizes[at]
        flat = gather(self.flat, self.starts[at], sizes)
        self.clear()
        self._store(again, flat, sizes)

    def slots(self, pieces: list[str]) -> np.ndarray:
        """Slots of pieces; new ones are encoded."""
        at = self._find(pieces)
        new = np.flatnonzero(at < 0)
        if len(self.slot) + len(new) > self.limit and self.slot:
            self._forget(pieces)
            at = self._find(pieces)
            new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self.n + np.arange(len(new))
            fresh = [pieces[i] for i in new.tolist()]
            self._store(fresh, *self.encode(fresh))
        return at


class Library:
    """A tokenizers file, one per worker process, and what it remembers.

    spaced: byte-level, words begin with a space; else the tokenizer drops white space and lower-cases.
    A task has one core: the library gets no threads.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        how = json.loads(self.whole.to_str())
        cuts, normal = how["pre_tokenizer"] or {}, how["normalizer"]
        steps = [x["type"] for x in cuts.get("pretokenizers", [])]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or set(x["content"]) & set(BLANKS) for x in how["added_tokens"]):
            raise ValueError("an added token takes in what is around it, or holds white space")
        if how["model"]["type"] == "BPE" and cuts.get("type") == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"] and normal is None:
            self.spaced = True
        elif steps == ["Split", "ByteLevel"] and cuts["pretokenizers"][0]["behavior"] == "Removed" and normal and [x["type"] for x in normal["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            self.spaced = False
        else:
            raise ValueError("the tokenizer is neither byte-level without a normaliser nor one that lower-cases and drops white space")
        ids = lambda x: self.whole.encode(x, add_special_tokens=False).ids
        cut = ["Éa", ".", " ab", ",", " c", _MARKS, "\n", "D", "!!", "\n", "àÈ", "\n", "e"]
        if ids("".join(cut)) != [i for x in cut for i in ids(x)]:
            raise ValueError("the tokenizer doesn't cut at marks, spaces and line breaks")
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        self.letters = np.zeros(256, np.uint32)  # the byte-level alphabet; line breaks stay to separate words
        self.letters[printed], self.letters[others], self.letters[10] = printed, 256 + np.arange(len(others)), 10
        self.memory = Memory(self._encode)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bare words are one word for the tokenizer's cuts: they go to its merges at once. Others take the whole way."""
        bare = _true(pc.match_substring_regex(pa.array(pieces, pa.string()), _BARE))
        words, rest = [x for x, b in zip(pieces, bare.tolist(), strict=True) if b], [x for x, b in zip(pieces, bare.tolist(), strict=True) if not b]
        spelt = self.letters[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\n") if words else []
        sizes, ids = np.zeros(len(pieces), np.int64), []
        for mask, found in ((bare, map(_ids_of, map(self.model.tokenize, spelt))), (~bare, (e.ids for e in self.whole.encode_batch_fast(rest, add_special_tokens=False)))):
            here, n = [], []
            for x in found:
                n.append(len(x))
                here += x
            sizes[mask] = n
            ids.append((mask, np.array(here, np.int64)))
        ends = np.cumsum(sizes)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for mask, values in ids:
            at, n = (ends - sizes)[mask], sizes[mask]
            flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
        return flat, sizes

    def expand(self, pieces: pa.StringArray, codes: np.ndarray, owners: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has; codes index pieces, owners are ascending.

        A piece is up to two words with marks each and a line break between them, each of which is looked up apart.
        """
        two = _true(pc.match_substring_regex(pieces, _TWO))
        units = pa.concat_arrays([pieces.filter(pa.array(~two)), pc.list_flatten(pc.split_pattern(pieces.filter(pa.array(two)), "\n"))])
        plain = pc.match_substring_regex(units, _PLAIN)
        if not self.spaced:
            units = pc.if_else(plain, pc.utf8_lower(units), units)
        stems = pc.if_else(plain, pc.utf8_rtrim(units, _MARKS), units)
        tails = pc.if_else(plain, pc.utf8_ltrim(units, _IN_WORDS), "")
        both = pa.concat_arrays([stems, tails, pa.array(["", "\n"])]).dictionary_encode()
        slots = self.memory.slots(strings(both.dictionary))[both.indices.to_numpy()]
        stems, tails, (none, line) = slots[: len(units)], slots[len(units) : -2], slots[-2:]
        parts = np.full((len(pieces), 5), none)
        single = len(pieces) - int(two.sum())
        parts[~two, 0], parts[~two, 1] = stems[:single], tails[:single]
        parts[two, 0], parts[two, 1], parts[two, 2], parts[two, 3], parts[two, 4] = stems[single::2], tails[single::2], line, stems[single + 1 :: 2], tails[single + 1 :: 2]
        sizes = self.memory.sizes[parts]
        flat = gather(self.memory.flat, self.memory.starts[parts.ravel()], sizes.ravel())
        sizes = sizes.sum(1)
        each = sizes[codes]
        return gather(flat, (np.cumsum(sizes) - sizes)[codes], each), np.bincount(owners, each, n_docs).astype(np.int64)


class Words:
    """Texts cut at ASCII white space: the words of all, which text each is of, and their number among the distinct ones."""

    def __init__(self, texts: pa.StringArray):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        self.n = len(texts)
        self.owners = pc.list_parent_indices(lists).to_numpy()
        d = pc.list_flatten(lists).dictionary_encode()
        self.codes, self.distinct = d.indices.to_numpy(zero_copy_only=False), d.dictionary


def encode_blank_free(words: Words, library: Library) -> tuple[np.ndarray, np.ndarray]:
    """For a tokenizer whose tokens hold no white space and that drops it."""
    return library.expand(words.distinct, words.codes, words.owners, words.n)


def encode_spaced(texts: pa.StringArray, library: Library) -> tuple[np.ndarray, np.ndarray]:
    """For a byte-level tokenizer whose words begin with a space: texts are cut before single spaces between two non-blanks."""
    if (text := long_text(texts)) is not None:
        ids = np.concatenate([encode_spaced(pa.array([x]), library)[0] for x in portions(text)])
        return ids, np.array([len(ids)])
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    owners = pc.list_parent_indices(lists).to_numpy()
    d = pc.list_flatten(lists).dictionary_encode()
    codes, distinct = d.indices.to_numpy(zero_copy_only=False), d.dictionary
    odd = _true(pc.match_substring_regex(texts, _ODD))
    first = np.r_[True, owners[1:] != owners[:-1]] if len(owners) else np.zeros(0, bool)
    plain = ~odd[owners]
    word = codes.astype(np.int64)
    heads = np.flatnonzero(first & plain)
    word[heads] = len(distinct) + np.arange(len(heads))
    # All but a text's first word begin with a space.
    pieces = [pc.binary_join_element_wise(" ", distinct, ""), distinct.take(pa.array(codes[heads]))]
    if odd.any():
        word, owners, extra, theirs = word[plain], owners[plain], [], []
        for i in np.flatnonzero(odd):
            cut = _CUT.split(texts[i].as_py())
            extra += [x if not k else " " + x for k, x in enumerate(cut)]
            theirs += [i] * len(cut)
        pieces.append(pa.array(extra, pa.string()))
        owners, word = np.r_[owners, theirs], np.r_[word, len(distinct) + len(heads) + np.arange(len(extra))]
        order = np.argsort(owners, kind="stable")
        owners, word = owners[order], word[order]
    return library.expand(pa.concat_arrays(pieces), word, owners, len(texts))


def portions(text: str, limit: int = STEP_BYTES) -> Iterator[str]:
    """A long text in portions of about limit characters, cut before single spaces between two non-blanks; together they are the text."""
    start = 0
    while len(text) - start > limit and (cut := _CUT.search(text, start + limit)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def long_text(texts: pa.StringArray, limit: int = STEP_BYTES) -> str | None:
    """The text, if it is the only one and so long that it is better worked through in portions."""
    text = texts[0].as_py() if len(texts) == 1 else None
    return text if text is not None and len(text) > 2 * limit else None


_loaded: dict[str, Library] = {}


def library(path: str, spaced: bool) -> Library:
    """The library of a file, one per worker process."""
    if path not in _loaded:
        _loaded[path] = Library(path)
    if _loaded[path].spaced != spaced:
        raise ValueError(f"{path} {'drops' if spaced else 'keeps'} white space")
    return _loaded[path]
