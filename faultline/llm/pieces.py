"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text's spaces become the piece model's space mark, one mark is put in front,
and the text is cut before every run of marks: no piece of the vocabulary holds a
mark after another character, so no merge crosses a cut. Distinct words are
encoded together in flat arrays: symbols, their word, and the rank of each
adjacent pair. A round finds the least rank of each word (segmented minimum),
merges its leftmost pair of that rank in all words at once, and drops merged
symbols and finished words. Where no better pair can arise from a merged piece,
all its places in a word that don't overlap are merged in the same round, which
gives what merging them one by one would. Symbols outside the vocabulary become
byte pieces.

Cases: null and empty texts have no ids and decode to the empty text; a text's
own space marks are read as spaces; words of any length and runs of spaces are
encoded whole; repeated rows give equal rows; an empty table gives an empty
result. The model must be BPE with byte fallback, identity normalisation, a
dummy prefix and no pieces with inner marks; others are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import in_steps
from .words import Memory, gather, strings

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = np.int64(1 << 40)
_SHIFT = 21  # symbol numbers stay below 2^21: pieces, then code points without a piece
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

codecs.register_error("one_mark_a_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """Tables of a model file: symbols of code points, and ranks of adjacent pairs."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
        self.bytes_at = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_at) != 256 or any(MARK in x.lstrip(MARK) for x, p in zip(names, plain, strict=True) if p) or sp.normalize(" ﬁ  a ") != MARK + MARK + "ﬁ" + MARK + MARK + "a" + MARK:
            raise ValueError("the model isn't BPE with byte fallback, identity normalisation and a dummy prefix")
        self.n = n
        number = {x: i for i, (x, p) in enumerate(zip(names, plain, strict=True)) if p}
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = np.unique(-scores[[i for i in range(n) if plain[i]]])
        rank = np.searchsorted(order, -scores)
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        for x, i in number.items():
            if len(x) == 1:
                self.symbol[ord(x)] = i
        of = lambda s: number.get(s, n + ord(s) if len(s) == 1 else None)
        pairs, unsafe = [], set()
        for x, i in number.items():
            for k in range(1, len(x)):
                left, right = of(x[:k]), of(x[k:])
                if left is not None and right is not None:
                    pairs.append(((left << _SHIFT) | right, rank[i], i))
                    unsafe.update(p for p in (left, right) if p < n and rank[i] <= rank[p])
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.alone = np.zeros(n, bool)
        self.alone[list(unsafe)] = True
        raw = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace(MARK, " ").encode() if plain[i] else b" \xe2\x81\x87 " if sp.is_unknown(i) else b"" for i, x in enumerate(names)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.fromiter(map(len, raw), np.int64, n)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.leading = np.array([p and x.startswith(MARK) for x, p in zip(names, plain, strict=True)])
        self.decimal = np.array([str(i) for i in range(n)], object)
        self.memory = Memory(self.encode_words)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NONE if it doesn't merge), and the piece that it makes."""
        keys = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.ranks[at], _NONE), self.made[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. A word is a run of marks and what follows up to the next."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, owner = self.symbol[chars], np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        rank, made = self._pairs(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == _NONE, lengths)
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                go = ~over
                symbols, owner, rank, made = symbols[go], owner[go], rank[go], made[go]
                lengths, least = lengths[least != _NONE], least[least != _NONE]
            if not len(symbols):
                break
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            first = np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]
            run = first | np.r_[True, np.diff(hits) > 1]
            since = hits - hits[np.flatnonzero(run)][np.cumsum(run) - 1]
            hits = hits[first | (~self.alone[made[hits]] & (since % 2 == 0))]
            symbols[hits] = made[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            near = place[hits]
            near = np.unique(np.r_[near, near[near > 0] - 1])
            self._refresh(symbols, owner, rank, made, near)
        symbols = np.concatenate(done_symbols) if done_symbols else symbols
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        return self._with_bytes(symbols[order], np.bincount(owner, minlength=len(words)), owner[order])

    def _with_bytes(self, symbols: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and how many each word has, with byte pieces for symbols outside the vocabulary."""
        if not (symbols >= self.n).any():
            return symbols, counts
        other, which = np.unique(np.where(symbols < self.n, -1, symbols), return_inverse=True)
        spelt = [[0] if c < 0 else [self.bytes_at[b] for b in chr(c - self.n).encode("utf-8", "surrogatepass")] for c in other.tolist()]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        each = sizes[which]
        ids = gather(np.array([i for x in spelt for i in x], np.int64), (np.cumsum(sizes) - sizes)[which], each)
        kept = np.repeat(symbols < self.n, each)
        ids[kept] = symbols[symbols < self.n]
        return ids, np.bincount(owner, each, len(counts)).astype(np.int64)

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        self._refresh(symbols, owner, rank, made, np.arange(len(symbols)))
        return rank, made

    def _refresh(self, symbols, owner, rank, made, at) -> None:
        """Look up anew the pairs that begin at these places."""
        rank[at] = _NONE
        at = at[at + 1 < len(symbols)]
        at = at[owner[at] == owner[at + 1]]
        rank[at], made[at] = self.look_up(symbols[at], symbols[at + 1])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        owners = pc.list_parent_indices(lists).to_numpy()
        d = pc.list_flatten(lists).dictionary_encode()
        codes, distinct = d.indices.to_numpy(zero_copy_only=False), strings(d.dictionary)
        odd_piece = np.array([not x or MARK in x for x in distinct], bool)
        odd = np.zeros(len(texts), bool)
        odd[owners[odd_piece[codes]]] = True
        plain = ~odd[owners]
        words: dict[str, int] = {}
        number = lambda s: words.setdefault(s, len(words))
        of = np.fromiter((number(MARK + x) for x in distinct), np.int64, len(distinct))
        word, owner = of[codes[plain]], owners[plain]
        if odd.any():
            more, theirs = [], []
            for i in np.flatnonzero(odd):
                text = texts[i].as_py()
                cut = _WORD.findall(MARK + text.replace(" ", MARK)) if text else []
                more += [number(x) for x in cut]
                theirs += [i] * len(cut)
            owner, word = np.r_[owner, np.array(theirs, np.int64)], np.r_[word, np.array(more, np.int64)]
            order = np.argsort(owner, kind="stable")
            owner, word = owner[order], word[order]
        names = list(words)
        used, word = np.unique(word, return_inverse=True)
        slots = self.memory.slots([names[k] for k in used])[word]
        sizes = self.memory.sizes[slots]
        counts = np.bincount(owner, sizes, len(texts)).astype(np.int64)
        return gather(self.memory.flat, self.memory.starts[slots], sizes), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids: byte pieces are joined, the dummy prefix is taken off."""
        sizes = self.raw_sizes[ids]
        data = gather(self.raw, self.raw_starts[ids], sizes).tobytes()
        ends = np.cumsum(counts)
        bounds = np.r_[0, np.cumsum(sizes)][np.r_[0, ends]]
        begins = np.zeros(len(counts), bool)
        some = counts > 0
        begins[some] = self.leading[ids[(ends - counts)[some]]]
        out = []
        for a, b, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), begins.tolist(), strict=True):
            part = data[a + k : b]
            try:
                part.decode()
            except UnicodeDecodeError:
                part = part.decode("utf-8", "one_mark_a_byte").encode()
            out.append(part)
        return out


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_texts(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of whole texts."""

    def work(batch):
        ids, counts = model(path).encode(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], schema=ENCODED)

    return df.select("doc_id", "text").mapInArrow(in_steps("text", work), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of encoded rows; null ids are none."""

    def run(batches):
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), [])
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = model(path).decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode() for x in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, so ids don't leave the worker."""

    def work(batch):
        m = model(path)
        ids, counts = m.encode(batch.column("text"))
        words, ends = m.decimal[ids].tolist(), np.cumsum(counts)
        sums = [hashlib.sha256(",".join(words[b - n : b]).encode()).hexdigest() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        texts = [hashlib.sha256(x).hexdigest() for x in m.decode(ids, counts)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(sums), pa.array(texts)], schema=_DIGESTS)

    return df.select("doc_id", "text").mapInArrow(in_steps("text", work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
