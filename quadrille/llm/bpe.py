"""Operator 3: BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves' left neighbours: leaf i holds (rank of the pair at i, i), inner nodes
the minimum, so the root names the leftmost merge of the lowest rank.  A merge changes at most three
leaves, each in logarithmic time, until the root holds no mergeable pair.  A batch's texts become one
buffer of words; Arrow finds the distinct ones by their bytes, the trees of the new ones change in step
as rows of arrays, and documents gather their words' ids.  What a document decodes to is gathered from
its ids alone.

The vocabulary is one with word ends, lower case and dropped white space, in the JSON form of the
tokenizers library; special tokens are found in the raw text first, as that library does.  Letters,
numbers, lower case and combining marks are those of the Unicode versions in that library.

Defined results: a null text encodes as the empty text (no ids, both digests of the empty string);
very long texts are encoded whole, words of n bytes in time n log n; equal texts have equal results, so
ties and repeated rows repeat; an empty table gives no rows; other columns are ignored by ``report``,
and ``encode`` keeps doc_id, lang and source.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.common import map_rows, offsets_of, table
from quadrille.llm.textops import buffers, distinct, word_array

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers; beyond it starts afresh.
KNOWN_WORDS = 300_000
#: Bytes of text encoded together: enough new words for their trees to change in step.
SLICE_BYTES = 1 << 20
_NONE = 1 << 60
#: Longest word whose tree is a row of an array, the bits of a place in it, and such a tree's empty leaf.
_WIDEST, _PLACE_BITS, _NO_PAIR = 256, 9, 1 << 30
_SPACE, _LETTER, _NUMBER, _OTHER, _SPECIAL = range(5)

REPORT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _points(ranges: str) -> list[int]:
    """Code points of a list of hexadecimal ones and of ranges a-b."""
    out: list[int] = []
    for part in ranges.split():
        a, _, b = part.partition("-")
        out += range(int(a, 16), int(b or a, 16) + 1)
    return out


#: White space by Unicode's property of that name.
_SPACES = "9-d 20 85 a0 1680 2000-200a 2028 2029 202f 205f 3000"

#: Letters and numbers that regex knows and the tokenizers library doesn't yet; there they are symbols.
_LATER = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"

#: Combining marks that are later than the library's normaliser, to which they are like letters.
_PLAIN_MARKS = (
    "7fd 898-89f 8ca-8d3 9fe c3c d3b d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab 10eac 10efd-10eff 10f46-10f50 10f82-10f85 "
    "11070 1133b 1145e 11839 1183a 11930 11935 11938 1193d 1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44 11d45 11d97 11f41 11f42 "
    "16ff0 16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)

#: Lower case of letters that are later than Python's tables, as (first, last, lower case of the first).
_LATER_CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
_LOWER = {a + k: low + k for a, b, low in _LATER_CAPITALS for k in range(b - a + 1)} | {ord("Σ"): ord("σ")}
_ODD = re.compile("([" + "".join(map(chr, [*_points(_PLAIN_MARKS), *_LOWER])) + "])")


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, its class, and whether ``normalised`` has to look closer."""
    kind, odd = np.full(0x110000, _OTHER, np.uint8), np.zeros(0x110000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, value in (("L", _LETTER), ("N", _NUMBER)):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            kind[[*map(ord, m[0])]] = value
    kind[_points(_LATER)] = _OTHER
    kind[_points(_SPACES)] = _SPACE
    kind[0xD800:0xE000] = _SPECIAL
    odd[[*_points(_PLAIN_MARKS), *_LOWER]] = True
    odd[ord("Σ")] = False
    return kind, odd


def normalised(text: str) -> str:
    """Composed and in lower case, as the library has it; a final sigma is like any other."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _normalised_oddly(text: str) -> str:
    """``normalised`` for texts with a mark or a capital that the library treats in its own way."""
    pieces = [unicodedata.normalize("NFC", piece) for piece in _ODD.split(text)]
    return "".join(pieces).translate(_LOWER).lower()


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        #: token and decimal name of each id
        self.tokens = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)], pa.string())
        self.names = pa.array([str(i) for i in range(len(self.tokens))], pa.string())
        #: special tokens stand in normalised text as lone surrogates, which no text has
        self.special = {t: chr(0xD800 + k) for k, t in enumerate(special)}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id, right id) as one integer -> (rank, merged id)
        self.merges = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._hash_pairs()
        symbols = _byte_symbols()
        self.inner, self.last = [vocab[s] for s in symbols], [vocab[s + suffix] for s in symbols]
        self.inner_ids, self.last_ids = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        self.fixed = {t.encode("utf-8", "surrogatepass"): special[name] for name, t in self.special.items()}
        self.forget()

    def forget(self) -> None:
        #: word -> its place in ``begin``, the start of its ids in ``flat``
        self.known = {word: k for k, word in enumerate(self.fixed)}
        self.begin, self.flat = np.arange(len(self.fixed) + 1), np.array([*self.fixed.values()], np.int32)

    def _hash_pairs(self) -> None:
        """Open addressing over the pairs: ``pair_keys`` and ``pair_ranks`` by slot, -2 where there is none."""
        self.pair_bits = max(4, (4 * len(self.merges)).bit_length())
        self.pair_keys, self.pair_ranks = np.full(1 << self.pair_bits, -2, np.int64), np.full(1 << self.pair_bits, _NO_PAIR, np.int32)
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        for key, at, (rank, _) in zip(keys.tolist(), self._slots(keys).tolist(), self.merges.values(), strict=True):
            while self.pair_keys[at] != -2:
                at = (at + 1) & ((1 << self.pair_bits) - 1)
            self.pair_keys[at], self.pair_ranks[at] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of symbol pairs whose left one stands at ``at``; a symbol below 0 is none."""
        keys = left.astype(np.int64) << 20 | right
        keys[(left < 0) | (right < 0)] = -1
        slot = self._slots(keys)
        found = self.pair_keys.take(slot)
        out = np.where(found == keys, (self.pair_ranks.take(slot) << _PLACE_BITS) | at, _NO_PAIR).astype(np.int32)
        missed = np.flatnonzero((found != keys) & (found != -2) & (keys >= 0))
        while len(missed):
            slot[missed] = at_slot = (slot[missed] + 1) & ((1 << self.pair_bits) - 1)
            found = self.pair_keys.take(at_slot)
            hit = found == keys[missed]
            out[missed[hit]] = (self.pair_ranks.take(at_slot[hit]) << _PLACE_BITS) | at[missed[hit]]
            missed = missed[~hit & (found != -2)]
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids left of one word's symbols when no pair can be merged."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if (found := merges.get(symbols[i] << 20 | symbols[i + 1])) is not None:
                tree[size + i] = found[0] << 32 | i
        for v in range(size - 1, 0, -1):
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols = symbols[:]

        def put(leaf: int, key: int) -> None:
            v = size + leaf
            tree[v] = key
            while v > 1:
                other, v = tree[v ^ 1], v >> 1
                if other < key:
                    key = other
                if tree[v] == key:
                    break
                tree[v] = key

        def rank(i: int) -> int:
            found = merges.get(symbols[i] << 20 | symbols[after[i]]) if after[i] < n else None
            return _NONE if found is None else found[0] << 32 | i

        while (root := tree[1]) < _NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            symbols[i] = merges[symbols[i] << 20 | symbols[j]][1]
            symbols[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if tree[size + j] != _NONE:
                put(j, _NONE)
            put(i, rank(i))
            if before[i] >= 0:
                put(before[i], rank(before[i]))
        return [s for s in symbols if s >= 0]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for many words at once, their trees rows of arrays by width: all ids, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, parts, at = np.zeros(len(words), np.int64), [], []
        low = 0
        while low < _WIDEST:
            high = max(2, 2 * low)
            if len(some := np.flatnonzero((sizes > low) & (sizes <= high))):
                symbols = self._merge_rows([words[k] for k in some.tolist()], sizes[some], high)
                left = symbols >= 0
                counts[some] = left.sum(axis=1)
                parts.append(symbols[left]), at.append(some)
            low = high
        for k in np.flatnonzero(sizes > _WIDEST).tolist():
            raw = words[k]
            ids = self.merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])
            counts[k] = len(ids)
            parts.append(np.array(ids, np.int32)), at.append(np.array([k]))
        if not parts:
            return np.zeros(0, np.int32), counts
        # From the order by width to that of the words.
        flat, order = np.concatenate(parts), np.concatenate(at)
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[_runs(begin, counts)], counts

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        """Symbols left of words of at most ``width`` bytes, a row each; -1 where a symbol is gone.

        Symbol p of a word, from 1, stands in column p between two columns of -1; leaf p is the pair (p, its right neighbour).
        """
        n, columns = len(words), width + 2
        place = np.arange(1, width + 1)
        raw = np.zeros((n, width), np.uint8)
        inside = place <= sizes[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        table = np.full((n, columns), -1, np.int32)
        table[:, 1:-1] = np.where(place == sizes[:, None], self.last_ids[raw], self.inner_ids[raw])
        table[:, 1:-1][~inside] = -1
        symbols = table.reshape(-1)
        levels = np.full((n, 2 * width), _NO_PAIR, np.int32)
        levels[:, width + 1 :] = self._ranks(table[:, 1:width].reshape(-1), table[:, 2 : width + 1].reshape(-1), np.tile(place[:-1], n)).reshape(n, -1)
        step = width
        while step > 1:
            levels[:, step // 2 : step] = np.minimum(levels[:, step : 2 * step : 2], levels[:, step + 1 : 2 * step : 2])
            step //= 2
        tree = levels.reshape(-1)
        after = np.tile(np.arange(1, columns + 1, dtype=np.int16), n)
        before = np.tile(np.arange(-1, columns - 1, dtype=np.int16), n)
        rows = np.arange(n)
        while len(rows := rows[tree.take(2 * width * rows + 1) < _NO_PAIR]):
            base, top = columns * rows, 2 * width * rows
            root = tree.take(top + 1)
            i = (root & ((1 << _PLACE_BITS) - 1)).astype(np.int64)
            merged = self.merged.take(root >> _PLACE_BITS)
            j = after.take(base + i).astype(np.int64)
            k = after.take(base + j).astype(np.int64)
            h = before.take(base + i).astype(np.int64)
            symbols[base + i], symbols[base + j] = merged, -1
            after[base + i], before[base + k] = k, i
            right, left = symbols.take(base + k), symbols.take(base + h)
            both = self._ranks(np.concatenate([merged, left]), np.concatenate([right, merged]), np.concatenate([i, h]))
            # The last symbol's leaf, which is always empty, is that of the first column where it has none of its own.
            leaves = np.concatenate([j & (width - 1), i, h])
            top = np.concatenate([top, top, top])
            at = leaves + width
            tree[top + at] = np.concatenate([np.full(len(rows), _NO_PAIR, np.int32), both])
            while at[0] > 1:
                at >>= 1
                two = top + 2 * at
                tree[top + at] = np.minimum(tree.take(two), tree.take(two + 1))
        return table

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in ``begin``; words that aren't known yet are encoded."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            flat, counts = self.merge_many(new)
            self.known.update(zip(new, range(len(self.begin) - 1, len(self.begin) - 1 + len(new)), strict=True))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _normalise(self, text: str, how) -> str:
        if self.at_special is None or "<" not in text:
            return how(text)
        return "".join(self.special[part] if k % 2 else how(part) for k, part in enumerate(self.at_special.split(text)))

    def words(self, texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
        """The normalised words of all texts, and each text's first (one more entry at the end)."""
        kinds, odd = _classes()
        said = [self._normalise(t, normalised) for t in texts]
        points = np.frombuffer("\n".join([*said, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if odd[points].any():
            said = [self._normalise(t, _normalised_oddly if _ODD.search(t) else normalised) for t in texts]
            points = np.frombuffer("\n".join([*said, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[points]
        inside = kind != _SPACE
        starts = inside.copy()
        starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER) | (kind[1:] == _SPECIAL)
        self._cut_contractions(points, kind, starts)
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, said), np.int64, len(said)) + 1)])
        return word_array(points, inside, starts), np.searchsorted(np.flatnonzero(starts), begins)

    @staticmethod
    def _cut_contractions(points: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> None:
        """A word 's 't 'm 'd 're 've 'll ends in front of what follows it."""
        at = np.flatnonzero((points == 39) & starts)  # the text ends in a line feed
        at = at[kind[at + 1] == _LETTER]
        one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        short = np.isin(one, [*map(ord, "stmd")])
        long = (np.isin(one, [*map(ord, "rv")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for some, size in ((at[short], 2), (at[long], 3)):
            starts[some + 1] = False
            starts[some + size] = kind[some + size] != _SPACE

    def both(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and each text's first (one more entry at the end)."""
        words, word_offs = self.words([t or "" for t in texts])
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        every, which = distinct(words)
        place = self.places(every)[which]
        counts = self.begin[place + 1] - self.begin[place]
        ids = self.flat[_runs(self.begin[place], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[word_offs]

    def encode(self, text: str) -> list[int]:
        return self.both([text])[0].tolist()

    def joined(self, ids: np.ndarray, offs: np.ndarray, said: pa.StringArray) -> pa.StringArray:
        """What ``said`` has for each id of a text, joined by one space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), said.take(pa.array(ids))), " ")

    def decoded(self, ids: np.ndarray, offs: np.ndarray) -> pa.StringArray:
        """The texts of lists of ids: their tokens joined by one space, since this vocabulary file names no decoder."""
        return self.joined(ids, offs, self.tokens)

    def decode(self, ids: list[int]) -> str:
        return self.decoded(np.array(ids, np.int32), np.array([0, len(ids)]))[0].as_py()


def _runs(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of counts[0] numbers, then from begin[1], and so on."""
    return np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _digests(texts: pa.StringArray) -> pa.Array:
    data, offs = buffers(texts)
    raw = memoryview(data)
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.string())


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: tokens, and the digests of the ids and of the text that they decode to."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary or vocabulary_path())
        ids, offs = bpe.both(batch.column("text").to_pylist())
        return pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offs)), _digests(bpe.joined(ids, offs, bpe.names)), _digests(bpe.decoded(ids, offs))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(docs.select("doc_id", "text"), "text", run, REPORT, SLICE_BYTES)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the decoded text of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary or vocabulary_path())
        ids, offs = bpe.both(batch.column("text").to_pylist())
        return pa.record_batch([batch.column("doc_id"), batch.column("lang"), batch.column("source"), pa.array(np.diff(offs)), pa.ListArray.from_arrays(offsets_of(np.diff(offs)), pa.array(ids)), bpe.decoded(ids, offs)], names=["doc_id", "lang", "source", "n_tokens", "ids", "decoded"])

    return map_rows(docs.select("doc_id", "lang", "source", "text"), "text", run, "doc_id bigint, lang string, source string, n_tokens bigint, ids array<int>, decoded string", SLICE_BYTES)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
