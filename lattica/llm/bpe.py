"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The symbols of a piece are leaves that hold the rank of the pair they begin, with the position below it, so the
root of the minimum tree is the leftmost pair of lowest rank. A merge changes three leaves and their paths. Many
pieces of similar length are merged at once, a tree each, as arrays; long pieces have a tree of their own.

The vocabulary file is that of the `tokenizers` library for word-level BPE with word ends: added tokens are cut out
of the raw text, the rest is normalised (NFC, one blank for white space, lower case by code point), split by the
file's pattern, and mapped to byte symbols. Decoding joins the tokens of the ids by blanks, as the file has no
decoder. The file's path is a parameter. Letters, numbers and lower case are those of the library's Unicode version.

Words are encoded once and kept, up to a number of bytes; when that is passed, the words of the present texts stay.
A long text is taken in segments that end at white space, so only its own ids grow with it.

Defined results: a null text counts as empty and has no ids; a very long text gives all its ids; repeated rows and
rows of one or no doc_id stay, each with its own result; equal texts have equal ids; extra columns are ignored; an
empty table gives no rows. Of equal ranks the leftmost pair is merged first.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import give_back, small_batches, starts_of, texts_of

#: Bits of a position below the rank in a leaf, and the leaf of no pair.
PLACE, NONE = 8, np.int32(2**31 - 1)
#: The same in the tree of one long piece.
LONG_PLACE, LONG_NONE = 32, 1 << 60
#: Bytes of words that are kept, of texts that are encoded at once, and of a segment of a long text.
KEPT_BYTES, AT_ONCE, SEGMENT = 32_000_000, 2_000_000, 1_000_000
#: Symbols of the largest piece that shares arrays with others, and nodes of such arrays.
MANY, NODES = 256, 1 << 19
#: The split pattern that ``Bpe.spans`` knows as arrays; another one is matched word by word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
BLANK, LETTER, NUMBER, OTHER = range(4)
GAP = re.compile(rb"[\x20\x09-\x0D]")


# Unicode data. The library's tables are those of version 16; the ranges hold letters and numbers that
# the installed `regex` knows from later versions, and the pairs the lower case that came with versions 16 and 17.
LATER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 "
    "16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 "
    "1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 "
    "3d000-3fc3f"
)
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
ADDED_CAPITAL = re.compile("[" + "".join(map(chr, LOWER)) + "]")


def classes() -> np.ndarray:
    """The class of each code point."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    for r in LATER.split():
        first, last = (int(x, 16) for x in r.split("-"))
        out[first : last + 1] = OTHER
    return out


def byte_symbols() -> list[str]:
    """The code point that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return out


class Tree:
    """A minimum tree for one long piece."""

    def __init__(self, leaves: list[int]):
        self.size = 1
        while self.size < max(2, len(leaves)):
            self.size *= 2
        none = LONG_NONE
        self.nodes = [none] * self.size + leaves + [none] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self.nodes[i] = min(self.nodes[2 * i], self.nodes[2 * i + 1])

    def put(self, at: int, value: int) -> None:
        nodes, i = self.nodes, at + self.size
        nodes[i] = value
        while i > 1:
            least = min(nodes[i], nodes[i ^ 1])
            i >>= 1
            if nodes[i] == least:
                break
            nodes[i] = least


class Bpe:
    """A vocabulary and its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end: str = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in (*vocab.items(), *self.added.items()):
            self.tokens[i] = t
        self.token_bytes = [t.encode() for t in self.tokens]
        self.id_bytes = [b"%d" % i for i in range(len(self.tokens))]
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        self.classes = classes()
        # what the pattern's own tables take for letters or numbers, and is neither here, stands as another sign
        self.other = {int(c): "\u0378" for c in np.flatnonzero(self.classes == OTHER) if c > 127 and regex.match(r"[\p{L}\p{N}]", chr(c))}
        self.pieces = regex.compile(self.pattern)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self._hash(left << 32 | right)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        """Drop the kept words."""
        self.ids_of: dict[bytes | str, bytes] = {}
        self.tokens_of: dict[bytes | str, bytes] = {}
        self.empty: set[bytes] = set()
        self.held = 0

    def _hash(self, keys: np.ndarray) -> None:
        """A table of the pairs with open addressing, about an eighth full."""
        size = 1 << max(8, (8 * len(keys)).bit_length())
        self.mask, self.table, self.ranks = size - 1, np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.table[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.table[at[first]], self.ranks[at[first]] = keys[todo[first]], todo[first]
            rest = np.ones(len(todo), dtype=bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key * np.int64(0x9E3779B97F4A7C15 - (1 << 64))
        return ((mixed >> 32) ^ (mixed >> 47)) & self.mask

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is none."""
        key = (a.astype(np.int64) << 32 | b).ravel()
        at = self._slot(key)
        there = self.table[at]
        out = np.where(there == key, self.ranks[at], np.int32(-1))
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there, want = self.table[at[todo]], key[todo]
            hit = there == want
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out.reshape(a.shape)

    def _leaves(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of pairs; a or b is negative where there is no symbol."""
        rank = self._rank(np.maximum(a, 0), np.maximum(b, 0))
        return np.where((rank >= 0) & (a >= 0) & (b >= 0), rank << PLACE | place.astype(np.int32), NONE)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """Merge one piece by a tree of its own."""
        n, none = len(symbols), LONG_NONE
        if n < 2:
            return symbols
        known: dict[tuple[int, int], int] = {}

        def leaf(a: int, b: int, i: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self._rank(np.array([a]), np.array([b]))[0])
            r = known[a, b]
            return r << LONG_PLACE | i if r >= 0 else none

        start = np.array(symbols)
        ranks = self._rank(start[:-1], start[1:]).astype(np.int64)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        tree = Tree([*np.where(ranks >= 0, ranks << LONG_PLACE | np.arange(n - 1), none).tolist(), none])
        while (root := tree.nodes[1]) != none:
            i = root & ((1 << LONG_PLACE) - 1)
            symbols[i] = int(self.made[root >> LONG_PLACE])
            j = after[i]
            k = after[i] = after[j]
            symbols[j] = -1
            tree.put(j, none)
            if k >= 0:
                before[k] = i
                tree.put(i, leaf(symbols[i], symbols[k], i))
            else:
                tree.put(i, none)
            if (h := before[i]) >= 0:
                tree.put(h, leaf(symbols[h], symbols[i], h))
        return [s for s in symbols if s >= 0]

    def merge_many(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces of ``raw`` of at most ``size`` (a power of two) bytes, a tree each: all ids, and how many each has."""
        n, wide = len(starts), size + 1
        place = np.arange(size)
        there = place < sizes[:, None]
        symbols = np.full((n, wide), -1, dtype=np.int32)  # the last column is the missing neighbour
        symbols[:, :size] = np.where(there, self.inner[raw[np.minimum(starts[:, None] + place, len(raw) - 1)]], -1)
        symbols[np.arange(n), sizes - 1] = self.last[raw[starts + sizes - 1]]
        tree = np.full((n, 2 * size), NONE, dtype=np.int32)
        tree[:, size:] = self._leaves(symbols[:, :-1], symbols[:, 1:], place)
        width = size // 2
        while width:
            np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2], out=tree[:, width : 2 * width])
            width //= 2
        after = np.broadcast_to(np.arange(1, wide, dtype=np.int32), (n, size)).copy().ravel()
        before = np.broadcast_to(np.arange(-1, size, dtype=np.int32), (n, wide)).copy().ravel()
        symbols, tree, levels = symbols.ravel(), tree.ravel(), size.bit_length() - 1

        def put(base: np.ndarray, at: np.ndarray, value: np.ndarray | np.int32) -> None:
            node = at + size
            tree[base + node] = value
            for _ in range(levels):
                node = node >> 1
                pair = base + 2 * node
                tree[base + node] = np.minimum(tree[pair], tree[pair + 1])

        row = np.arange(n)
        while True:
            root = tree[row * (2 * size) + 1]
            open_ = root != NONE
            row, root = row[open_], root[open_]
            if not len(row):
                break
            base, own, link = row * (2 * size), row * wide, row * size
            i = (root & ((1 << PLACE) - 1)).astype(np.int64)
            new = self.made[root >> PLACE]
            j = after[link + i].astype(np.int64)
            k = after[link + j].astype(np.int64)
            symbols[own + i] = new
            symbols[own + j] = -1
            after[link + i] = k
            before[own + k] = i
            put(base, j, NONE)
            put(base, i, self._leaves(new, symbols[own + k], i))
            h = before[own + i].astype(np.int64)
            has = np.flatnonzero(h >= 0)
            if len(has):
                h = h[has]
                put(base[has], h, self._leaves(symbols[own[has] + h], new[has], h))
        left = symbols >= 0
        return symbols[left], left.reshape(n, wide).sum(axis=1)

    def merge(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``raw[start : start + size]``, none of them empty, and how many each has."""
        counts = np.ones(len(starts), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        one = np.flatnonzero(sizes == 1)
        found.append((one, self.last[raw[starts[one]]]))
        size = 2
        while size <= MANY:
            every = np.flatnonzero((sizes <= size) & (sizes > (size // 2 if size > 2 else 1)))
            for p in range(0, len(every), max(1, NODES // size)):
                rows = every[p : p + max(1, NODES // size)]
                ids, n = self.merge_many(raw, starts[rows], sizes[rows], size)
                counts[rows] = n
                found.append((rows, ids))
            size *= 2
        for p in np.flatnonzero(sizes > MANY).tolist():
            piece = raw[starts[p] : starts[p] + sizes[p]]
            ids = self.merge_one([*self.inner[piece[:-1]].tolist(), int(self.last[piece[-1]])])
            counts[p] = len(ids)
            found.append((np.array([p]), np.array(ids, dtype=np.int32)))
        at = starts_of(counts)
        out = np.empty(int(at[-1]), dtype=np.int32)
        for rows, ids in found:
            n = counts[rows]
            out[np.repeat(at[rows] - starts_of(n)[:-1], n) + np.arange(len(ids))] = ids
        return out, counts

    def spans(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of words without ASCII white space: the words' bytes, and per piece its start, size and word."""
        joined = b" ".join(words)
        text = joined.decode("utf-8", "surrogatepass")
        if self.pattern != PATTERN:
            return self._matched(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.classes[code]
        begins = np.ones(len(code), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        # an apostrophe that begins a run of other signs and has an ending behind it
        quotes = np.flatnonzero((code == 39) & begins)
        padded = np.concatenate([code, np.zeros(3, np.uint32)])
        for ending in ENDINGS:
            hit = quotes
            for k, letter in enumerate(ending, 1):
                hit = hit[padded[hit + k] == ord(letter)]
            begins[hit + 1] = False
            rest = hit[padded[hit + 1 + len(ending)] > 0] + 1 + len(ending)
            begins[rest[rest < len(code)]] = True
        width = 1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000)
        place = starts_of(width)
        first = np.flatnonzero(begins)
        start, end = place[first], place[np.append(first[1:], len(code))]
        word = np.cumsum(code == 32)[first]
        keep = kind[first] != BLANK
        return np.frombuffer(joined, dtype=np.uint8), start[keep], (end - start)[keep], word[keep]

    def _matched(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``spans`` by the file's own pattern."""
        raw, starts, sizes, owners, at = [], [], [], [], 0
        for k, w in enumerate(words):
            text = w.decode("utf-8", "surrogatepass")
            for m in self.pieces.finditer(text.translate(self.other)):
                piece = text[m.start() : m.end()].encode("utf-8", "surrogatepass")
                raw.append(piece)
                starts.append(at)
                sizes.append(len(piece))
                owners.append(k)
                at += len(piece)
        return np.frombuffer(b"".join(raw), dtype=np.uint8), *(np.array(x, dtype=np.int64) for x in (starts, sizes, owners))

    def _learn(self, words: list[bytes]) -> None:
        """Encode words (no ASCII white space inside) and keep their ids and tokens as text."""
        if not words:
            return
        raw, starts, sizes, owners = self.spans(words)
        ids, counts = self.merge(raw, starts, sizes)
        per_word = np.bincount(owners, weights=counts, minlength=len(words)).astype(np.int64)
        at, flat = starts_of(per_word).tolist(), ids.tolist()
        cuts = [slice(i, j) for i, j in zip(at, at[1:], strict=False)]
        for texts, to in ((self.id_bytes, self.ids_of), (self.token_bytes, self.tokens_of)):
            every = list(map(texts.__getitem__, flat))
            made = list(map(b" ".join, map(every.__getitem__, cuts)))
            to.update(zip(words, made, strict=True))
            self.held += sum(map(len, made))
        self.held += sum(map(len, words)) + 300 * len(words)
        self.empty.update([words[k] for k in np.flatnonzero(per_word == 0).tolist()])

    def _words(self, text: bytes) -> list[bytes]:
        """The normalised words of a text."""
        if text.isascii():
            return text.lower().split()
        plain = text.decode("utf-8", "surrogatepass")
        if not unicodedata.is_normalized("NFC", plain):
            plain = unicodedata.normalize("NFC", plain)
        if ADDED_CAPITAL.search(plain):
            plain = plain.translate(LOWER)
        plain = plain.replace("Σ", "σ")  # lower case goes by code point, without the final form of sigma
        return plain.lower().encode("utf-8", "surrogatepass").split()

    def _row(self, text: bytes) -> list[bytes | str]:
        """The words and the added tokens (as ``str``) of a text."""
        if self.cut is None or b"<" not in text and not any(x[0] != "<" for x in self.added):
            return self._words(text)
        row: list[bytes | str] = []
        for part in self.cut.split(text.decode("utf-8", "surrogatepass")):
            row += [part] if part in self.added else self._words(part.encode("utf-8", "surrogatepass"))
        return row

    def _encoded(self, rows: list[list[bytes | str]]) -> Iterator[tuple[bytes, bytes]]:
        """For each row the ids and the tokens, joined by blanks."""
        there = set().union(*rows)
        if self.held > KEPT_BYTES:
            ids_of, tokens_of = self.ids_of, self.tokens_of
            self.forget()
            for w in there:
                if w in ids_of and len(w) <= MANY and self.held < KEPT_BYTES // 2:
                    self.ids_of[w], self.tokens_of[w] = ids_of[w], tokens_of[w]
                    self.held += len(w) + len(ids_of[w]) + len(tokens_of[w]) + 300
        known = self.ids_of
        new = [w for w in there if w not in known]
        for w in new:
            if isinstance(w, str):
                self.ids_of[w], self.tokens_of[w] = self.id_bytes[self.added[w]], w.encode()
        self._learn([w for w in new if not isinstance(w, str)])
        ids, tokens, empty = self.ids_of.__getitem__, self.tokens_of.__getitem__, self.empty
        for r in rows:
            if empty and not empty.isdisjoint(r):
                r = [w for w in r if ids(w)]  # noqa: PLW2901
            yield b" ".join(map(ids, r)), b" ".join(map(tokens, r))

    def encode_parts(self, texts: Iterator[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of the text, ids, tokens) of the segments of each text, in order; empty ones may be among them."""
        rows, owners, size = [], [], 0
        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                stop = len(text)
                if stop - at > SEGMENT and (m := GAP.search(text, at + SEGMENT)):
                    stop = m.end()
                part = text if stop - at == len(text) else text[at:stop]
                rows.append(self._row(part))
                owners.append(k)
                size += len(part)
                at = stop
                if size >= AT_ONCE:
                    yield from ((o, *x) for o, x in zip(owners, self._encoded(rows), strict=True))
                    rows, owners, size = [], [], 0
        yield from ((o, *x) for o, x in zip(owners, self._encoded(rows), strict=True))

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, the ids joined by blanks, and the decoded text."""
        ids: list[list[bytes]] = [[] for _ in texts]
        tokens: list[list[bytes]] = [[] for _ in texts]
        for k, i, t in self.encode_parts(x.encode("utf-8", "surrogatepass") for x in texts):
            if i:
                ids[k].append(i)
                tokens[k].append(t)
        joined = [(b" ".join(i).decode(), b" ".join(t).decode()) for i, t in zip(ids, tokens, strict=True)]
        return [(i.count(" ") + 1 if i else 0, i, t) for i, t in joined]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_batch([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary of a file, read once a process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, ids: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; on demand the ids and the decoded text themselves.

    Every worker reads the vocabulary from ``path``, which is installed wherever Python is, and streams its rows.
    """
    small_batches(docs.sparkSession)
    columns = SCHEMA + ", ids array<int>" * ids + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n = batch.num_rows
            counts, digests = [0] * n, [[hashlib.sha256() for _ in range(n)] for _ in range(2)]
            kept: list[list[np.ndarray]] = [[] for _ in range(n)]
            texts: list[list[bytes]] = [[] for _ in range(n)]
            for k, i, t in bpe.encode_parts(iter(texts_of(batch.column(1)))):
                if not i:
                    continue
                gap = b" " if counts[k] else b""
                counts[k] += i.count(b" ") + 1
                digests[0][k].update(gap + i)
                digests[1][k].update(gap + t)
                if ids:
                    kept[k].append(np.array(i.split(), dtype="S8").astype(np.int32))
                if decoded:
                    texts[k].append(t)
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": [d.hexdigest() for d in digests[0]], "decoded_sha256": [d.hexdigest() for d in digests[1]]}
            if ids:
                flat = np.concatenate([np.zeros(0, np.int32), *(x for own in kept for x in own)])
                out["ids"] = pa.ListArray.from_arrays(pa.array(starts_of(np.array(counts, dtype=np.int64)), pa.int32()), pa.array(flat))
            if decoded:
                out["decoded"] = [b" ".join(x).decode("utf-8", "surrogatepass") for x in texts]
            yield pa.RecordBatch.from_pydict(out)
        bpe.forget()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, columns)
