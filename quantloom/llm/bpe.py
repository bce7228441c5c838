"""Byte-level byte-pair encoding: token counts by heap merging, encoding and decoding by prefix dynamic programming.

Texts are first cut before single spaces and line feeds between other characters, where the pre-tokenizing pattern always
cuts, into units; a unit's result is remembered for a while, so that pattern and merges run once for most repeated units. Texts are
taken CHUNK_CHARS at a time (a longer text is a chunk of its own), and memories are bounded by bytes, so what a worker
holds is the vocabulary, KEPT_BYTES and a small multiple of one chunk.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.base import kept_by_worker, prepare

#: Bytes of remembered results, keys and table slots included.
KEPT_BYTES = 96 << 20
#: Longer units are not remembered.
LONG = 256
#: Characters of the texts that are worked on at once.
CHUNK_CHARS = 1 << 20
#: Pieces up to this many bytes are encoded many at a time, longer ones one by one.
WIDE = 48
#: Bytes that a remembered entry needs besides its key and value: slots in the dictionary's two tables.
_SLOT = 110

#: White space by any of the libraries' or Python's rules.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Below this character the regex module's classes are those of the tokenizing libraries.
_PLAIN_BELOW = "԰"
_PATTERN = regex.compile(public_tokenizers.PATTERN)
_LIBRARY = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def pieces(text: str) -> list[str]:
    """The matches of the pattern. Characters that newer Unicode versions have made letters or numbers are taken as
    the libraries' tables have them."""
    if not text.isascii() and max(text) >= _PLAIN_BELOW:
        return [text[a:b] for _, (a, b) in _LIBRARY.pre_tokenize_str(text)]
    return _PATTERN.findall(text)


def units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different units of the texts, the number of each unit in turn, and where each text's units start and the last ends.

    The pattern always cuts before a space or line feed that stands alone between other characters. A unit is written
    without such a space; one that starts with a line feed had none, and one that starts with a tab (else impossible)
    is the first of its text, without what follows the tab having anything before it.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _SPACE + "{2}").to_numpy(zero_copy_only=False)
    even = pc.if_else(pa.array(odd), "", texts)
    split = pc.split_pattern(pc.binary_join_element_wise("\t", pc.replace_substring(even, "\n", " \n"), ""), " ")
    if odd.any():
        own = []
        for i in np.flatnonzero(odd).tolist():
            first, *rest = _CUT.split(texts[i].as_py())
            own.append(["\t" + first, *[u[1:] if u[0] == " " else u for u in rest]])
        split = pa.concat_arrays([split, pa.array(own, pa.list_(pa.string()))])
        at = np.arange(len(texts))
        at[odd] = len(texts) + np.arange(len(own))
        split = split.take(pa.array(at))
    found = split.flatten().dictionary_encode()
    size = pc.list_value_length(split).to_numpy()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), np.r_[0, np.cumsum(size, dtype=np.int64)]


def unit_text(unit: str) -> str:
    """What a unit stands for in its text."""
    return unit[1:] if unit[:1] == "\t" else unit if unit[:1] == "\n" else " " + unit


def unit_pieces(unit: str) -> list[str]:
    return [" " + unit] if unit.isascii() and unit.isalpha() else pieces(unit_text(unit))


class Kept:
    """A memory of KEPT_BYTES in two generations. When the younger has half of that, the older is forgotten and the younger
    takes its place; what is used again moves to the younger, so only what has long been unused goes."""

    def __init__(self, kept_bytes: int = KEPT_BYTES):
        self.half, self.size, self.young, self.old = kept_bytes // 2, 0, {}, {}

    def all(self, keys: list, make) -> list:
        """What is remembered of different keys; ``make(keys)`` gives what isn't."""
        found = list(map(self.young.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if not missing:
            return found
        asked = [keys[i] for i in missing]
        got = list(map(self.old.get, asked))
        new = [i for i, x in enumerate(got) if x is None]
        for i, x in zip(new, make([asked[i] for i in new]), strict=True):
            got[i] = x
        for i, x in zip(missing, got, strict=True):
            found[i] = x
        if max(map(len, asked)) > LONG:
            short = [i for i, k in enumerate(asked) if len(k) <= LONG]
            asked, got = [asked[i] for i in short], [got[i] for i in short]
        self.young.update(zip(asked, got, strict=True))
        self.size += _SLOT * len(asked) + sum(map(sys.getsizeof, asked)) + sum(map(sys.getsizeof, got))
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0
        return found


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes stand for
    themselves, the others, in order, for U+0100 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class HeapCounter:
    """Token counts of a tokenizers file with a byte-level BPE model, without token ids."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Symbols are numbers here: a byte's own, or 256 and the rank of the merge that makes it.
        symbol = {bytes([x]): x for x in range(256)}
        self.ranks: dict[int, int] = {}
        for i, pair in enumerate(merges):
            left, right = (bytes(to_byte[c] for c in m) for m in pair)
            self.ranks[symbol[left] << 32 | symbol[right]] = i
            symbol.setdefault(left + right, 256 + i)
        self.made = [symbol[bytes(to_byte[c] for m in pair for c in m)] for pair in merges]
        self.special_strings = sorted([t["content"] for t in spec["added_tokens"]], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.special_strings))) if self.special_strings else None
        self.kept = Kept(kept_bytes)

    def merge(self, data: bytes) -> int:
        """Pop the adjacent pair of the lowest rank, leftmost first, until none is left; symbols minus merges."""
        n, rank = len(data), self.ranks.get
        symbol = [*data, -1]
        heap = [r * n + i for i in range(n - 1) if (r := rank(symbol[i] << 32 | symbol[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        right, left, count = list(range(1, n + 2)), list(range(-1, n)), n
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = right[i]
            if j >= n or rank(symbol[i] << 32 | symbol[j]) != r:
                continue  # one of the two has been merged with another meanwhile
            symbol[i] = s = self.made[r]
            symbol[j] = -1
            count -= 1
            right[i] = k = right[j]
            left[k] = i
            if k < n and (x := rank(s << 32 | symbol[k])) is not None:
                heapq.heappush(heap, x * n + i)
            h = left[i]
            if h >= 0 and (x := rank(symbol[h] << 32 | s)) is not None:
                heapq.heappush(heap, x * n + h)
        return count

    def _learn(self, new: list[str]) -> list[int]:
        split = [unit_pieces(u) for u in new]
        known = {p: self.merge(p.encode()) for p in {p for ps in split for p in ps}}
        return [sum(map(known.__getitem__, ps)) for ps in split]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; an added special string in it is one token, as the library does by default."""
        parts, whose, extra = texts, None, np.zeros(len(texts), np.int64)
        if self.special is not None:
            has = pc.match_substring_regex(texts, "|".join(map(re.escape, self.special_strings)))
            if pc.any(has).as_py():
                split = [self.special.split(t) if h else [t] for t, h in zip(texts.to_pylist(), has.to_pylist(), strict=True)]
                extra += [len(s) - 1 for s in split]
                parts, whose = pa.array([p for s in split for p in s], pa.string()), np.repeat(np.arange(len(texts)), extra + 1)
        keys, index, ends = units(parts)
        each = np.array(self.kept.all(keys, self._learn), np.int64)
        found = np.add.reduceat(each[index], ends[:-1]) if len(parts) else np.zeros(0, np.int64)
        return extra + (found if whose is None else np.bincount(whose, found, len(texts)).astype(np.int64))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Lookup:
    """Distinct non-negative integers below 2**62 and what they stand for (not negative), in an open-addressed table of
    arrays; whole arrays of keys are looked up at once, and -1 stands for a key that is not there."""

    _ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values, slot = keys.astype(np.int64), values.astype(np.int32), self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._ODD) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class PrefixEncoder:
    """The encoding of one growing byte string: for each prefix, the last token of its encoding.

    Of the tokens that end at a place, exactly one may follow the encoding of what is before it: the one that forms,
    with the token before it, a pair that merging leaves as it is. So a byte is appended in time that doesn't depend
    on the length, and after an edit only what follows it is encoded again, up to where the old and new last tokens
    have agreed for as long as two of the longest tokens.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def _next(self, end: int) -> int:
        """The last token of the prefix of that length."""
        v, data = self.v, self.data
        for size in v.sizes_ending[data[end - 1]]:
            at = end - size
            token = v.ranks.get(bytes(data[at:end])) if at >= 0 else None
            if token is not None and (v.stays(self.last[at], token) if at else v.whole[token]):
                return token
        raise ValueError("the vocabulary has no encoding of this text")

    def truncate(self, size: int) -> None:
        del self.data[size:]
        del self.last[size + 1 :]

    def append(self, data: bytes) -> None:
        for b in data:
            self.data.append(b)
            self.last.append(self._next(len(self.data)))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Replace data[start:end]; how many places were encoded anew."""
        tail, old = bytes(self.data[end:]), self.last[end + 1 :]
        self.truncate(start)
        self.append(data)
        same = 0
        for k, b in enumerate(tail):
            if same >= 2 * self.v.longest:
                self.data.extend(tail[k:])
                self.last.extend(old[k:])
                return len(data) + k
            self.append(bytes([b]))
            same = same + 1 if self.last[-1] == old[k] else 0
        return len(data) + len(tail)

    def tokens(self) -> list[bytes]:
        """The tokens, found from the end: the last token of the whole, then that of what is before it."""
        out, end = [], len(self.data)
        while end:
            out.append(self.v.bytes[self.last[end]])
            end -= len(out[-1])
        return out[::-1]


class Vocabulary:
    """Ranks of a byte-level BPE, the two parts that merging makes each token from, and encoding by prefix tables.

    A pair of tokens stays as it is if no merge across its border comes before the merges that make the two: undoing
    these from the last one on shows the borders that there were, and the rank that a merge across them had to beat.
    """

    def __init__(self, ranks: dict[bytes, int], kept_bytes: int = KEPT_BYTES):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.id_text = pa.array(map(str, range(size)), pa.string())
        self.id_bytes = pa.array(self.bytes, pa.binary())
        self.size = np.fromiter(map(len, self.bytes), np.int32, size)
        self.longest = int(self.size.max())
        ending: list[set[int]] = [set() for _ in range(256)]
        for token in ranks:
            ending[token[-1]].add(len(token))
        self.sizes_ending = [sorted(s, reverse=True) for s in ending]
        self._find_parts()
        self._grow_trie()
        self.kept = Kept(kept_bytes)

    def _find_parts(self) -> None:
        """left and right part of each token, itself for single bytes; whether merging makes the token from its bytes."""
        self.left = np.arange(len(self.bytes), dtype=np.int64)
        self.right, self.whole = self.left.copy(), np.zeros(len(self.bytes), bool)
        self.pairs: dict[int, int] = {}
        by_size: dict[int, list[bytes]] = {}
        for token in self.ranks:
            by_size.setdefault(len(token), []).append(token)
        rank = self.ranks.get
        for n, tokens in sorted(by_size.items()):
            ids = np.array([self.ranks[t] for t in tokens], np.int64)
            if n == 1:
                self.whole[ids] = True
                continue
            # a token's parts are shorter, so those of all shorter tokens are known
            self.merges = Lookup(np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int64, len(self.pairs)))
            found = [(i, a, b) for t, i in zip(tokens, ids.tolist(), strict=True) for k in range(1, n) if (a := rank(t[:k])) is not None and (b := rank(t[k:])) is not None and a < i and b < i]
            if not found:
                continue
            i, a, b = np.array(found, np.int64).T
            ok = self.whole[a] & self.whole[b] & self.stay(a, b, i)
            i, a, b = i[ok], a[ok], b[ok]
            self.left[i], self.right[i], self.whole[i] = a, b, True
            self.pairs |= zip((a << 31 | b).tolist(), i.tolist(), strict=True)
        self.merges = Lookup(np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int64, len(self.pairs)))
        self._parts = self.left.tolist(), self.right.tolist()

    def _grow_trie(self) -> None:
        """The tokens read backwards as a trie: node << 8 | byte leads to the next node; token of each node, or -1."""
        order = sorted(range(len(self.bytes)), key=lambda i: -len(self.bytes[i]))
        order = np.array([i for i in order if self.whole[i]], np.int64)
        flat = np.frombuffer(b"".join([self.bytes[i][::-1] for i in order.tolist()]), np.uint8)
        start = np.r_[0, np.cumsum(self.size[order])]
        node, keys, nodes, tokens = np.zeros(len(order), np.int64), [], [], [np.array([-1], np.int64)]
        total = 1
        for k in range(self.longest):
            n = int((self.size[order] > k).sum())  # longest first
            key, at = np.unique(node[:n] << 8 | flat[start[:n] + k], return_inverse=True)
            node[:n] = total + at
            keys.append(key)
            nodes.append(np.arange(total, total + len(key)))
            total += len(key)
            ends = np.full(len(key), -1, np.int64)
            done = np.flatnonzero(self.size[order[:n]] == k + 1)
            ends[at[done]] = order[done]
            tokens.append(ends)
        self.step, self.token_at = Lookup(np.concatenate(keys), np.concatenate(nodes)), np.concatenate(tokens)

    def stay(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For arrays of tokens: whether merging (by merges of rank under ``below``) leaves each pair as it is."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        most = np.full(len(a), len(self.bytes), np.int64) if below is None else below
        while len(live):
            across = self.merges[a << 31 | b]
            bad = (across >= 0) & (across < most)
            ok[live[bad]] = False
            left, right = self.left[b], self.right[a]
            more_a, more_b = right != a, left != b
            undo_a = more_a & ((a > b) | ~more_b)
            most = np.where(undo_a, a, b + 1)  # of two merges of one rank, the one further left comes first
            a, b = np.where(undo_a, right, a), np.where(undo_a, b, left)
            go = ~bad & (more_a | more_b)
            live, a, b, most = live[go], a[go], b[go], most[go]
        return ok

    def stays(self, a: int, b: int) -> bool:
        """stay() for one pair."""
        most, get, (lefts, rights) = len(self.bytes), self.pairs.get, self._parts
        while True:
            across = get(a << 31 | b, most)
            if across < most:
                return False
            right, left = rights[a], lefts[b]
            if right != a and (a > b or left == b):
                most, a = a, right
            elif left != b:
                most, b = b + 1, left
            else:
                return True

    def encode_all(self, strings: list[bytes]) -> list[bytes]:
        """The ids of each string, as 32-bit integers one after the other.

        The strings are sorted, so that each has to be encoded from where it leaves the one before it; the prefix tables
        are columns, one for each length, filled for all strings at once.
        """
        wide = {s: np.array([self.ranks[t] for t in PrefixEncoder(self, s).tokens()], np.int32).tobytes() for s in strings if len(s) > WIDE}
        data = sorted({s for s in strings if len(s) <= WIDE})
        if not data:
            return [wide[s] for s in strings]
        size = np.fromiter(map(len, data), np.int64, len(data))
        width, every = int(size.max()), np.arange(len(data))
        table = np.zeros((len(data), width), np.int64)
        table[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        table = np.ascontiguousarray(table.T)
        last = np.full((width + 1, len(data)), -1, np.int64)
        shorter = np.r_[-1, size[:-1]]
        differs = np.zeros(len(data), bool)
        for end in range(1, width + 1):
            column = table[end - 1]
            differs[1:] |= column[1:] != column[:-1]
            new = (size >= end) & (differs | (shorter < end))
            first = np.flatnonzero(new)
            rows, node, found = np.arange(len(first)), np.zeros(len(first), np.int64), []
            for back in range(1, end + 1):
                node = self.step[node << 8 | table[end - back, first[rows]]]
                there = node >= 0
                rows, node = rows[there], node[there].astype(np.int64)
                if not len(rows):
                    break
                token = self.token_at[node]
                there = token >= 0
                found.append((back, rows[there], token[there]))
            got = np.full(len(first), -1, np.int64)
            for back, rows, token in reversed(found):
                left = got[rows] < 0
                rows, token = rows[left], token[left]
                if end > back and len(rows):
                    ok = self.stay(last[end - back, first[rows]], token)
                    rows, token = rows[ok], token[ok]
                got[rows] = token
            if (got < 0).any():
                raise ValueError("the vocabulary has no encoding of this text")
            last[end, first] = got
            last[end] = last[end, np.maximum.accumulate(np.where(new, every, 0))]
        steps, place = [], size.copy()
        while (place > 0).any():
            token = np.where(place > 0, last[place, every], -1)
            steps.append(token)
            place -= np.where(token >= 0, self.size[token], 0)
        ids = np.stack(steps[::-1], axis=1)
        ends = np.cumsum((ids >= 0).sum(axis=1) * 4).tolist()
        raw = ids[ids >= 0].astype(np.int32).tobytes()
        known = {s: raw[x:y] for s, x, y in zip(data, [0, *ends], ends, strict=False)} | wide
        return [known[s] for s in strings]

    def _learn(self, new: list[str]) -> list[bytes]:
        split = list(map(unit_pieces, new))
        different = list({p for ps in split for p in ps})
        known = dict(zip(different, self.encode_all([p.encode() for p in different]), strict=True))
        return [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in split]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and where each text's ids start and the last ends; null has none."""
        keys, index, ends = units(texts)
        found = self.kept.all(keys, self._learn)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, start, size = np.frombuffer(b"".join(found), np.int32), np.r_[0, np.cumsum(size)[:-1]][index], size[index]
        before = np.r_[0, np.cumsum(size)]
        return flat[np.repeat(start - before[:-1], size) + np.arange(before[-1])], before[ends]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


def _local(path: str) -> str:
    """A vocabulary file by its path, or by its name if it came with SparkContext.addFile()."""
    try:
        with open(path, "rb"):
            return path
    except OSError:
        return SparkFiles.get(path.rsplit("/", 1)[-1])


def _tool(kind: type, path: str):
    """This Python worker's counter or vocabulary, which keeps what it has learned from one task to the next."""
    return kept_by_worker((kind, path), lambda: HeapCounter(_local(path)) if kind is HeapCounter else Vocabulary(load_ranks(_local(path))))


def _chunks(texts: pa.Array):
    """The texts, about CHUNK_CHARS at a time."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(np.diff((np.cumsum(size) - size) // CHUNK_CHARS, prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(texts)], strict=True):
        yield texts.slice(a, b - a)


def _sha256(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in values], pa.string())


def _run(docs: DataFrame, id_col: str, text_col: str, out: list[tuple[str, T.DataType]], kind: type, path: str, each) -> DataFrame:
    """(doc_id, *out) of each row; ``each`` makes columns of ``out`` from a worker's tool and a chunk of texts."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t in out)])

    def run(batches):
        tool = _tool(kind, path)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *each(tool, texts)], schema.names)
                at += len(texts)

    return rows.mapInArrow(run, schema)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``, by the tokenizers file at ``path``.

    Null and empty texts have 0 bytes and 0 tokens; U+0000 is a character like any other, and a column of strings has no
    lone surrogates. Whole texts, one pass, no shuffle; repeated rows give repeated results, an empty table none. A text
    of one very long word costs n log n.
    """

    def each(counter: HeapCounter, texts: pa.Array):
        n = counter.counts(texts)
        return pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(n), pa.array(n > limit)

    return _run(docs, id_col, text_col, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], HeapCounter, path, each)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of ``docs``, ids as array<int>; null and empty texts have none."""

    def each(v: Vocabulary, texts: pa.Array):
        ids, ends = v.encode_texts(texts)
        return (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),)

    return _run(docs, id_col, text_col, [("ids", T.ArrayType(T.IntegerType()))], Vocabulary, path, each)


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of ``rows``; null ids give a null text, bytes that are no UTF-8 U+FFFD."""
    prepare(rows.sparkSession)
    few = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        v = _tool(Vocabulary, path)
        for batch in batches:
            texts = [None if ids is None else v.decode(ids).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return few.mapInArrow(run, T.StructType([few.schema["doc_id"], T.StructField("text", T.StringType())]))


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``, by the rank file at ``path``.

    Each match of the pattern is encoded separately, then the ids are decoded again. Null and empty texts have no ids.
    Whole texts, one pass, no shuffle; repeated rows give repeated results, an empty table none.
    """

    def each(v: Vocabulary, texts: pa.Array):
        ids, ends = v.encode_texts(texts)
        of = pa.array(ends, pa.int32())
        said = pc.binary_join(pa.ListArray.from_arrays(of, v.id_text.take(pa.array(ids))), " ")
        back = pc.binary_join(pa.ListArray.from_arrays(of, v.id_bytes.take(pa.array(ids))), b"")
        return pa.array(np.diff(ends)), _sha256(said), _sha256(back)

    return _run(docs, id_col, text_col, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], Vocabulary, path, each)
