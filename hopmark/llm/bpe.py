"""Byte-pair encoding by a pair occurrence index, and decoding (operator 9).

The distinct pieces of a run of texts stand one after the other in one array of symbols. An index maps each adjacent
pair that the vocabulary can merge to all its positions. Ranks that occur are applied in ascending order from a heap;
each application changes all positions of its pair at once and enters the new pairs beside them in the index. A merge
makes only pairs of a higher rank, as its own result is part of them, so no rank comes back and the order over the whole
run is the order within each piece.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hopmark.llm.common import bounded_batches, id_and_text, pieces, tidy

#: The pattern that cuts texts into pieces before merging, of the byte-level vocabularies.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Beyond these characters, tables of different Unicode versions may cut differently; the tokenizer's own then decides.
_UNSURE = regex.compile("[^\x00-ԯ‐-‧‰-⁞€]")
#: Words whose ids a worker keeps; and the bytes of texts that are merged in one go.
CACHE, RUN = 300_000, 3 << 20
#: Words that are encoded in one go; many, as a run of the pair index costs as much for each rank as for its positions.
WORDS = 1 << 16


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others, in order, for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Cutter:
    """Cuts a text into pieces, as the tokenizer does; special tokens are pieces of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self._split = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None

    def cut(self, text: str) -> list[str]:
        if self._split is None or not any(s in text for s in self.special):
            return self._plain(text)
        return [p for part in self._split.split(text) for p in ([part] if part in self.special else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if _UNSURE.search(text) is None:
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class Numbers(dict):
    """Numbers of words, given out in the order in which they are met; `new` holds those that are not encoded yet, each behind the
    character before it, after the first `known` numbers, and is shared by several such tables."""

    known = 0

    def __init__(self, new: list[str], before: str):
        self.new, self.before = new, before

    def __missing__(self, word: str) -> int:
        new = self.new
        self[word] = i = self.known + len(new)
        new.append(self.before + word)
        return i


class FirstNumbers(Numbers):
    """The same of words at the start of a text, which are encoded behind a line end of their own; `at` holds their places in `new`."""

    def __init__(self, new: list[str]):
        super().__init__(new, "\n")
        self.at: list[int] = []

    def __missing__(self, word: str) -> int:
        self.at.append(len(self.new))
        return super().__missing__(word)


class TextEncoder(Cutter):
    """Encodes texts word by word, each distinct word once; ids are gathered by the words' numbers.

    A piece never runs over a space, or a line end, between two characters that are not white space. So where no white
    space stands beside a space or line end, the ids of a text are those of its words, each with the space or line end
    before it. Other texts, and those with special tokens, are encoded whole.
    """

    cache, words = CACHE, WORDS

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.spec["model"]["vocab"]
        chars = byte_chars()
        self.opens = np.zeros(max([*vocab.values(), *self.special.values()]) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t[0] in (chars[32], chars[10])]] = True
        self.forget()

    def forget(self) -> None:
        self.new: list[str] = []
        self.after_space, self.after_line, self.first = Numbers(self.new, " "), Numbers(self.new, "\n"), FirstNumbers(self.new)
        self.flat, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_flat(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        raise NotImplementedError

    def _learn(self) -> None:
        """Ids of the words met since the last time; -1 of them for words with white space at an end."""
        new = self.new
        if not new:
            return
        sizes, starts, parts, at = np.full(len(new), -1, np.int64), np.zeros(len(new), np.int64), [], len(self.flat)
        own = np.zeros(len(new), np.int64)
        own[self.first.at] = 1  # the line end put before a text's first word
        # of a word without white space at its ends, only the character put before it is stripped
        regular = [i for i, w in enumerate(new) if len(w.strip()) == len(w) - 1 > 0]
        for s in range(0, len(regular), self.words):
            some = regular[s : s + self.words]
            ids = self.encode_flat("".join([new[i] for i in some]))
            begin = np.flatnonzero(self.opens[ids])
            if len(begin) != len(some):
                raise AssertionError("words and their ids do not agree")
            skip = own[some]
            sizes[some], starts[some] = np.diff(np.append(begin, len(ids))) - skip, at + begin + skip
            parts.append(ids)
            at += len(ids)
        self.flat = np.concatenate([self.flat, *parts])
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, sizes])
        new.clear()
        self.first.at.clear()
        for numbers in (self.after_space, self.after_line, self.first):
            numbers.known = len(self.counts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit integers."""
        if len(self.counts) > self.cache:
            self.forget()
        after, numbers, ends = self.after_space.__getitem__, [], []
        for text in texts:
            if not any(s in text for s in self.special):
                lines = text.split("\n")
                words = lines[0].split(" ")
                numbers.append(self.first[words[0]])
                numbers.extend(map(after, words[1:]))
                for line in lines[1:]:
                    words = line.split(" ")
                    numbers.append(self.after_line[words[0]])
                    numbers.extend(map(after, words[1:]))
            ends.append(len(numbers))
        self._learn()
        at = np.array(numbers, np.int64)
        sizes = self.counts[at]
        bad = np.concatenate([[0], np.cumsum(sizes < 0)])
        sizes = np.maximum(sizes, 0)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(total[-1])]
        out, begin = [], 0
        for text, end in zip(texts, ends, strict=True):
            whole = begin == end or bad[begin] != bad[end]
            out.append((self.encode_flat(text) if whole and text else ids[total[begin] : total[end]] if not whole else ids[:0]).astype("<u4").tobytes())
            begin = end
        return out


class PairIndexEncoder(TextEncoder):
    """Merges by rank over all pieces of a run at once."""

    def __init__(self, path: str):
        super().__init__(path)
        model, chars = self.spec["model"], byte_chars()
        vocab, back = model["vocab"], {c: b for b, c in chars.items()}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in (*zip(*merges), [a + b for a, b in merges]))
        order = np.argsort(codes := (left << 32) | right, kind="stable")
        self.codes, self.code_ranks = codes[order], order
        self.left, self.right, self.made = left, right, made
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        del self.spec

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); -1 where they do not merge."""
        code = (a << 32) | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_ranks[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        if not n:
            return [b""] * len(words)
        symbols = np.append(symbols, -1)  # position n: no symbol
        follow, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(sizes)
        firsts = np.concatenate([[0], ends[:-1]])
        follow[ends[sizes > 0] - 1] = n
        before[firsts[sizes > 0]] = n
        before[n] = follow[n] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            after = follow[positions]
            ok = after < n
            positions, after = positions[ok], after[ok]
            rank = self.ranks(symbols[positions], symbols[after])
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            if len(rank) > 1:
                order = np.argsort(rank, kind="stable")
                positions, rank = positions[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, p in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts) if len(cuts) else [positions], strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(active, r)

        enter(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            after = follow[at]
            ok = (symbols[at] == a) & (symbols[after] == b)
            at, after = at[ok], after[ok]
            if a == b and len(at) > 1:  # in a run of equal symbols, every second position from its left end
                start = np.flatnonzero(np.concatenate([[True], at[1:] != after[:-1]]))
                place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at, after = at[place % 2 == 0], after[place % 2 == 0]
            if not len(at):
                continue
            symbols[at], symbols[after] = self.made[r], -1
            rest = follow[after]
            follow[at] = rest
            before[rest] = at
            before[n] = n
            left = before[at]
            enter(np.concatenate([left[left < n], at]))
        ids = np.flatnonzero(symbols[:n] >= 0)
        data, bounds = symbols[ids].astype("<u4").tobytes(), 4 * np.searchsorted(ids, np.concatenate([[0], ends]))
        return [data[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode_flat(self, text: str) -> np.ndarray:
        cut = self.cut(text)
        pieces = [*dict.fromkeys(cut)]
        ids = dict(zip(pieces, self.merge([w.encode() for w in pieces]), strict=True))
        ids |= {text: i.to_bytes(4, "little") for text, i in self.special.items()}
        return np.frombuffer(b"".join(map(ids.__getitem__, cut)), "<u4")

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; special tokens stay."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    """One encoder a worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PairIndexEncoder(path)
    return _ENCODERS[path]


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens, decoded; with digest, the SHA-256 of ids and
    decoded text as lowercase hex (ids_sha256, decoded_sha256) in their place. One row for each row of the input, so
    repeated rows repeat. Null and empty texts have no ids and decode to the empty text; a null id stays null. No
    shuffle; the only state is a bounded cache in each worker.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            for ids, texts in pieces(batch, RUN):
                coded = own.encode([t.decode("utf-8", "replace") for t in texts])
                back = [own.decode(c) for c in coded]
                counts = pa.array([len(c) // 4 for c in coded], pa.int64())
                if digest:
                    columns = [[hashlib.sha256(c).hexdigest() for c in coded], [hashlib.sha256(t.encode()).hexdigest() for t in back]]
                    yield pa.RecordBatch.from_arrays([ids, counts, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, counts, pa.array(coded, pa.binary()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    bounded_batches(df.sparkSession)
    return id_and_text(df, id_col, text_col).mapInArrow(tidy(run), schema)
