"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash over the last bytes says so, so equal
passages give equal chunks wherever they stand.

1. Each text is routed by its least chunk, so that texts with common chunks,
   wherever they lie in the corpus, mostly meet in one task.  Spark splits a
   task's texts where very many share their least chunk.
2. A task encodes each distinct chunk once, by itself, and keeps it in a memo of
   at most CHUNK_BYTES.  Of chunks that are new, each distinct word goes to the
   library once (a second memo, of WORD_BYTES).  Both end with the task.
3. A join of two chunks inside a word is repaired: the tokens of the word's two
   ends are dropped, the ends are put together and encoded again, with the next
   chunk as well if that has no white space, until the join lies at white space.
   There encoding left and right of it agrees exactly with encoding both, as
   pre-tokenization never crosses white space.

Whether a vocabulary splits so is tested when it is loaded; with one that does
not, whole texts are encoded.  Vocabularies are read, never trained.

Defined cases.  Null or empty text: no tokens, empty decoding.  A text without
white space is one word, whatever its length.  Strings of special tokens in a
text become those tokens, as in the library with add_special_tokens=False.
Repeated rows give equal rows; null ids stay null; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .earliest import batches
from .kernels import U64, Words, byte_values, mix, rolling, spans_hash, prefix, text_buffer

VOCABULARY = "word_bpe_49k.json"
WINDOW, MEAN = 16, 512  # bytes under the rolling hash; mean chunk length, a power of two
CHUNK_BYTES, WORD_BYTES = 16 << 20, 48 << 20
_WHITE = b" \t\n\r\x0b\x0c"
_PROBES = ("ab", "Don't", "12", "é́", "日本", "<|endoftext|>", "x,y", "!!", "ΑΣ", "a\x1cb")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Chunk:
    """A chunk encoded by itself: its tokens, and the ends (bytes, tokens) that a join may cut; whole: no white space in it."""

    ids: np.ndarray
    head: bytes
    head_n: int
    tail: bytes
    tail_n: int
    whole: bool


class Lexicon:
    """Tokens of words, each encoded by the library once while it is remembered."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.at, self.size = np.zeros(1 << 16, np.int32), np.zeros((1 << 14) + 1, np.int64), 0

    def _put(self, ids: list[np.ndarray]) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        first, used = len(self.index) - len(ids), int(self.at[len(self.index) - len(ids)])
        while len(self.at) <= first + len(ids):
            self.at = np.append(self.at, np.zeros_like(self.at))
        while len(self.flat) < used + n.sum():
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.at[first + 1 : first + len(ids) + 1] = used + np.cumsum(n)
        self.flat[used : used + int(n.sum())] = np.concatenate(ids)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where the tokens of each word are."""
        index = self.index
        new = list(dict.fromkeys(w for w in words if w not in index))
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            for w in part:
                index[w] = len(index)
            self._put(self.encode(part))
            self.size += sum(map(len, part)) + 150 * len(part)
        return np.fromiter((index[w] for w in words), np.int64, len(words))

    def tokens(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words one after the other, and where each word's start."""
        start = self.at[places]
        n = self.at[places + 1] - start
        cuts = np.append(0, np.cumsum(n))
        return self.flat[np.repeat(start - cuts[:-1], n) + np.arange(cuts[-1])], cuts

    def trim(self) -> None:
        if self.size > self.most:
            self.clear()


class Coder:
    """Encodes batches of texts; memos last until `forget`."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.joins = json.loads(self.tokenizer.to_str())["decoder"] is None  # decoding joins tokens by one space
        known = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.strings = [known.get(i, "") for i in range(max(known) + 1)] if self.joins else []
        self.numbers = list(map(str, range(max(known) + 1)))
        self.mark = next(((t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        self.splits = self._splits()
        self.words = Lexicon(self._encode, WORD_BYTES)
        self.chunks: dict[bytes, Chunk] = {}
        self.chunk_size = 0
        self.encoded = 0  # chunks that were not in the memo

    def forget(self) -> None:
        self.words.clear()
        self.chunks.clear()
        self.chunk_size = 0

    def _each(self, pieces: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Tokens of each piece; many pieces in one call, a special token between them, where the vocabulary has one."""
        if self.mark is None:
            return self._each(pieces)
        mark, number = self.mark
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if mark.encode() not in p]
        for k in range(0, len(plain), 128):
            some = plain[k : k + 128]
            ids = self._each([mark.encode().join([pieces[i] for i in some])])[0]
            edge = np.append(np.append(-1, np.flatnonzero(ids == number)), len(ids))
            for i, a, b in zip(some, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                out[i] = ids[a + 1 : b]
        odd = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(odd, self._each([pieces[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _splits(self) -> bool:
        """Does encoding on both sides of ASCII white space, or of the special token, give what encoding the whole gives?"""
        alone = self._each([p.encode() for p in _PROBES])
        if self.mark is not None and not all(np.array_equal(x, y) for x, y in zip(self._encode([p.encode() for p in _PROBES]), alone, strict=True)):
            self.mark = None
        one = {p: x.tolist() for p, x in zip(_PROBES, alone, strict=True)}
        spaces = [bytes([c]).decode() for c in _WHITE] + ["  ", "\n\t "]
        both = [(s, a, b) for s in spaces for a in _PROBES for b in _PROBES]
        return all(x.tolist() == one[a] + one[b] for (_, a, b), x in zip(both, self._each([f"{s}{a}{s}{b}{s}".encode() for s, a, b in both]), strict=True))

    def _fresh(self, chunks: list[bytes]) -> None:
        """Encode chunks by themselves."""
        data = np.frombuffer(b"".join(chunks), np.uint8)
        at = np.append(0, np.cumsum([len(c) for c in chunks]))
        words = Words(data, at)
        raw = data.tobytes()
        _, one, of = np.unique(words.hash, return_index=True, return_inverse=True)
        like = one[of]
        # words with one hash are compared byte by byte
        size = words.end - words.start
        same = size == size[like]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        unlike = data[np.repeat(words.start, size) + step] != data[np.minimum(np.repeat(words.start[like], size) + step, max(len(data) - 1, 0))]
        if unlike.any():
            same &= np.bincount(np.repeat(np.arange(len(size)), size), unlike, len(size)) == 0
        odd = np.flatnonzero(~same)
        pick = np.append(one, odd)
        places = self.words.places([raw[s:e] for s, e in zip(words.start[pick].tolist(), words.end[pick].tolist(), strict=True)])
        place = places[of]
        place[odd] = places[len(one) :]
        ids, cuts = self.words.tokens(place)
        first, begin, end = words.first.tolist(), words.start, words.end
        for i, chunk in enumerate(chunks):
            a, b = first[i], first[i + 1]
            mine = ids[cuts[a] : cuts[b]].copy()
            head = tail = b""
            head_n = tail_n = 0
            whole = b - a == 1 and end[a] - begin[a] == len(chunk)
            if b > a and chunk[0] not in _WHITE:
                head, head_n = raw[begin[a] : end[a]], int(cuts[a + 1] - cuts[a])
            if b > a and chunk[-1] not in _WHITE:
                tail, tail_n = raw[begin[b - 1] : end[b - 1]], int(cuts[b] - cuts[b - 1])
            self.chunks[chunk] = Chunk(mine, head, head_n, tail, tail_n, whole)
            self.chunk_size += len(chunk) + mine.nbytes + 500
        self.encoded += len(chunks)

    def batch(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Tokens of texts, given as their chunks."""
        if not self.splits:
            return self._each([b"".join(t) for t in texts])
        known = self.chunks
        fresh = list(dict.fromkeys(c for t in texts for c in t if c not in known))
        if fresh:
            self._fresh(fresh)
        plans, joins = [], []
        for text in texts:
            plan: list = []
            run, left, merged = b"", 0, False  # a word begun in the chunks before; its tokens end the last part, unless it is merged already
            for chunk in text:
                c = known[chunk]
                if run and c.head:  # repaired: both ends out, the whole word in, unless it goes on
                    if not merged:
                        plan[-1] = plan[-1][: len(plan[-1]) - left]
                    run, merged = run + c.head, True
                    if c.whole:
                        continue
                    plan += [run, c.ids[c.head_n :]]
                    joins.append(run)
                else:  # the join, if any, lies at white space
                    if merged:
                        plan.append(run)
                        joins.append(run)
                    plan.append(c.ids)
                run, left, merged = c.tail, c.tail_n, False
            if merged:  # the word that went on ends with the text
                plan.append(run)
                joins.append(run)
            plans.append(plan)
        repaired = {}
        if joins:
            joins = list(dict.fromkeys(joins))
            ids, cuts = self.words.tokens(self.words.places(joins))
            repaired = {w: ids[cuts[i] : cuts[i + 1]] for i, w in enumerate(joins)}
        none = np.zeros(0, np.int32)
        out = [np.concatenate([none, *[repaired[x] if type(x) is bytes else x for x in plan]]) for plan in plans]
        self.words.trim()
        if self.chunk_size > CHUNK_BYTES:  # the older half goes
            for key in list(known)[: len(known) // 2]:
                c = known.pop(key)
                self.chunk_size -= len(key) + c.ids.nbytes + 500
        return out

    def written(self, ids: np.ndarray) -> tuple[str, str]:
        """Decimal ids joined by a space, and the decoding."""
        listed = ids.tolist()
        numbers = " ".join([self.numbers[i] for i in listed])
        return numbers, " ".join([self.strings[i] for i in listed]) if self.joins else self.tokenizer.decode(listed, skip_special_tokens=False)


def cuts_of(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Edges of the content-defined chunks of each text; no cut inside a UTF-8 character."""
    cut = np.flatnonzero(rolling(byte_values(data), WINDOW) >> U64(64 - MEAN.bit_length() + 1) == 0) + WINDOW
    cut = cut[cut < len(data)]
    cut = cut[data[cut] & 0xC0 != 0x80]
    out = []
    # a cut counts where its whole window lies in this text
    low, high = np.searchsorted(cut, at[:-1] + WINDOW), np.searchsorted(cut, at[1:])
    listed = cut.tolist()
    for a, b, i, j in zip(at[:-1].tolist(), at[1:].tolist(), low.tolist(), high.tolist(), strict=True):
        out.append([a, *listed[i:j], b] if b > a else [])
    return out


def chunked(column: pa.Array) -> list[list[bytes]]:
    """Each text as its content-defined chunks."""
    data, at = text_buffer(column)
    raw = data.tobytes()
    return [[raw[x:y] for x, y in zip(edges, edges[1:], strict=False)] for edges in cuts_of(data, at)]


def _least_chunks(column: pa.Array) -> np.ndarray:
    """The least hash of each text's chunks (a text without any: 0)."""
    data, at = text_buffer(column)
    out = np.zeros(len(column), U64)
    i = 0
    edges = cuts_of(data, at)
    while i < len(edges):  # about a megabyte at a time
        j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1)
        base = int(at[i])
        pre = prefix(byte_values(data[base : at[min(j, len(edges))]]))
        some = [k for k in range(i, min(j, len(edges))) if edges[k]]
        if some:
            start = np.concatenate([edges[k][:-1] for k in some]) - base
            end = np.concatenate([edges[k][1:] for k in some]) - base
            n = np.array([len(edges[k]) - 1 for k in some])
            out[some] = np.minimum.reduceat(mix(spans_hash(pre, start, end)), np.cumsum(n) - n)
        i = j
    return out.view(np.int64)


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def together(docs: DataFrame) -> DataFrame:
    """The rows, those with a common least chunk in one task where Spark need not split it."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_least_chunks(batch.column("text")))], names=[*batch.schema.names, "_least"])

    return docs.mapInArrow(run, f"{kinds}, _least long").hint("rebalance", "_least")


def _encoded(docs: DataFrame, path: str | None, keep: list[str], columns: str, make) -> DataFrame:
    path = path or vocabulary_path()
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + [columns])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = coder(path)
        try:
            for batch in batches(rows, 4 << 20):
                made = make(mine, mine.batch(chunked(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(made.values()), names=[*keep, *made])
        finally:
            mine.forget()

    return together(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(run, schema)


def _digests(mine: Coder, got: list[np.ndarray]) -> dict[str, pa.Array]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pairs = [tuple(map(sha, mine.written(ids))) for ids in got]
    return {
        "n_tokens": pa.array([len(ids) for ids in got], pa.int64()),
        "ids_sha256": pa.array([a for a, _ in pairs], pa.string()),
        "decoded_sha256": pa.array([b for _, b in pairs], pa.string()),
    }


def digests(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns to keep), n_tokens, ids_sha256, decoded_sha256 of every row."""
    return _encoded(docs, path, keep or ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The operator's own output: doc_id, ids (array of int) and the decoded text."""
    make = lambda mine, got: {"ids": pa.array(got, pa.list_(pa.int32())), "decoded": pa.array([mine.written(ids)[1] for ids in got], pa.string())}
    return _encoded(docs, path, ["doc_id"], "ids array<int>, decoded string", make)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the library's decoding of column ids (null: empty)."""
    path = path or vocabulary_path()

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            texts = coder(path).tokenizer.decode_batch([x or [] for x in batch.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
