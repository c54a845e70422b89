"""Byte-pair encoding, decoding and token counts for tokenizer files of the ``tokenizers`` library.

Two independent ways of reaching the library's segmentation:

* ``PrefixCoder`` lengthens the encoding of a prefix of a word, which is unique, by a token that
  is compatible with its last one. The longest tokens of the vocabulary that follow are tried
  first; where none leads on to the word's end, the last token is taken back.
* ``MergeCounter`` merges the lowest-ranked adjacent pair again and again, on a heap over a
  linked list, and counts merges without naming a token.

Words repeat, so both run once per distinct word and worker, behind a bounded cache.

Defined results: null text counts as empty (no tokens); rows are independent, so repeated rows,
ties and any order give the same rows; extra columns are ignored; an empty table gives an empty
table with the same schema. Text of any length is processed whole, in time linear in its length
for encoding.
"""

from __future__ import annotations

import array
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewake.llm.common import few

#: Offset that turns the last character of a word into its word-final symbol.
FINAL = 0x1000
#: Entries in each of the two generations of a worker's caches, and the longest text that is kept.
CACHE_SIZE = 150_000
#: Pairs of tokens whose compatibility a worker remembers.
KNOWN_PAIRS = 200_000
CACHE_CHARS = 48
#: Text in which Python's own lower() and split() do what the tokenizer's normalizer does.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-ɏ]")
#: The splitting pattern of the word tokenizers, and the characters that stand for bytes in byte-level vocabularies.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-case text without unusual characters, whose letters and numbers are listed.
_LETTERS, _NUMBERS = ("".join(regex.findall(p, "".join(map(chr, range(0x250))))) for p in (r"\p{L}", r"\p{N}"))
_usual_pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+").findall
_PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_NAMES = {b: chr(b) for b in _PLAIN_BYTES} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN_BYTES)}
_CHARACTER_NAMES = {i: "".join(_BYTE_NAMES[b] for b in chr(i).encode()) for i in range(0x250)}


class Vocabulary:
    """The parts of a tokenizer file that the coders need.

    ``split(text)`` yields chunks between white space after normalization, or the pre-tokens
    themselves where the text has usual characters alone, with special tokens given as integers. Characters outside Latin, whose tables differ between Unicode versions,
    go through the library's own normalizer and splitter.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        tool = Tokenizer.from_file(path)
        self.normalize, self.pieces_of = tool.normalizer.normalize_str, tool.pre_tokenizer.pre_tokenize_str
        steps = spec["pre_tokenizer"].get("pretokenizers", [{}])
        self.usual = steps[0].get("pattern", {}).get("Regex") == _PIECES
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = {self._symbols(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.merges: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            left, right = self._symbols(left), self._symbols(right)
            self.merges[left, right] = rank
            self.parts.setdefault(left + right, (left, right, rank))

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + FINAL)
        return token

    def word(self, piece: str) -> str:
        """A pre-token's symbols: its characters, the last one in its word-final form."""
        return piece[:-1] + chr(ord(piece[-1]) + FINAL) if self.suffix else piece

    def split(self, text: str) -> Iterator[list[str] | int]:
        if self._special is None or "<|" not in text:
            yield self._chunks(text)
            return
        at = 0
        for m in self._special.finditer(text):
            yield self._chunks(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield self._chunks(text[at:])

    def _chunks(self, text: str) -> list[str]:
        if _UNUSUAL.search(text):
            return self.normalize(text).split(" ")
        text = text.lower()
        return text.split() if not self.usual or _UNUSUAL.search(text) else _usual_pieces(text)

    def pieces(self, chunk: str) -> list[str] | None:
        """The pre-tokens of a chunk of usual letters, digits and signs, each of which is such a chunk itself; null for other chunks."""
        if not self.usual or _UNUSUAL.search(chunk):
            return None
        return [chunk] if chunk.isalpha() else _usual_pieces(chunk)

    def plain_word(self, piece: str) -> str:
        """The symbols of one pre-token that ``pieces`` gives."""
        return self.word(piece if piece.isascii() and piece.isprintable() else piece.translate(_CHARACTER_NAMES))

    def words(self, chunk: str) -> list[str]:
        """The symbols of each word in a chunk."""
        if not chunk:
            return []
        if not self.usual or _UNUSUAL.search(chunk):
            return [self.word(piece) for piece, _ in self.pieces_of(chunk)]
        return [self.plain_word(piece) for piece in _usual_pieces(chunk)]


class PrefixCoder:
    """Encodes a word prefix by prefix, each ending in a token that is compatible with the last one."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tokens = {i: t for t, i in vocabulary.ids.items()}
        self.fits: dict[int, bool] = {}
        #: Tokens that merging their own symbols gives back: single symbols, and those whose two parts stay apart until their own merge.
        sound = [(t, i) for t, i in vocabulary.ids.items() if (p := vocabulary.parts.get(t)) is None or self.compatible(p[0], p[1], p[2])]
        #: symbol → (the symbols that may follow, the id of the longest token so far or -1)
        self.tree: dict[str, tuple[dict, int]] = {}
        #: Each token's number of symbols, and the longest token that it begins with or -1.
        self.sizes, self.shorter = {i: len(t) for t, i in sound}, {}
        for token, i in sorted(sound, key=lambda x: len(x[0])):
            node, best = self.tree, -1
            for symbol in token[:-1]:
                if symbol not in node:
                    node[symbol] = ({}, best)
                node, best = node[symbol]
            self.shorter[i] = best
            node[token[-1]] = ({}, i)

    def compatible(self, left: str, right: str, until: int | None = None) -> bool:
        """Whether merging left + right from single symbols comes to exactly these two tokens, and stops there (or goes on with the merge of rank ``until``).

        Walks back through the moments at which a pair of pieces met at the boundary. A merge
        across it would have happened if its rank precedes the merge that took the left piece
        away (an equal rank further left goes first) and doesn't follow the one that took the
        right piece away.
        """
        parts, merges = self.v.parts, self.v.merges
        never = len(merges) + 1
        a, b, a_gone, b_gone = left, right, never, never
        while True:
            rank = merges.get((a, b))
            if rank is not None and rank < a_gone and rank <= b_gone and not (rank == until and a is left and b is right):
                return False
            pa_, pb = parts.get(a), parts.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or pa_ is not None and pa_[2] > pb[2]:
                a, a_gone = pa_[1], pa_[2]
            else:
                b, b_gone = pb[0], pb[2]

    def encode(self, word: str) -> tuple[int, ...]:
        """The ids of a word: the longest token that fits the last one, step by step, and back where none does.

        What stands so far is the encoding of its prefix, which is unique, so a place from which
        no token leads on is given up for good.
        """
        fits, sizes, shorter, n = self.fits, self.sizes, self.shorter, len(word)
        out: list[int] = []
        given_up: set[int] = set()
        at, last = 0, -1
        while at < n:
            node, i = self.tree, -1
            for symbol in islice(word, at, None) if at else word:
                step = node.get(symbol)
                if step is None:
                    break
                node, i = step
            while True:
                if i < 0:
                    if not out:
                        raise ValueError(f"no encoding of a word of {n} symbols")
                    given_up.add(at)
                    i = out.pop()
                    at -= sizes[i]
                    last = out[-1] if out else -1
                elif not given_up or at + sizes[i] not in given_up:
                    if last < 0:
                        break
                    key = last << 20 | i
                    fit = fits.get(key)
                    if fit is None:
                        if len(fits) > KNOWN_PAIRS:
                            fits.clear()
                        fit = fits[key] = self.compatible(self.tokens[last], self.tokens[i])
                    if fit:
                        break
                i = shorter[i]
            out.append(i)
            at += sizes[i]
            last = i
        return tuple(out)


class MergeCounter:
    """Counts a word's tokens: its symbols less the merges that byte-pair merging makes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def count(self, word: str) -> int:
        ranks = self.v.merges
        n = len(word)
        piece: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, piece[i], piece[i + 1]) for i in range(n - 1) if (r := ranks.get((piece[i], piece[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or piece[i] != left or piece[j] != right:
                continue
            merges += 1
            piece[i], piece[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((piece[i], piece[k]))) is not None:
                    heapq.heappush(heap, (r, i, piece[i], piece[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((piece[h], piece[i]))) is not None:
                heapq.heappush(heap, (r, h, piece[h], piece[i]))
        return n - merges


class PieceCounter:
    """Token counts of a sentencepiece byte-pair model: pairs merged by score from a heap over a linked list, no identifiers.

    The library's normalizer prepares the text; merging, the fall back to bytes and user-defined symbols
    are done here. Words are merged apart where no piece of the vocabulary spans a word's start.
    """

    def __init__(self, path: str):
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = tool.normalize
        self.scores: dict[str, float] = {}
        self.bytes_known = tool.is_byte(tool.piece_to_id("<0x41>"))
        for i in range(tool.get_piece_size()):
            piece = tool.id_to_piece(i)
            if tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i) or tool.is_unused(i):
                continue
            self.scores[piece] = tool.get_score(i)
        space = "\u2581"
        self.apart = not any(space in p.lstrip(space) for p in self.scores)
        self._word = re.compile(f"{space}*[^{space}]*")
        self.words = Remembered(self.count)

    def count_text(self, text: str | None) -> int:
        text = self.normalize(text or "")
        if not self.apart:
            return self.count(text)
        known = self.words
        return sum([known[w] for w in self._word.findall(text) if w])

    def count(self, word: str) -> int:
        scores = self.scores
        n = len(word)
        piece: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, word[i : i + 2]) for i in range(n - 1) if (s := scores.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if piece[i] is None or (j := after[i]) >= n or piece[i] + piece[j] != joined:
                continue
            piece[i], piece[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := scores.get(joined + piece[k])) is not None:
                    heapq.heappush(heap, (-s, i, joined + piece[k]))
            if (h := before[i]) >= 0 and (s := scores.get(piece[h] + joined)) is not None:
                heapq.heappush(heap, (-s, h, piece[h] + joined))
        tokens, unknown = 0, False
        for p in piece:
            if p is None:
                continue
            if p in scores:
                tokens, unknown = tokens + 1, False
            elif self.bytes_known:
                tokens += len(p.encode())
            else:  # what isn't known side by side is one token
                tokens, unknown = tokens + (not unknown), True
        return tokens


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Remembered(dict):
    """text → value, computed once while it is kept.

    Two generations: a full young one becomes the old one, and what is asked for again moves
    back, so that frequent words stay and memory is bounded. Long texts aren't kept.
    """

    def __init__(self, compute: Callable):
        super().__init__()
        self.compute, self.old, self.more = compute, {}, []

    def forget(self) -> None:
        """Drop all that is kept, here and in what this was built on."""
        self.clear()
        self.old = {}
        for other in self.more:
            other.forget() if isinstance(other, Remembered) else other.clear()

    def __missing__(self, text: str):
        value = self.old.get(text)
        if value is None:
            value = self.compute(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_SIZE:
                self.old = dict(self)
                self.clear()
            self[text] = value
        return value


@lru_cache(maxsize=4)
def _encoder(path: str) -> tuple[Vocabulary, Remembered]:
    v = vocabulary(path)
    coder = PrefixCoder(v)

    def ids_of(word: str) -> bytes:
        return array.array("i", coder.encode(word)).tobytes()

    word_ids = Remembered(ids_of)

    def chunk_ids(chunk: str) -> bytes:
        pieces = v.pieces(chunk)
        if pieces is None:
            return b"".join([word_ids[w] for w in v.words(chunk)])
        return ids_of(v.plain_word(pieces[0])) if len(pieces) == 1 else b"".join([chunks[p] for p in pieces])

    chunks = Remembered(chunk_ids)
    chunks.more = [word_ids, coder.fits]
    return v, chunks


@lru_cache(maxsize=4)
def _counter(path: str) -> tuple[Vocabulary, Remembered]:
    v = vocabulary(path)
    counter = MergeCounter(v)
    word_count = Remembered(counter.count)

    def chunk_count(chunk: str) -> int:
        pieces = v.pieces(chunk)
        if pieces is None:
            return sum([word_count[w] for w in v.words(chunk)])
        return counter.count(v.plain_word(pieces[0])) if len(pieces) == 1 else sum([chunks[p] for p in pieces])

    chunks = Remembered(chunk_count)
    chunks.more = [word_count]
    return v, chunks


def encode_text(path: str, text: str | None) -> array.array:
    """The ids of one text."""
    v, known = _encoder(path)
    ids = array.array("i")
    for part in v.split(text or ""):
        if isinstance(part, int):
            ids.append(part)
        else:
            ids.frombytes(b"".join(map(known.__getitem__, part)))
    return ids


@lru_cache(maxsize=4)
def token_names(path: str) -> dict[int, str]:
    """All that decoding needs of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def decode_ids(path: str, ids) -> str:
    """Token names joined by a space, as a tokenizer file without a decoder gives them."""
    return " ".join(map(token_names(path).__getitem__, ids))


def count_text(path: str, text: str | None) -> int:
    v, known = _counter(path)
    return sum(1 if isinstance(part, int) else sum(map(known.__getitem__, part)) for part in v.split(text or ""))


def _lists(values: list[array.array]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate([np.frombuffer(v, dtype=np.int32) if len(v) else np.empty(0, np.int32) for v in values]) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def _forgetting(batches: Iterable[pa.RecordBatch], path: str, *parts: Callable) -> Iterator[pa.RecordBatch]:
    """Small batches; what the workers remember of words is dropped at the end of a task, so that other stages have the memory."""
    try:
        yield from few(batches)
    finally:
        for part in parts:
            if part.cache_info().currsize:
                part(path)[1].forget()


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>: each whole text encoded with the tokenizer file at ``path``."""

    def run(batches):
        for batch in _forgetting(batches, path, _encoder):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([encode_text(path, t) for t in batch.column(1).to_pylist()])], names=["id", "ids"])

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids, decoded: null ids decode to the empty text; an id outside the vocabulary fails."""

    def run(batches):
        for batch in few(batches):
            column = batch.column(1)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [decode_ids(path, flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    source = df.selectExpr(f"`{id_col}` AS id", f"coalesce(`{ids_col}`, array()) AS ids")
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def bpe_roundtrip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids, decoded: each whole text encoded, and its ids decoded, by one worker."""

    def run(batches):
        for batch in _forgetting(batches, path, _encoder):
            coded = [encode_text(path, t) for t in batch.column(1).to_pylist()]
            texts = pa.array([decode_ids(path, ids) for ids in coded], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(coded), texts], names=["id", "ids", "decoded"])

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens: UTF-8 bytes and tokens of each whole text for a ``.json`` file (tokenizers) or ``.model`` file (sentencepiece)."""

    def run(batches):
        pieces = path.endswith(".model")
        count = piece_counter(path).count_text if pieces else (lambda t: count_text(path, t))
        for batch in few(batches) if pieces else _forgetting(batches, path, _counter):
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array([count(t) for t in texts.to_pylist()], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
