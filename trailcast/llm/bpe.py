"""BPE encoding as a bounded-lookahead streaming transducer, decoding as a byte-to-text state machine.

Encoding reads a text in pieces. Words (pretokens) are cut where no later character can move the
cut. Inside a word the transducer keeps, for each position, the last token of the encoding of the
prefix that ends there: that token is unique, and it fits the token before it exactly if the merge
list does not join anything across their border. A token is stable, and emitted, once all
positions within the lookahead go back to it. The lookahead follows from the merge list: no later
byte can change a token that ends further back than the longest token times the longest chain of
merges that can undo each other at a border.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Characters of a text that are read at once.
PIECE = 1 << 16
#: Words whose encoding is remembered in a task; the memory is emptied when it is full.
REMEMBERED = 500_000
#: Longer words are not remembered, so its memory is bounded.
REMEMBERED_CHARS = 32
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class Vocabulary:
    """A byte-level merge list: tokens as bytes, ranks of merges, edges of tokens."""

    def __init__(self, spec: dict):
        model = spec["model"]
        letters = byte_letters()
        raw = {piece: bytes(letters[c] for c in piece) for piece in model["vocab"] if all(c in letters for c in piece)}
        self.ids: dict[bytes, int] = {raw[p]: i for p, i in model["vocab"].items() if p in raw}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        self.special_pattern = regex.compile("|".join(
            regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.longest_special = max(map(len, special), default=0)
        self.ranks: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.ids[raw[p]] for p in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            self.ranks[a, b] = rank
            halves.setdefault(whole, (rank, a, b))
        self.lengths = {i: len(b) for i, b in self.bytes_of.items()}
        # Symbols that form a token's left and right edge over time, each with the rank that ends it.
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        for token in sorted(self.ids.values(), key=self.lengths.get):
            if token in halves:
                rank, a, b = halves[token]
                self.left[token] = [*self.left[a][:-1], (a, rank), (token, _NEVER)]
                self.right[token] = [*self.right[b][:-1], (b, rank), (token, _NEVER)]
            else:
                self.left[token] = self.right[token] = [(token, _NEVER)]
        self.longest = max((len(b) for b in self.ids), default=1)
        self.lookahead = self.longest * self._chain()
        #: Lengths of tokens by their last byte, longest first: what can end at a position.
        ends: dict[int, set[int]] = {}
        for b in self.ids:
            ends.setdefault(b[-1], set()).add(len(b))
        self.ends = {x: sorted(v, reverse=True) for x, v in ends.items()}
        starts: dict[int, set[int]] = {}
        for b in self.ids:
            starts.setdefault(b[0], set()).add(len(b))
        #: Lengths of at most k bytes of tokens by their first byte, longest first: [byte][k].
        self.starts_upto = [[tuple(sorted((n for n in starts.get(x, ()) if n <= k), reverse=True))
                             for k in range(REMEMBERED_CHARS * 4 + 1)] for x in range(256)]
        self.fits = lru_cache(1 << 18)(self._fits)

    def bytes_of_ids(self, ids: Iterable[int]) -> bytes:
        """Bytes that ids stand for; unknown ids stand for none."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids])

    def _chain(self) -> int:
        """Longest chain of merges, each of higher rank than the next, of which one's right part starts the next's left.

        Such a chain passes a change at its far end back to its start; no change goes further.
        """
        longest: dict[int, int] = {}  # by the token a merge starts with: longest chain from there on
        best = 1
        starts: dict[int, int] = {}
        for (a, b), _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            length = 1 + max((starts.get(edge, 0) for edge, _ in self.left[b]), default=0)
            for edge, _ in self.left[a]:
                if starts.get(edge, 0) < length:
                    starts[edge] = length
            best = max(best, length)
        return best

    def _fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border when the texts of two tokens stand side by side."""
        right, left, ranks = self.right[a], self.left[b], self.ranks
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            rank = ranks.get((x, y), _NEVER)
            # Of equal ranks the merge further left comes first.
            if rank < x_ends and rank <= y_ends and rank < _NEVER:
                return False
            if x_ends == _NEVER and y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_word(self, word: bytes) -> Iterator[int]:
        """Tokens of one word, each emitted as soon as it is stable."""
        token = self.ids.get(word)
        if token is not None and self._whole(token):
            yield token
            return
        ids, ends, fits = self.ids, self.ends, self.fits
        if len(word) <= REMEMBERED_CHARS * 4 and len(word) < self.lookahead:
            yield from self._short(word)
            return
        last: list[int] = [-1]  # last[k]: last token of the prefix that ends at base + k
        base, check = 0, self.lookahead
        for at in range(1, len(word) + 1):
            for size in ends[word[at - 1]]:
                back = at - size
                if back < base:
                    continue
                token = ids.get(word[back:at])
                if token is None:
                    continue
                before = last[back - base]
                if before < 0 or fits(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")
            if at - base >= check:
                stable = self._stable(last, base, at)
                yield from self._back(last, base, stable)
                # Positions before the stable one are not needed any more; its token is what comes before.
                last = last[stable - base:]
                base = stable
                check = max(self.lookahead, 2 * (at - base))
        yield from self._back(last, base, base + len(last) - 1)

    def _short(self, word: bytes) -> list[int]:
        """Tokens of a word that ends within the lookahead, so that none has to leave early.

        The one sequence whose neighbours all fit, searched longest token first.
        """
        find, fits, sizes, n = self.ids.get, self.fits, self.starts_upto, len(word)
        out: list[int] = []
        ways: list[Iterator[int]] = []
        failed: set[tuple[int, int]] = set()
        at, before, way = 0, -1, iter(sizes[word[0]][n])
        while True:
            for size in way:
                token = find(word[at:at + size])
                if token is not None and (before < 0 or fits(before, token)):
                    if at + size == n:
                        out.append(token)
                        return out
                    if not failed or (at + size, token) not in failed:
                        break
            else:
                if not out:
                    raise ValueError("a byte has no token")
                failed.add((at, before))
                at -= self.lengths[out.pop()]
                before, way = out[-1] if out else -1, ways.pop()
                continue
            out.append(token)
            ways.append(way)
            at, before = at + size, token
            way = iter(sizes[word[at]][n - at])

    def _whole(self, token: int) -> bool:
        """Whether the merge list makes the token of its own bytes: it is a byte or the merge of fitting halves."""
        return True if len(self.left[token]) == 1 else self._made(token)

    def _made(self, token: int) -> bool:
        known = self.__dict__.setdefault("_made_known", {})
        if token not in known:
            a, b = self.left[token][-2][0], self.right[token][-2][0]
            # Nothing may cross the border before the last merge itself.
            last = self.left[token][-2][1]
            crossing = [r for r in self._crossings(a, b) if r < last]
            known[token] = not crossing and self._whole(a) and self._whole(b)
        return known[token]

    def _crossings(self, a: int, b: int) -> Iterator[int]:
        right, left = self.right[a], self.left[b]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            rank = self.ranks.get((x, y), _NEVER)
            if rank < x_ends and rank <= y_ends and rank < _NEVER:
                yield rank
                return
            if x_ends == _NEVER and y_ends == _NEVER:
                return
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _stable(self, last: list[int], base: int, at: int) -> int:
        """Latest token end that the encodings of all prefixes within reach share."""
        # Any later token starts at one of the last `longest` positions.
        open_ends = {k for k in range(max(base, at - self.longest + 1), at + 1)}
        while len(open_ends) > 1:
            far = max(open_ends)
            open_ends.remove(far)
            if far == base:
                return base
            open_ends.add(far - self.lengths[last[far - base]])
        return max(open_ends.pop(), base)

    def _back(self, last: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            token = last[end - base]
            out.append(token)
            end -= self.lengths[token]
        return out[::-1]


@lru_cache(4)
def load(spec: str) -> Vocabulary:
    """Vocabulary of a tokenizer file's JSON text."""
    return Vocabulary(json.loads(spec))


class Encoder:
    """Encodes texts word by word; words seen before come from a bounded memory."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.words = regex.compile(pattern)
        self.memory: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def _tokens(self, word: str) -> tuple[tuple[int, ...], str, bytes]:
        """Ids of a word, the ids as text, and the bytes the ids stand for."""
        found = self._entry(tuple(self.vocabulary.encode_word(word.encode())))
        if len(word) <= REMEMBERED_CHARS:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[word] = found
        return found

    def _entry(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str, bytes]:
        return ids, ",".join(map(str, ids)), self.vocabulary.bytes_of_ids(ids)

    def _cut(self, text: str) -> tuple[list[str], str]:
        """Words of a piece that no later character can change, and the rest.

        A word may grow, or give its last space to the word behind it, until two further words
        begin; so the last two words wait.
        """
        words = self.words.findall(text)
        if len(words) < 3:
            return [], text
        rest = words[-2] + words[-1]
        return words[:-2], rest

    def _stream(self, pieces: Iterable[str]) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        memory, make = self.memory.get, self._tokens
        rest = ""
        for piece in pieces:
            words, rest = self._cut(rest + piece)
            yield [memory(w) or make(w) for w in words]
        if rest:
            yield [memory(w) or make(w) for w in self.words.findall(rest)]

    def encode(self, text: str) -> Iterator[list[int]]:
        """Token ids of a text, in lists. Special tokens' strings in it become their ids."""
        for entries in self.entries(text):
            yield [t for entry in entries for t in entry[0]]

    def entries(self, text: str) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """Like ``encode``, word by word: ids, ids as text, bytes of the ids."""
        special = self.vocabulary.special_pattern
        at = 0
        if special is not None:
            for match in special.finditer(text):
                yield from self._stream(_pieces(text, at, match.start()))
                yield [self._entry((self.vocabulary.special[match.group()],))]
                at = match.end()
        yield from self._stream(_pieces(text, at, len(text)))


def _pieces(text: str, start: int, end: int) -> Iterator[str]:
    for at in range(start, end, PIECE):
        yield text[at:min(end, at + PIECE)]


class Decoder:
    """Ids to text in steps: bytes of an unfinished character wait for the next token."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of_ids = vocabulary.bytes_of_ids
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """Text that is complete after these ids. Unknown ids give nothing."""
        return self.state.decode(self.bytes_of_ids(ids))

    def feed_bytes(self, raw: bytes) -> str:
        """The same from the bytes of ids."""
        return self.state.decode(raw)

    def end(self) -> str:
        """What remains: an unfinished character is one replacement character."""
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


def encode(docs: DataFrame, spec: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of every text (null: the empty text) as an array; one narrow pass.

    ``spec`` is the JSON text of a byte-level tokenizer file and ``pattern`` its word pattern. An
    input column called like the result is replaced, others pass through; repeated rows are alike.
    """
    return _mapped(docs.drop(ids), spec, pattern, text, StructType().add(ids, ArrayType(IntegerType())), _ids_of)


def round_trip(docs: DataFrame, spec: str, pattern: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 to every row: encode, then decode the ids.

    Digests are fed while the text streams through, so no list of ids is held. Null texts are
    empty: no tokens and the digests of the empty text. Input columns of these names are replaced.
    """
    fields = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                         StructField("decoded_sha256", StringType())])
    return _mapped(docs.drop(*fields.names), spec, pattern, text, fields, _digests_of)


def tokenized(docs: DataFrame, spec: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ids, n_tokens and decoded_sha256 (of the text that the ids decode to) to every row.

    Null texts are empty. Input columns of these names are replaced.
    """
    fields = StructType().add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("decoded_sha256", "string")
    return _mapped(docs.drop(*fields.names), spec, pattern, text, fields, _tokenized_of)


def _mapped(docs: DataFrame, spec: str, pattern: str, text: str, fields: StructType, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((spec, pattern))  # a vocabulary file: bounded
    at = docs.columns.index(text)
    types = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[
        f.dataType.simpleString()]) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(shared.value[0]), shared.value[1])
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [make(encoder, x.as_py()) for x in part.column(at)]
                new = [pa.array([r[k] for r in rows], types.field(k).type) for k in range(len(types))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *types.names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields.fields]))


def _ids_of(encoder: Encoder, text: str | None) -> tuple:
    return (np.concatenate([np.zeros(0, np.int32), *[np.array(x, np.int32) for x in encoder.encode(text or "")]]),)


def _digests_of(encoder: Encoder, text: str | None) -> tuple:
    ids_digest, text_digest, n = sha256(), sha256(), 0
    decoder = Decoder(encoder.vocabulary)
    for part in encoder.entries(text or ""):
        if part:
            ids, names, raw = zip(*part)
            ids_digest.update(("," * (n > 0) + ",".join(names)).encode())
            text_digest.update(decoder.feed_bytes(b"".join(raw)).encode())
            n += sum(map(len, ids))
    text_digest.update(decoder.end().encode())
    return n, ids_digest.hexdigest(), text_digest.hexdigest()


def _tokenized_of(encoder: Encoder, text: str | None) -> tuple:
    decoder, digest = Decoder(encoder.vocabulary), sha256()
    parts: list[np.ndarray] = [np.zeros(0, np.int32)]
    for entries in encoder.entries(text or ""):
        parts.append(np.fromiter((i for ids, _, _ in entries for i in ids), np.int32))
        digest.update(decoder.feed_bytes(b"".join([raw for _, _, raw in entries])).encode())
    digest.update(decoder.end().encode())
    ids = np.concatenate(parts)
    return ids, len(ids), digest.hexdigest()
