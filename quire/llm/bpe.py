"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Texts of a batch are split into words with vectorised character classes, each word is
identified by a 64-bit hash of its code points, and words not met before are merged
together: the symbols of all of them lie in one flat array, adjacent pairs are looked up
by binary search over sorted pair keys, and each round merges every word's lowest-rank
pair. Encodings of words are kept in a bounded table in each Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import mapped, text_passes

NO_RANK = np.int64(1 << 40)
#: Words kept in a worker before its table is emptied, and the longest word that is kept.
KEPT_WORDS, KEPT_CHARS = 1_000_000, 64
#: Code points of kept words, by which a word found by its hash is checked, before the table is emptied.
KEPT_POINTS = 1 << 24
#: Slots of the table are two to this power, over twice the words kept.
TABLE_BITS = 21
#: Texts above this many characters are cut for encoding, always where a word must begin.
LONG_TEXT = 1 << 19
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_MULT = 0x9E3779B97F4A7C15
_tables = {_MULT: np.ones(1, dtype=np.uint64), pow(_MULT, -1, 1 << 64): np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the hash's multiplier and of its inverse modulo 2**64."""
    for base, table in _tables.items():
        if len(table) < n:
            table = np.full(max(n, 2 * len(table)), base, dtype=np.uint64)
            table[0] = 1
            _tables[base] = np.multiply.accumulate(table)
    return [t[:n] for t in _tables.values()]


def _byte_chars() -> list[int]:
    """Code point that stands for each byte in the vocabulary: printable Latin-1 stands for itself, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [0] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = b
        else:
            out[b], spare = spare, spare + 1
    return out


@dataclass(frozen=True)
class Spec:
    """What a tokenizer file says, as plain arrays that travel to the executors in one broadcast."""

    key: str
    token_bytes: list
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    byte_ids: np.ndarray
    specials: tuple

    @classmethod
    def load(cls, path: str) -> Spec:
        raw = open(path, "rb").read()
        j = json.loads(raw)
        kind = (j.get("pre_tokenizer") or {}).get("type")
        if j["model"]["type"] != "BPE" or kind != "ByteLevel" or j.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normaliser is needed")
        back = {chr(c): b for b, c in enumerate(_byte_chars())}
        vocab = j["model"]["vocab"]
        specials = tuple((t["content"], t["id"]) for t in j.get("added_tokens", []))
        token_bytes: list = [b""] * (max([*vocab.values(), *(i for _, i in specials)]) + 1)
        for t, i in vocab.items():
            token_bytes[i] = bytes(back[c] for c in t)
        for t, i in specials:
            token_bytes[i] = t.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        n = len(token_bytes)
        keys = np.array([vocab[a] * n + vocab[b] for a, b in merges], dtype=np.int64)
        ids = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        if len(np.unique(ids)) != len(ids):
            raise ValueError("two merges make the same token; whole-round merging would not be exact")
        order = np.argsort(keys)
        byte_ids = np.array([vocab[chr(c)] for c in _byte_chars()], dtype=np.int64)
        return cls(hashlib.sha256(raw).hexdigest(), token_bytes, keys[order], order.astype(np.int64), ids[order], byte_ids, specials)


_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """Class of each code point, from its general category; white space as Unicode's White_Space property has it."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                table[c] = LETTER
            elif k == "N":
                table[c] = NUMBER
            elif k == "Z":
                table[c] = SPACE
        table[[*range(9, 14), 0x85]] = SPACE
        _classes = table
    return _classes


def word_starts(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a word begins; ``first`` flags those at which a text begins.

    The words are those of the usual byte-level pattern: contractions, then runs of
    letters, numbers or other signs with one space before, then white space.
    """
    n = len(cps)
    cls = _class_table()[cps]
    space = cls == SPACE
    last = np.empty(n, dtype=bool)  # the last code point of a text
    last[:-1], last[-1] = first[1:], True
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    start = change | first
    ends_run = np.empty(n, dtype=bool)  # white space with a sign after it in the same text
    ends_run[-1] = False
    ends_run[:-1] = space[:-1] & ~space[1:]
    ends_run &= ~last
    start |= ends_run
    glued = np.zeros(n, dtype=bool)  # a sign after a blank belongs to the blank's word
    glued[1:] = ends_run[:-1] & (cps[:-1] == 32)
    start &= ~glued
    quote = np.flatnonzero((cps == 39) & start & ~last)
    if len(quote):
        room = np.concatenate([cps, [0, 0]])
        ends = np.concatenate([last, [True, True]])
        c1, c2 = room[quote + 1], np.where(ends[quote + 1], 0, room[quote + 2])
        two = np.isin(c1, [ord(x) for x in "stmd"])
        three = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        for at, size in ((quote[two], 2), (quote[three], 3)):
            for k in range(1, size):
                start[at + k] = False
            after = at + size
            start[after[(after < n)]] = True
    return start


class Codec:
    """Encoder and decoder of one tokenizer, with the table of words met so far."""

    def __init__(self, spec: Spec):
        self.spec, self.n = spec, len(spec.token_bytes)
        sizes = np.array([len(b) for b in spec.token_bytes], dtype=np.int64)
        self.flat_bytes = np.frombuffer(b"".join(spec.token_bytes), dtype=np.uint8)
        self.byte_len, self.byte_off = sizes, np.cumsum(sizes) - sizes
        self.specials = re.compile("(" + "|".join(re.escape(t) for t, _ in spec.specials) + ")") if spec.specials else None
        digits = len(str(self.n)) + 1
        self.decimal = np.zeros((self.n, digits), dtype=np.uint8)
        for i in range(self.n):
            s = f"{i},".encode()
            self.decimal[i, : len(s)] = np.frombuffer(s, dtype=np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.table = np.zeros(1 << TABLE_BITS, dtype=np.uint64)
        self.table_at = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.off = np.zeros(1 << 14, dtype=np.int64)
        self.len = np.zeros(1 << 14, dtype=np.int32)
        self.points = np.empty(1 << 16, dtype=np.uint32)
        self.points_off = np.zeros(1 << 14, dtype=np.int64)
        self.used = self.words = self.points_used = 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the token that it makes, by binary search; NO_RANK where no merge is known."""
        keys = self.spec.pair_keys
        if not len(keys):
            return np.full(len(left), NO_RANK), np.zeros(len(left), dtype=np.int64)
        pair = left * self.n + right
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[at] == pair, self.spec.pair_ranks[at], NO_RANK), self.spec.pair_ids[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each word has: merge rounds over all words at once.

        A round merges each word's lowest-rank pair wherever the word has it; only pairs
        beside a merge are looked up again. Words without a known pair leave the array.
        """
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.spec.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rank, made = np.full(len(sym), NO_RANK), np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self._ranks(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(sym):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(begins, len(sym)))
            least = np.minimum.reduceat(rank, begins)
            more = least < NO_RANK
            stay = np.repeat(more, count)
            if not more.all():
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
            pick = np.flatnonzero((rank == np.repeat(least, count)) & stay)
            if not len(pick):
                break
            head = np.append(True, np.diff(pick) != 1)  # of overlapping picks (a a a) every second one counts, from the left
            if not head.all():
                nth = np.arange(len(pick)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                pick = pick[nth % 2 == 0]
            sym[pick] = made[pick]
            stay[pick + 1] = False
            gone = np.cumsum(~stay)
            at = pick - gone[pick]
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            again = np.concatenate([at, at[at > 0] - 1])
            again = again[again + 1 < len(sym)]
            rank[at[at + 1 >= len(sym)]] = NO_RANK
            same = word[again] == word[again + 1]
            rank[again[~same]] = NO_RANK
            again = again[same]
            rank[again], made[again] = self._ranks(sym[again], sym[again + 1])
        sym, word = np.concatenate([*done_sym, sym[:0]]), np.concatenate([*done_word, word[:0]])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of the word of each hash in the table, -1 for those not met before."""
        out = np.full(len(h), -1, dtype=np.int32)
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            found = self.table_at[slot]
            hit = (self.table[slot] == h[left]) & (found >= 0)
            out[left[hit]] = found[hit]
            go = (found >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def _keep(self, hashes: np.ndarray, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        a, b = self.words, self.words + len(counts)
        self.ids = _grown(self.ids, self.used + len(ids))
        self.points = _grown(self.points, self.points_used + len(points))
        self.off, self.len, self.points_off = _grown(self.off, b), _grown(self.len, b), _grown(self.points_off, b)
        self.ids[self.used : self.used + len(ids)] = ids
        self.points[self.points_used : self.points_used + len(points)] = points
        self.off[a:b] = self.used + np.cumsum(counts) - counts
        self.len[a:b] = counts
        self.points_off[a:b] = self.points_used + np.cumsum(sizes) - sizes
        self.used, self.words, self.points_used = self.used + len(ids), b, self.points_used + len(points)
        index = np.arange(a, b, dtype=np.int32)
        slot = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(index):
            free = np.flatnonzero(self.table_at[slot] < 0)
            self.table_at[slot[free]] = index[free]
            placed = self.table_at[slot] == index
            self.table[slot[placed]] = hashes[placed]
            index, hashes, slot = index[~placed], hashes[~placed], (slot[~placed] + 1) & ((1 << TABLE_BITS) - 1)

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and per-text counts of texts without special tokens."""
        joined = "".join(texts)
        chars = np.array([len(t) for t in texts], dtype=np.int64)
        if not joined:
            return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.zeros(len(cps), dtype=bool)
        begin = np.cumsum(chars) - chars
        first[begin[chars > 0]] = True
        starts = np.flatnonzero(word_starts(cps, first))
        ends = np.append(starts[1:], len(cps))
        size = ends - starts
        # a word's hash: the polynomial of its code points, from one running sum
        up, down = _powers(len(cps))
        run = np.zeros(len(cps) + 1, dtype=np.uint64)
        np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * up, out=run[1:])
        h = (run[ends] - run[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h = (h * np.uint64(0xD6E8FEB86659FD93)) ^ size.astype(np.uint64)
        long = size > KEPT_CHARS
        if self.words + np.count_nonzero(~long) > KEPT_WORDS or self.points_used + len(cps) > KEPT_POINTS:
            self._clear()
        index = self._find(h)
        new = np.flatnonzero((index < 0) & ~long)
        if len(new):
            uniq, where = np.unique(h[new], return_index=True)
            where = new[where]
            words = [joined[a:b].encode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            self._keep(uniq, cps[_ragged(starts[where], size[where])], size[where], *self.merge(words))
            index[new] = self._find(h[new])
        # a hash only points to a word: where code points differ, the word is merged by itself
        known = np.where(long, 0, size)
        other = self.points[_ragged(self.points_off[index], known)] != cps[_ragged(starts, known)]
        if other.any():
            long[np.repeat(np.arange(len(size)), known)[other]] = True
        src, off, cnt = self.ids, self.off[index], self.len[index].astype(np.int64)
        if long.any():  # long words are merged each time
            at = np.flatnonzero(long)
            ids, counts = self.merge([joined[starts[i] : ends[i]].encode("utf-8", "replace") for i in at])
            src = np.concatenate([self.ids[: self.used], ids])
            off[at], cnt[at] = self.used + np.cumsum(counts) - counts, counts
        flat = src[_ragged(off, cnt)]
        text_of = np.searchsorted(begin + chars, starts, side="right")
        return flat, np.bincount(text_of, weights=cnt, minlength=len(texts)).astype(np.int64)

    def _parts(self, text: str) -> Iterable[str | int]:
        """The text cut at special tokens (given as ids; where two begin, the one listed first) and, if it is long, at blanks where a word must begin."""
        ids = dict(self.spec.specials)
        pieces = self.specials.split(text) if self.specials else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                yield ids[piece]
                continue
            at = 0
            while len(piece) - at > LONG_TEXT:
                cut = at + LONG_TEXT
                while cut < len(piece) and not (piece[cut] == " " and _class_table()[ord(piece[cut - 1])] != SPACE):
                    cut += 1
                yield piece[at:cut]
                at = cut
            if at < len(piece):
                yield piece[at:]

    def _encode_parts(self, parts: list[str | int]) -> np.ndarray:
        """Ids of a text's parts in order; short parts go together, so that many specials cost no passes of their own."""
        out, held, size = [], [], 0

        def flush():
            flat, n = self._encode_plain([p for p in held if isinstance(p, str)])
            runs = iter(np.split(flat, np.cumsum(n)[:-1]))
            out.extend(next(runs) if isinstance(p, str) else np.array([p], dtype=np.int32) for p in held)

        for p in parts:
            held.append(p)
            size += len(p) if isinstance(p, str) else 1
            if size > LONG_TEXT:
                flush()
                held, size = [], 0
        flush()
        return np.concatenate(out) if out else np.empty(0, dtype=np.int32)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) of all texts and each text's count; special tokens in a text become their ids."""
        odd = {i for i, t in enumerate(texts) if len(t) > LONG_TEXT or any(s in t for s, _ in self.spec.specials)}
        if not odd:
            return self._encode_plain(texts)
        out, counts = [], np.zeros(len(texts), dtype=np.int64)
        plain = [i for i in range(len(texts)) if i not in odd]
        flat, n = self._encode_plain([texts[i] for i in plain])
        by_text = dict(zip(plain, np.split(flat, np.cumsum(n)[:-1]) if plain else []))
        for i, t in enumerate(texts):
            ids = by_text[i] if i in by_text else self._encode_parts(list(self._parts(t)))
            out.append(ids)
            counts[i] = len(ids)
        return np.concatenate(out), counts

    def decode_batch(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        if not len(counts):
            return []
        size = self.byte_len[flat]
        data = self.flat_bytes[_ragged(self.byte_off[flat], size)].tobytes()
        run = np.concatenate([[0], np.cumsum(size)])
        ends = run[np.cumsum(counts)].tolist()
        begins = [0, *ends[:-1]]
        out = [data[a:b] for a, b in zip(begins, ends)]
        try:
            data.decode()
            return out if all(a == b or a >= len(data) or (data[a] & 0xC0) != 0x80 for a, b in zip(begins, ends)) else [x.decode("utf-8", "replace").encode() for x in out]
        except UnicodeDecodeError:
            return [x.decode("utf-8", "replace").encode() for x in out]

    def decimals(self, flat: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        table = self.decimal[flat].ravel()
        return table[table != 0].tobytes()[:-1]


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` elements, at least doubled if it has less."""
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


def _ragged(off: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """Indexes off[i] .. off[i]+cnt[i]-1 for all i, one after another."""
    total = int(cnt.sum())
    shift = off - (np.cumsum(cnt) - cnt)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, cnt)


_codecs: dict[str, Codec] = {}


def codec_of(spec: Spec) -> Codec:
    """The worker's codec for a tokenizer; one is kept at a time."""
    if spec.key not in _codecs:
        _codecs.clear()
        _codecs[spec.key] = Codec(spec)
    return _codecs[spec.key]


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the column ``ids`` (array<int>): the ids of each whole text.

    A null text reads as empty and gives an empty array; other columns pass through
    (one named ``ids`` is replaced); rows are neither merged nor reordered; an empty table stays empty.
    """
    spec = df.sparkSession.sparkContext.broadcast(Spec.load(tokenizer))
    df = df.drop(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        codec = codec_of(spec.value)
        for b in batches:
            for a, texts in text_passes(b, text):
                flat, n = codec.encode_batch(texts)
                col = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()))
                part = b.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, col], [*part.schema.names, ids])

    return mapped(df, run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the column ``text`` decoded from ``ids``; null ids read as none, an id outside the vocabulary is an error."""
    spec = df.sparkSession.sparkContext.broadcast(Spec.load(tokenizer))
    df = df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches):
        codec = codec_of(spec.value)
        for b in batches:
            lists = [np.asarray(x if x is not None else [], dtype=np.int64) for x in b.column(ids).to_pylist()]
            out = codec.decode_batch(np.concatenate([*lists, np.empty(0, np.int64)]), np.array([len(x) for x in lists], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.decode() for x in out], pa.string())], [*b.schema.names, text])

    return mapped(df, run, schema)


def round_trip_digests(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids again, and return digests of both, one row per input row.

    Columns: ``doc_id``, ``n_tokens`` long, ``ids_sha256`` (decimal ids joined by commas),
    ``decoded_sha256`` (the decoded text's UTF-8). A null text reads as empty; ids may be null or repeat. An empty table gives no
    rows; other columns, whatever their names, are not read.
    No shuffle; a batch is worked off in passes of about half a million characters.
    """
    spec = df.sparkSession.sparkContext.broadcast(Spec.load(tokenizer))
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        codec, sha = codec_of(spec.value), hashlib.sha256
        for b in batches:
            for a, texts in text_passes(b, text):
                flat, n = codec.encode_batch(texts)
                ends = np.cumsum(n).tolist()
                id_sha = [sha(codec.decimals(flat[e - k : e])).hexdigest() for e, k in zip(ends, n.tolist())]
                dec_sha = [sha(x).hexdigest() for x in codec.decode_batch(flat, n)]
                yield pa.RecordBatch.from_arrays([b.column(doc_id).slice(a, len(texts)), pa.array(n, pa.int64()), pa.array(id_sha), pa.array(dec_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(df.select(doc_id, text), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
