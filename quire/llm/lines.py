"""Line deduplication by an exact set-similarity join.

A line is the set of its tokens: its runs of WIDTH words (a shorter line is one token).
Tokens are ordered by rarity over all lines. Two sets with Jaccard similarity t or more
share a token among the first ``n - ceil(t n) + 1`` of each, so only these prefixes are
indexed; length and positional filters thin the candidates, and Jaccard decides on whole
sets. A line goes if an earlier one, by (doc_id, line number), matches it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import Words, mapped, mixed, small, spread_join, stored, text_passes

WIDTH, JACCARD = 5, 0.8
#: Counters for the rarity of tokens; their number bounds what is collected and broadcast (1 MB).
COUNTER_BITS = 17
#: Bits of a sort key that number the lines of a pass; a pass with more lines is sorted by two keys.
LINE_BITS = 20
#: Sets of one cell; tokens that more sets share are split, each pair of parts being a cell.
CELL = 1024
#: Up to so many sets that share a token, those without a possible partner are dropped.
THINNED = 64
#: A posting: the token's upper bits, its set's size and its place there (each up to the most that fits, which stands for "or more").
SIZE_BITS, PLACE_BITS = 12, 8
MOST_SIZE, MOST_PLACE = (1 << SIZE_BITS) - 1, (1 << PLACE_BITS) - 1
TOKEN_SHIFT = SIZE_BITS + PLACE_BITS
#: Slots in which a task remembers sets whose prefix it has sent (8 MB).
SENT_SLOTS = 1 << 20
#: Lines to remove, or to read again, up to which their list is broadcast (some 30 bytes each).
BROADCAST_LINES = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """The lines with a word of many texts, and their tokens, as flat arrays.

    ``text``/``number`` say whose line it is and its place in that text; tokens
    ``first[i]:first[i + 1]`` (64-bit hashes, repeats included) are line i's.
    """

    def __init__(self, texts: list[str], width: int = WIDTH):
        raw = [t.encode("utf-8", "replace") for t in texts]
        w = Words(raw)
        h = w.hashes()
        breaks = np.flatnonzero(w.bytes == 10)  # each text ends with one too
        line_of = np.searchsorted(breaks, w.start)
        heads = np.flatnonzero(np.append(True, np.diff(line_of) != 0)) if len(line_of) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.append(heads, len(line_of)))
        lines = line_of[heads]
        self.text = w.of[heads] if len(heads) else heads
        self.number = lines - np.searchsorted(breaks, w.offset[:-1])[self.text]
        tokens = np.maximum(n - width + 1, 1)
        self.first = np.concatenate([[0], np.cumsum(tokens)])
        owner = np.repeat(np.arange(len(n)), tokens)
        at = heads[owner] + np.arange(self.first[-1]) - self.first[:-1][owner]
        out = np.zeros(len(at), dtype=np.uint64)
        size = np.minimum(n, width)[owner]
        for k in range(width):
            on = size > k
            out[on] = mixed(out[on] * _ODD + h[at[on] + k])
        self.tokens, self.owner = out, owner


class Sets(Lines):
    """The distinct tokens of each line, rarest first, with two hashes that identify the set."""

    def __init__(self, texts: list[str], counts: np.ndarray, width: int = WIDTH):
        super().__init__(texts, width)
        # one sort by line, then rarity in steps, then hash; lines are numbered within the pass
        rank = np.minimum(6 * np.log2(1.0 + counts), 255).astype(np.uint64) << np.uint64(36)
        key = rank[self.tokens & np.uint64(len(counts) - 1)] | self.tokens >> np.uint64(28)
        if len(self.text) <= 1 << LINE_BITS:
            order = np.argsort(self.owner.astype(np.uint64) << np.uint64(64 - LINE_BITS) | key)
        else:  # a text of very many lines, which no pass splits
            order = np.lexsort((key, self.owner))
        token, owner = self.tokens[order], self.owner[order]
        same = (key[order][1:] == key[order][:-1]) & (owner[1:] == owner[:-1])
        if (token[1:][same] != token[:-1][same]).any():  # the part of the hash in the key does not tell two tokens apart
            order = np.lexsort((self.tokens, key, self.owner))
            token, owner = self.tokens[order], self.owner[order]
        fresh = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])) if len(key) else np.zeros(0, dtype=bool)
        self.tokens, self.owner = token[fresh], owner[fresh]
        self.size = np.bincount(self.owner, minlength=len(self.text))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        if len(self.text):
            self.h1 = np.add.reduceat(mixed(self.tokens), self.first[:-1]).view(np.int64)
            self.h2 = np.add.reduceat(mixed(self.tokens ^ np.uint64(0xC2B2AE3D27D4EB4F)), self.first[:-1]).view(np.int64)
        else:
            self.h1 = self.h2 = np.zeros(0, dtype=np.int64)

    def prefix_sizes(self, t: float) -> np.ndarray:
        return self.size - np.ceil(t * self.size - 1e-9).astype(np.int64) + 1


def count_tokens(df: DataFrame, text: str, width: int = WIDTH) -> np.ndarray:
    """Occurrences of tokens over all lines, in 2**COUNTER_BITS hashed counters; each task gives one row per counter at most."""
    slots = 1 << COUNTER_BITS

    def run(batches):
        total = np.zeros(slots, dtype=np.int64)
        for b in batches:
            for _, texts in text_passes(b, text):
                total += np.bincount((Lines(texts, width).tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    got = mapped(df.select(text), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, dtype=np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text", t: float = JACCARD, width: int = WIDTH) -> DataFrame:
    """``(doc_id, line, h1)`` of each line that an earlier line matches; ``h1`` identifies the line's set.

    Equal sets are one node, found by a shuffle of hashes; only prefixes of distinct sets
    meet by token, with their sizes and places, so that the length and positional filters come before
    any set is read again. Only lines that pass them are. Cells of CELL sets bound memory; in a cell a
    line stops at the earliest match, so a large group of near copies costs about its size. Rows with a
    null id and lines without a word take no part; repeated rows have equal lines at equal places, which
    do not match each other; an empty table gives no rows.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    counts = df.sparkSession.sparkContext.broadcast(count_tokens(docs, "text", width))
    id_kind = docs.schema["doc_id"].dataType
    id_type = id_kind.simpleString()

    def find(batches):
        sent = np.arange(SENT_SLOTS) ^ 1  # no hash, since a hash has its slot's bits
        for b in batches:
            for a, texts in text_passes(b, "text"):
                s = Sets(texts, counts.value, width)
                _, one = np.unique(s.h1, return_index=True)  # a set's prefix goes out once, so copies weigh little
                slot = s.h1[one] & (SENT_SLOTS - 1)
                one, slot = (x[sent[slot] != s.h1[one]] for x in (one, slot))
                sent[slot] = s.h1[one]
                size = np.zeros(len(s.h1), dtype=np.int64)
                size[one] = s.prefix_sizes(t)[one]
                off = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(off[-1]) - np.repeat(off[:-1], size)
                token = s.tokens[place + np.repeat(s.first[:-1], size)] >> np.uint64(TOKEN_SHIFT) << np.uint64(TOKEN_SHIFT)
                posting = token.view(np.int64) | np.repeat(np.minimum(s.size, MOST_SIZE), size) << PLACE_BITS | np.minimum(place, MOST_PLACE)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(posting))
                ids = b.column("doc_id").take(pa.array(a + s.text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(s.number, pa.int32()), pa.array(s.h1), pa.array(s.h2), pa.array(s.size, pa.int32()), lists], ["doc_id", "line", "h1", "h2", "n", "prefix"])

    lines = stored(mapped(docs, find, f"doc_id {id_type}, line int, h1 long, h2 long, n int, prefix array<long>"))

    def shared(batches):
        """From a partition sorted by (posting, h1): tokens of two sets or more that may match, as (cell, part, token, h1).

        A cell is named by its sets, so that those which share several tokens meet once. A token's
        postings are sorted by their sets' sizes, and parts of a split token whose sizes are too far apart do not meet.
        """
        names = ["cell", "part", "token", "h1"]

        def rows(*cols):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        def out(posting, h1):
            fresh = np.append(True, (np.diff(posting) != 0) | (np.diff(h1) != 0))
            posting, h1 = _thinned(posting[fresh], h1[fresh], t)
            if not len(h1):
                return
            token, n = posting >> TOKEN_SHIFT, posting >> PLACE_BITS & MOST_SIZE
            heads = np.flatnonzero(np.append(True, np.diff(token) != 0))
            size = np.diff(np.append(heads, len(token)))
            name = mixed(np.add.reduceat(mixed(h1.view(np.uint64)), heads) + size.astype(np.uint64))
            few = np.repeat((size > 1) & (size <= CELL), size)
            yield rows(np.repeat(name, size)[few].view(np.int64), np.zeros(few.sum(), np.int64), token[few], h1[few])
            for i in np.flatnonzero(size > CELL).tolist():
                at, stop = int(heads[i]), int(heads[i] + size[i])
                cuts = np.append(np.arange(at, stop, CELL), stop)
                for j in range(len(cuts) - 1):  # part j meets itself and those later parts whose sizes are in reach
                    most = n[cuts[j + 1] - 1]
                    last = stop if most == MOST_SIZE else at + int(np.searchsorted(n[at:stop], most / t + 1e-6, side="right"))
                    for k in range(j, len(cuts) - 1):
                        if cuts[k] >= last:
                            break
                        own = np.concatenate([np.arange(cuts[x], cuts[x + 1]) for x in dict.fromkeys((j, k))])
                        cell = mixed(np.array([j * len(cuts) + k + 1], dtype=np.uint64) * _ODD + name[i]).view(np.int64)
                        yield rows(np.repeat(cell, len(own)), (own - at) // CELL, np.repeat(token[at], len(own)), h1[own])

        held: list[list[np.ndarray]] = []  # postings of the last, perhaps unfinished token
        for b in batches:
            posting, h1 = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(posting):
                continue
            if held and held[0][0][0] >> TOKEN_SHIFT != posting[-1] >> TOKEN_SHIFT:
                cut = int(np.searchsorted(posting >> TOKEN_SHIFT, posting[-1] >> TOKEN_SHIFT))
                held.append([posting[:cut], h1[:cut]])
                yield from out(*map(np.concatenate, zip(*held)))
                held, posting, h1 = [], posting[cut:], h1[cut:]
            elif not held:
                cut = int(np.searchsorted(posting >> TOKEN_SHIFT, posting[-1] >> TOKEN_SHIFT))
                if cut:
                    yield from out(posting[:cut], h1[:cut])
                    posting, h1 = posting[cut:], h1[cut:]
            held.append([posting, h1])
        if held:
            yield from out(*map(np.concatenate, zip(*held)))

    postings = lines.where("size(prefix) > 0").select(F.explode("prefix").alias("posting"), "h1")
    postings = postings.repartition(F.expr(f"shiftright(posting, {TOKEN_SHIFT})")).sortWithinPartitions("posting", "h1")
    meeting = mapped(postings, shared, "cell long, part long, token long, h1 long")
    meeting = stored(meeting.groupBy("cell", "part", "h1").agg(F.min("token").alias("token")))
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("p"), F.count("*").alias("copies"))
    wanted = small(meeting.select("h1").distinct()).withColumn("near", F.lit(True))
    firsts = stored(firsts.join(wanted, "h1", "left").where("copies > 1 or near"))
    sets = firsts.where("near").select("h1", "h2", F.col("p.doc_id").alias("doc_id"), F.col("p.line").alias("line"))
    # the first line of each set that has to be compared is read again, and goes straight to its cells
    visits = meeting.join(sets, "h1").select("doc_id", F.struct("line", "h1", "h2", "cell", "part", "token").alias("v"))
    need = visits.groupBy("doc_id").agg(F.collect_list("v").alias("visits"))
    if meeting.count() <= BROADCAST_LINES:
        need = F.broadcast(need)

    def read(batches):
        names = ["cell", "part", "token", "h1", "h2", "doc_id", "line", "tokens"]
        for b in batches:
            for a, texts in text_passes(b, "text"):
                lists = b.column("visits").slice(a, len(texts))
                v = lists.flatten()
                of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                line, h1, h2, cell, part, token = (v.field(i).to_numpy() for i in range(6))
                s, key = _sets_of(texts, of, line, counts.value, width)
                order = np.argsort(key)
                want = of << 32 | line
                at = np.minimum(np.searchsorted(key[order], want), max(len(key) - 1, 0))
                i = order[at] if len(key) else np.zeros(0, dtype=np.int64)
                hit = np.flatnonzero((key[i] == want) & (s.h1[i] == h1)) if len(i) else i  # else another row of this doc_id is meant
                i = i[hit]
                size = s.size[i]
                off = np.concatenate([[0], np.cumsum(size)])
                flat = s.tokens[np.arange(off[-1]) + np.repeat(s.first[i] - off[:-1], size)]
                tokens = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(flat)])
                ids = b.column("doc_id").slice(a, len(texts)).take(pa.array(of[hit]))
                cols = [pa.array(x[hit]) for x in (cell, part, token, h1, h2)]
                yield pa.RecordBatch.from_arrays([*cols, ids, pa.array(line[hit]), tokens], names)

    whole = mapped(docs.join(need, "doc_id"), read, f"cell long, part long, token long, h1 long, h2 long, doc_id {id_type}, line int, tokens binary")
    members = whole.repartition("cell").sortWithinPartitions("cell", "doc_id", "line")

    def verify(batches):
        """Cells from a partition sorted by (cell, place): each set with its earliest match in the cell."""

        def done(rows: list[tuple]):
            out = []
            n = [len(r[6]) >> 3 for r in rows]
            if len(rows) == 2 and min(n) < t * max(n) - 1e-9:
                return out
            arrays = [np.frombuffer(r[6], dtype=np.uint64) for r in rows]
            # place of a token that all share: what can be common before it, and after it
            token = np.uint64(rows[0][2] & ((1 << 64 - TOKEN_SHIFT) - 1))
            pos = [int((x >> np.uint64(TOKEN_SHIFT) == token).argmax()) for x in arrays]
            whole = np.array([x[p] for x, p in zip(arrays, pos)])
            sets_: dict[int, set[int]] = {}

            def tokens_of(i: int) -> set[int]:
                if i not in sets_:
                    sets_[i] = set(arrays[i].tolist())
                return sets_[i]

            across = len({r[1] for r in rows}) > 1
            n_all, pos_all, part = np.array(n), np.array(pos), np.array([r[1] for r in rows])
            for y in range(1, len(rows)):
                a, p = n_all[:y], pos_all[:y]
                room = np.minimum(p, pos[y]) + np.minimum(a - p, n[y] - pos[y])
                may = (np.minimum(a, n[y]) >= t * np.maximum(a, n[y]) - 1e-9) & ((room >= t / (1 + t) * (a + n[y]) - 1e-9) | (whole[:y] != whole[y]))
                if across:
                    may &= part[:y] != part[y]
                for x in np.flatnonzero(may).tolist():
                    both = len(tokens_of(x) & tokens_of(y))
                    if both >= t * (n[x] + n[y] - both) - 1e-9:
                        out.append((rows[y][3], rows[y][4], rows[x][5]))
                        break
            return out

        held, found = [], []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("cell", "part", "token", "h1", "h2")]
            places = list(zip(b.column("doc_id").to_pylist(), b.column("line").to_pylist()))
            for row in zip(*cols, places, b.column("tokens").to_pylist()):
                if held and held[0][0] != row[0]:
                    found += done(held)
                    held = []
                held.append(row)
            if found:
                yield _matches(found, id_kind)
                found = []
        if held:
            yield _matches(done(held), id_kind)

    near = mapped(members, verify, f"h1 long, h2 long, doc_id {id_type}, line int")
    near = near.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("m"))
    bound = stored(firsts.join(near, ["h1", "h2"], "left").select("h1", "h2", "copies", F.least("p", F.coalesce("m", "p")).alias("m")))
    places = lines.select("doc_id", "line", "h1", "h2")
    if bound.count() <= BROADCAST_LINES:
        out = places.join(F.broadcast(bound), ["h1", "h2"])
    else:
        out = spread_join(places, bound, ["h1", "h2"], "copies", lines.count())
    return out.where(F.struct("doc_id", "line") > F.col("m")).select("doc_id", "line", "h1")


def _thinned(posting: np.ndarray, h1: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Without the postings that have no partner under the length and positional filters; tokens of over THINNED sets stay whole.

    If the token is the first that two sets share, they have at most it and what follows it in
    both; two similar sets pass that test at their first common token at least.
    """
    token, n, place = posting >> TOKEN_SHIFT, posting >> PLACE_BITS & MOST_SIZE, posting & MOST_PLACE
    heads = np.flatnonzero(np.append(True, np.diff(token) != 0)) if len(token) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(heads, len(token)))
    of_size = np.repeat(size, size)
    keep = of_size > THINNED
    left = np.flatnonzero((of_size > 1) & ~keep)
    for d in range(1, THINNED):
        left = left[left + d < len(token)]
        left = left[token[left + d] == token[left]]
        if not len(left):
            break
        a, b = n[left], n[left + d]  # a is not above b: postings are sorted by size
        room = np.minimum(a - place[left], b - place[left + d])
        may = (a >= t * b - 1e-9) & ((room >= t / (1 + t) * (a + b) - 1e-9) | (b == MOST_SIZE))
        keep[left[may]] = keep[left[may] + d] = True
    return posting[keep], h1[keep]


def _sets_of(texts: list[str], of: np.ndarray, line: np.ndarray, counts: np.ndarray, width: int) -> tuple[Sets, np.ndarray]:
    """Sets of some lines only (``line[i]`` of ``texts[of[i]]``), and (text << 32 | line) of each."""
    picked, numbers = [], []
    wanted: dict[int, set[int]] = {}
    for i, j in zip(of.tolist(), line.tolist()):
        wanted.setdefault(i, set()).add(j)
    for i, own in wanted.items():
        whole = texts[i].split("\n")
        own = sorted(j for j in own if j < len(whole))
        picked.append("\n".join(whole[j] for j in own))
        numbers.append(np.array(own, dtype=np.int64) + (i << 32))
    s = Sets(picked, counts, width)
    key = np.array([numbers[i][j] for i, j in zip(s.text.tolist(), s.number.tolist())], dtype=np.int64)
    return s, key


def _matches(found: list[tuple], kind) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    cols = [[f[0] for f in found], [f[1] for f in found], [f[2][0] for f in found], [f[2][1] for f in found]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), to_arrow_type(kind), pa.int32()))], ["h1", "h2", "doc_id", "line"])


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", t: float = JACCARD, width: int = WIDTH, removed: str | None = None) -> DataFrame:
    """``df`` with the matched lines taken out of ``text``; all other columns and all rows stay.

    Lines without a word are neither matched nor removed. Rows that share a doc_id are one document
    (the same place is not earlier than itself); rows with a null id or null text come back as they are. A text of which
    all goes is empty. ``removed`` names a column to add, with the number of lines taken out; one of that name in ``df`` gives way.
    An empty table gives none; a long text is cut in parts of about half a million characters' worth of rows, held whole itself.
    """
    gone = stored(removals(df, doc_id, text, t, width))
    grouped = gone.groupBy("doc_id").agg(F.collect_list(F.struct("line", "h1")).alias("gone"))
    if gone.count() <= BROADCAST_LINES:
        grouped = F.broadcast(grouped)
    slots = 1 << COUNTER_BITS
    blank = np.zeros(slots, dtype=np.int64)

    def cut(batches):
        for b in batches:
            lost = b.column("text").is_null().to_numpy(zero_copy_only=False)
            for a, texts in text_passes(b, "text"):  # a batch's rows go on in parts, so that few texts are held twice
                lists = b.column("gone").slice(a, len(texts))
                n = np.zeros(len(texts), dtype=np.int32)
                if lists.null_count < len(texts):
                    v = lists.flatten()
                    sizes = np.diff(lists.offsets.to_numpy())
                    sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
                    of = np.repeat(np.arange(len(texts)), sizes)
                    line, h1 = v.field(0).to_numpy().astype(np.int64), v.field(1).to_numpy()
                    marked = set(zip((of << 32 | line).tolist(), h1.tolist()))
                    s, key = _sets_of(texts, of, line, blank, width)
                    out: dict[int, set[int]] = {}
                    for at, h in zip(key.tolist(), s.h1.tolist()):
                        if (at, h) in marked and not lost[a + (at >> 32)]:
                            out.setdefault(at >> 32, set()).add(at & 0xFFFFFFFF)
                    for k, numbers in out.items():
                        texts[k] = "\n".join(x for j, x in enumerate(texts[k].split("\n")) if j not in numbers)
                        n[k] = len(numbers)
                cols = [b.column("row").slice(a, len(texts)), pa.array(texts, pa.string(), mask=lost[a : a + len(texts)]), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, ["row", "text", "n"])

    others = [c for c in df.columns if c != text]
    nested = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    joined = nested.join(grouped, "doc_id", "left").select("row", "text", "gone")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])
    out = mapped(joined, cut, schema)
    cols = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns if c != removed]
    return out.select(*cols, *([F.col("n").cast("long").alias(removed)] if removed else []))
