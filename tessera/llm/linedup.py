"""Line deduplication by an exact set-similarity join.

A line is the set of its tokens: its five-word shingles, lower-cased with single blanks; a line of fewer words is one token. A line goes
if an earlier line, by doc_id and then place, has Jaccard similarity of 0.8 or more with it, whether or not that one stays.

1. Lines that are equal but for case and blanks are one, by the 128-bit xxh3 of their normalised bytes; all but the first of them go.
2. Tokens are ordered by rarity: by how often their hash bucket (of ``BUCKETS``, the bound of what is broadcast) occurs in all
   lines, then by hash. Any fixed order gives the same matches; rare tokens first make short posting lists.
3. A line is indexed under its first n - ceil(0.8 n) + 1 tokens. Postings travel as packed blocks, one for each receiving partition. Lines that meet under
   a token pass the length filter and the positional filter, which counts what can still be shared behind the meeting place.
4. Under each token all lines are first held against the earliest; those it proves repeated are done, so a family of variants
   costs one pair each. The others are held against every earlier line of about their size under the token.
5. Where two lines meet, the bits in which the parities of their tokens differ bound the tokens that only one of them has; a pair beyond what
   similar lines may have is none. Pairs are verified on whole token sets, in rounds of at most ``ROUND`` tokens or as many as all the sets have,
   so what is on disk at once doesn't grow with the pairs.

A token stands for its words by a 64-bit hash that mixes every eight bytes of a word and every word, without the structure of a polynomial.

Lines without words always stay. A null text stays null and has no lines. A null doc_id comes before all others; rows that repeat a doc_id are ordered by
the hash of their text, and equal rows get equal results. An empty table gives no rows. All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, discard, pieces, stored, trim

SHINGLE = 5
BITS = 13
BUCKETS = 1 << BITS
_REST = np.uint64((1 << (64 - BITS)) - 1)
#: Postings that a task holds back at once before it sends or sorts them in.
AT_ONCE = 1 << 18
#: Tokens of the pairs that are verified at once, if the sets have no more.
ROUND = 1 << 24
#: 64-bit words of a line's parities.
WORDS = 4
_PARITY = [f"s{k}" for k in range(WORDS)]
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: The odd factors of the splitmix64 generator.
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Words longer than this are hashed one by one.
LONG_WORD = 64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all others."""
    h = (h ^ (h >> np.uint64(30))) * _FACTORS[1]
    h = (h ^ (h >> np.uint64(27))) * _FACTORS[2]
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words ``data[begin:end]``, eight bytes at a time."""
    import xxhash

    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data), "<u8", wide, strides=(1,))
    size = end - begin
    h = mixed(size.astype(np.uint64) * _FACTORS[0])
    for k in range(0, LONG_WORD, 8):
        i = np.flatnonzero(size > k)
        if not len(i):
            break
        h[i] = mixed(h[i] ^ (eight[begin[i] + k] & _LOWEST[np.minimum(size[i] - k, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]])
    return h


def blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes are tab to carriage return, or space."""
    return (data - np.uint8(9) < 5) | (data == 32)


class Lines:
    """Lines with words of a list of texts, and their tokens."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(x or "").lower().encode() for x in texts]
        self.data = data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        lines_of = np.array([1 + r.count(b"\n") for r in raw], dtype=np.int64)
        doc = np.repeat(np.arange(len(raw)), lines_of)
        first_line = np.cumsum(lines_of) - lines_of
        blank = np.concatenate(([True], blanks(data)))
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        self.begin, self.end = edge[::2], edge[1::2]  # every word is followed by a blank: the texts end with one
        upto = np.searchsorted(self.begin, np.flatnonzero(data == 10))  # words before each line's end
        of_word = np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0))
        self.line, self.at, self.n_words = np.unique(of_word, return_index=True, return_counts=True)
        self.doc = doc[self.line]
        self.number = self.line - first_line[self.doc]
        word = word_hashes(data, self.begin, self.end)
        # shingles that stay in their line, and short lines whole
        k = max(0, len(word) - SHINGLE + 1)
        inside = np.flatnonzero(of_word[:k] == of_word[SHINGLE - 1 :][:k])
        shingle = np.zeros(len(inside), dtype=np.uint64)
        for j in range(SHINGLE):
            shingle = mixed(shingle * _FACTORS[0] + word[inside + j])
        short = np.flatnonzero(self.n_words < SHINGLE)
        whole = self.n_words[short].astype(np.uint64)
        for j in range(SHINGLE - 1):
            i = np.flatnonzero(self.n_words[short] > j)
            whole[i] = mixed(whole[i] * _FACTORS[0] + word[self.at[short[i]] + j])
        self.token = np.append(shingle, whole)
        self.of = np.append(np.repeat(np.arange(len(self.line)), self.n_words)[inside], short)

    def names(self) -> np.ndarray:
        """Two 64-bit halves of each line's 128-bit hash."""
        import xxhash

        begin, last = self.begin[self.at], self.at + self.n_words - 1
        end = self.end[last] if len(last) else last
        other = np.concatenate(([0], np.cumsum(self.data - np.uint8(9) < 5, dtype=np.int32)))
        letters = np.add.reduceat(self.end - self.begin, self.at) if len(self.at) else self.at
        plain = (end - begin - letters == self.n_words - 1) & (other[end] == other[begin])
        raw, digest = memoryview(self.data), xxhash.xxh3_128_digest
        made = [digest(raw[b:e] if p else b" ".join(bytes(raw[b:e]).split())) for b, e, p in zip(begin.tolist(), end.tolist(), plain.tolist(), strict=True)]
        return np.frombuffer(b"".join(made), dtype="<i8").reshape(-1, 2)

    def sets(self, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(line index, token) without repeats, by line and then token. With ``order``, places of buckets, a token's bucket is replaced by its place, so rare ones come first."""
        token = self.token if order is None else (order[bucket(self.token)] << np.uint64(64 - BITS)) | (self.token & _REST)
        at = np.argsort(token)
        small = self.of[at].astype(np.uint16 if len(self.line) <= 1 << 16 else np.int64)
        at = at[np.argsort(small, kind="stable")]
        of, token = self.of[at], token[at]
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (token[1:] != token[:-1])
        return of[new], token[new]


def parities(of: np.ndarray, token: np.ndarray, lines: int) -> np.ndarray:
    """``WORDS`` words of bits for each line: a bit is 1 if an odd number of the line's tokens falls on it, so a token changes one bit."""
    bits = 64 * WORDS
    out = np.zeros((lines, WORDS), dtype="<i8")
    at_once = max(1, AT_ONCE // bits)
    cuts = np.searchsorted(of, np.arange(0, lines + at_once, at_once))
    for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        first = k * at_once
        some = min(at_once, lines - first)
        odd = np.bincount((of[i:j] - first) * bits + (token[i:j] % np.uint64(bits)).astype(np.int64), minlength=some * bits) & 1
        out[first : first + some] = np.packbits(odd.astype(np.uint8).reshape(some, bits), axis=1).view("<i8")
    return out


def bucket(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - BITS)).astype(np.int64)


def prefix_size(n: np.ndarray) -> np.ndarray:
    """n - ceil(0.8 n) + 1 in whole numbers."""
    return n - (4 * n + 4) // 5 + 1


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns that name a row, and its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.t1") == F.col(f"{b}.t1")) & (F.col(f"{a}.t2") == F.col(f"{b}.t2"))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each line with words, (doc_id, t1, t2, line, h1, h2), and one for each task with its token counts by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "t1", "t2", "line", "h1", "h2", "counts"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for part in pieces(b, "text"):
                x = Lines(part.column("text").to_pylist())
                total += np.bincount(bucket(x.token), minlength=BUCKETS)
                who = [part.column(c).take(pa.array(x.doc)) for c in ("doc_id", "t1", "t2")]
                h = x.names()
                yield pa.RecordBatch.from_arrays([*who, pa.array(x.number.astype(np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.nulls(len(x.doc), kinds[-1])], names=names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:-1]), pa.array([total], kinds[-1])], names=names)
        trim()

    return _keyed(docs).mapInArrow(run, "doc_id long, t1 long, t2 long, line int, h1 long, h2 long, counts array<long>")


#: A posting: a token, the line that has it there, by the halves of its hash, the line's size, and the token's place in its order.
POSTING = (("token", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("n", "<i4"), ("pos", "<i4"))
_POSTINGS = "token long, h1 long, h2 long, n int, pos int"


def _unpacked(block: bytes) -> list[np.ndarray]:
    k = len(block) // sum(np.dtype(t).itemsize for _, t in POSTING)
    out, at = [], 0
    for _, t in POSTING:
        out.append(np.frombuffer(block, t, k, at))
        at += out[-1].nbytes
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, parts: int) -> DataFrame:
    """(part, block): each line's rarest tokens as packed postings, column after column, by the partition that a token belongs to."""
    order = np.empty(BUCKETS, dtype=np.uint64)
    order[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)

    def sent(waiting: list[list[np.ndarray]]) -> pa.RecordBatch:
        held = [np.concatenate(c) for c in zip(*waiting, strict=True)]
        part = (mixed(held[0].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        there, at = np.unique(part[by], return_index=True)
        held = [c[by] for c in held]
        blocks = [b"".join(c[i:j].astype(t, copy=False).tobytes() for c, (_, t) in zip(held, POSTING, strict=True)) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(by)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(there), pa.array(blocks, pa.binary())], names=["part", "block"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            for piece in pieces(b, "text"):
                x = Lines(piece.column("text").to_pylist())
                of, token = x.sets(order)
                n, h = np.bincount(of, minlength=len(x.line)), x.names()
                pos = np.arange(len(of)) - (np.cumsum(n) - n)[of]
                by = np.lexsort((h[:, 1], h[:, 0]))
                once = np.ones(len(x.line), dtype=bool)
                once[by[1:]] = (h[by[1:]] != h[by[:-1]]).any(1)
                head = (pos < prefix_size(n)[of]) & once[of]
                of = of[head]
                waiting.append([token[head].view(np.int64), h[of, 0], h[of, 1], n[of], pos[head]])
                size += len(of)
                if size >= AT_ONCE:
                    yield sent(waiting)
                    waiting, size = [], 0
        if size:
            yield sent(waiting)
        trim()

    return docs.select("text").mapInArrow(run, "part int, block binary")


def met(packed: DataFrame, parts: int) -> DataFrame:
    """The postings of tokens that more than one line has.

    A task holds the first posting of each of its tokens, sorted, and lets it go when a second line comes; a frequent token takes no more room than a rare one.
    """
    names = [c for c, _ in POSTING]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [np.zeros(0, t) for _, t in POSTING]
        shown = np.zeros(0, dtype=bool)
        waiting: list[list[np.ndarray]] = []
        held = 0

        def take() -> Iterator[pa.RecordBatch]:
            nonlocal first, shown, waiting, held
            new = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            waiting, held = [], 0
            by = _by_token(new)
            new = [c[by] for c in new]
            fresh = np.ones(len(by), dtype=bool)  # a line's posting is there once for each batch that has the line
            fresh[1:] = (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1]) | (new[2][1:] != new[2][:-1])
            new = [c[fresh] for c in new]
            at = np.searchsorted(first[0], new[0])
            known = np.zeros(len(at), dtype=bool)
            if len(first[0]):
                near = np.minimum(at, len(first[0]) - 1)
                known = first[0][near] == new[0]
                again = known & (first[1][near] == new[1]) & (first[2][near] == new[2])
                out = known & ~again
                pair = np.unique(near[out])
                late = pair[~shown[pair]]
                shown[pair] = True
                yield from batch([np.concatenate((c[late], d[out])) for c, d in zip(first, new, strict=True)])
            rest = [c[~known] for c in new]
            lead = np.ones(len(rest[0]), dtype=bool)
            lead[1:] = rest[0][1:] != rest[0][:-1]
            size = np.diff(np.append(np.flatnonzero(lead), len(lead)))
            many = np.repeat(size > 1, size) if len(size) else np.zeros(0, bool)
            yield from batch([c[many] for c in rest])
            add = [c[lead] for c in rest]
            order = np.argsort(np.concatenate((first[0], add[0])), kind="stable")
            first = [np.concatenate((c, d))[order] for c, d in zip(first, add, strict=True)]
            shown = np.concatenate((shown, size > 1))[order]

        def batch(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for b in batches:
            for block in b.column("block").to_pylist():
                waiting.append(_unpacked(block))
                held += len(waiting[-1][0])
                if held >= AT_ONCE:
                    yield from take()
        if waiting:
            yield from take()
        trim()

    return packed.repartitionById(parts, "part").select("block").mapInArrow(run, _POSTINGS)


def _by_token(new: list[np.ndarray]) -> np.ndarray:
    """Order by token, and by line among equal tokens, of which there are few."""
    by = np.argsort(new[0])
    token = new[0][by]
    same = np.zeros(len(by), dtype=bool)
    same[1:] = token[1:] == token[:-1]
    same[:-1] |= same[1:]
    i = np.flatnonzero(same)
    j = by[i]
    by[i] = j[np.lexsort((new[2][j], new[1][j], new[0][j]))]
    return by


def _may_match(a: str, b: str) -> Column:
    """The length filter and the positional filter for Jaccard 0.8: 9 * shared >= 4 * (sizes together)."""
    n1, n2, p1, p2 = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    return (5 * n1 >= 4 * n2) & (5 * n2 >= 4 * n1) & (9 * (1 + F.least(n1 - p1 - 1, n2 - p2 - 1)) >= 4 * (n1 + n2))


def _near(a: str, b: str) -> Column:
    """What Jaccard 0.8 asks of the parities: 9 * bits that differ <= 9 * tokens that one line has alone <= sizes together."""
    apart = F.lit(0)
    for c in _PARITY:
        apart = apart + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return 9 * apart <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _size_class() -> Column:
    """Sizes within a quarter of each other are in the same or neighbouring classes."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26))).cast("int")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, lines array<int>): the numbers of the lines that go, by row of ``docs``; rows that lose none are left out."""
    every = stored(scan(docs), "lines")
    sums = every.where("counts is not null").select(F.posexplode("counts").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for k, c in sums:
        counts[k] = c
    lines = every.where("counts is null").drop("counts")
    place = F.struct("doc_id", "t1", "t2", "line")
    first = stored(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")), "first")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = stored(met(prefixes(docs, counts, parts), parts).distinct(), "met")
    postings = stored(_promising(known), "postings")
    discard(known)
    needed = postings.select("h1", "h2").distinct().join(first, ["h1", "h2"]).select("h1", "h2", "first")
    sets = stored(_token_sets(docs, needed), "sets")
    index = stored(postings.join(sets.select("h1", "h2", "first", *_PARITY), ["h1", "h2"]).select("token", "h1", "h2", "first", "n", "pos", *_PARITY), "index")
    discard(postings)
    lead = index.groupBy("token").agg(F.min(F.struct("first", "h1", "h2", "n", "pos", *_PARITY)).alias("l")).select("token", "l.*")
    one = index.alias("a").join(lead.alias("b"), F.col("a.token") == F.col("b.token")).where((F.col("b.first") < F.col("a.first")) & _may_match("a", "b") & _near("a", "b"))
    gone = _verified(one, sets)
    rest = index.join(gone, ["h1", "h2"], "left_anti").withColumn("k", F.explode(F.sequence(_size_class() - 1, _size_class() + 1)))
    sized = index.withColumn("k", _size_class())
    two = rest.alias("a").join(sized.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.k") == F.col("b.k")) & (F.col("b.first") < F.col("a.first")) & _may_match("a", "b") & _near("a", "b"))
    late = _verified(two, sets)
    for done in (sets, index):
        discard(done)
    every_gone = gone.unionByName(late).withColumn("gone", F.lit(True))
    fate = first.where("copies > 1").join(every_gone, ["h1", "h2"], "full_outer").select("h1", "h2", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    out = lines.join(fate, ["h1", "h2"]).where(F.col("gone") | ~place.eqNullSafe(F.col("first")))
    by_row = stored(out.groupBy("doc_id", "t1", "t2").agg(F.collect_set("line").alias("lines")), "repeated")
    for done in (every, first, gone, late):
        discard(done)
    return by_row


def _promising(postings: DataFrame) -> DataFrame:
    """Postings with a partner under their token that passes the filters, found by classes of size and place."""
    classes = postings.groupBy("token", "n", "pos").agg(*[f(c).alias(f"{s}{c}") for s, f in (("lo", F.min), ("hi", F.max)) for c in ("h1", "h2")])
    other = F.lit(False)
    for c in ("h1", "h2"):
        other = other | (F.col(f"b.lo{c}") != F.col(f"a.{c}")) | (F.col(f"b.hi{c}") != F.col(f"a.{c}"))
    partner = (F.col("a.token") == F.col("b.token")) & _may_match("a", "b") & other
    return postings.alias("a").join(classes.alias("b"), partner, "left_semi")


def _token_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(h1, h2, first, n, tokens, parities) of the lines in ``needed``, from one of the rows that has each first."""
    keys = ["id", "no_id", "t1", "t2"]  # without nulls, so that the rows of the join are in place to keep one of those that are equal
    named = lambda rows: rows.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})
    by_row = named(needed.select("first.*", "h1", "h2")).groupBy(*keys).agg(F.collect_list(F.struct("line", "h1", "h2")).alias("want"))
    found = named(_keyed(docs)).join(by_row, keys).groupBy(*keys).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("want").alias("want")).select("doc_id", "t1", "t2", "text", "want")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wanted: list[str] = []
        row: list[int] = []
        for i, (text, lines) in enumerate(zip(b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True)):
            every = text.split("\n")
            wanted += [every[w["line"]] for w in lines]
            row += [i] * len(lines)
        x = Lines(wanted)  # each is a text of one line
        of, token = x.sets()
        cuts = np.searchsorted(of, np.arange(len(x.line) + 1)).astype(np.int32)
        who = b.column("want").flatten()
        place = [b.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "t1", "t2")]
        odd = parities(of, token, len(x.line))
        columns = [who.field("h1"), who.field("h2"), *place, who.field("line"), pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(token.view(np.int64))), *(pa.array(odd[:, k].copy()) for k in range(WORDS))]
        yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id", "t1", "t2", "line", "n", "tokens", *_PARITY])

    made = arrow_map(found, run, "h1 long, h2 long, doc_id long, t1 long, t2 long, line int, n int, tokens array<long>, " + ", ".join(f"{c} long" for c in _PARITY))
    return made.select("h1", "h2", F.struct("doc_id", "t1", "t2", "line").alias("first"), "n", "tokens", *_PARITY)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(h1, h2) of the later lines of the pairs that are similar, as a stored table.

    A pair takes its lines' tokens along, so pairs of more tokens than a round has are dealt over several; each is done, and its files deleted, before the next.
    """
    names = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("h1", "h2")]
    each = stored(pairs.select(*names, (F.col("a.n") + F.col("b.n")).cast("long").alias("n")).distinct(), "pairs")
    tokens, room = each.agg(F.sum("n")).first()[0] or 0, sets.agg(F.sum("n")).first()[0] or 0
    rounds = -(-tokens // max(ROUND, room)) or 1
    side = lambda s: sets.select(F.col("h1").alias(f"{s}_h1"), F.col("h2").alias(f"{s}_h2"), F.col("tokens").alias(f"{s}_t"))
    shared = F.size(F.array_intersect("a_t", "b_t"))
    found = []
    for k in range(rounds):
        some = each if rounds == 1 else each.where(F.pmod(F.xxhash64("a_h1", "a_h2", "b_h1", "b_h2"), F.lit(rounds)) == k)
        both = some.drop("n").join(side("a"), ["a_h1", "a_h2"]).join(side("b"), ["b_h1", "b_h2"])
        alike = both.where(9 * shared >= 4 * (F.size("a_t") + F.size("b_t"))).select(F.col("a_h1").alias("h1"), F.col("a_h2").alias("h2")).distinct()
        if found:
            alike = alike.unionByName(found[0]).distinct()
        found.insert(0, stored(alike, "gone"))
        for old in found[1:]:
            discard(old)
        found = found[:1]
    discard(each)
    return found[0]


def dedup(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with the texts' remaining lines; with ``counts`` also n_lines and n_removed."""
    gone = repeated(docs.select("doc_id", "text")).alias("g")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("no other column"))  # under one name, so that no column of the input clashes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text", row.alias("row")).alias("d")
    joined = rows.join(gone, _same_row("d", "g"), "left")
    parts = F.split("d.text", "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("g.lines"), i)), "\n")
    text = F.when(F.col("g.lines").isNull(), F.col("d.text")).otherwise(left)
    more = [F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("g.lines"), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"d.row.`{c}`").alias(c) for c in docs.columns], *more)
