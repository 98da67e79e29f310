"""The training-data operators against brute force, round trips and held-out accuracy, on awkward small tables."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, digest, langid, linedup, packing, quality, simhash, simple8b, suffix, tokenfile, vectors, wordbpe
from tessera.llm.components import connected_components
from tessera.llm.queries import held_out, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t1 string, row int"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(12)]
    near = [t.replace(t.split()[20], "changed", 1) for t in base[:5]]
    lined = ["\n".join(prose(rng, rng.randint(1, 14)) for _ in range(8)) for _ in range(6)]
    lined.append(lined[0].upper() + "\n" + lined[1])
    odd = ["", " \n\t ", None, "a", "Ünïcödé " * 40, "The " * 300, "漢字かな交じり文" * 50, "x" * 900, "end<|endoftext|>mid  two\n\n three"]
    return base + near + lined + base[:3] + odd + [prose(rng, 3000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[0], None, None, None, None, None), (rows[1][0], "another text of a repeated id", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_empty_tables_give_no_rows(spark, empty, tmp_path):
    byte, word = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
    tokenfile.write(empty, str(tmp_path / "t"), word)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = [
        bpe.round_trip(empty, byte), tokenfile.read(spark, str(tmp_path / "t")), simhash.components(empty), digest.compare_with_edits(empty.select("doc_id", "text")), linedup.dedup(empty), packing.pack(empty, word),
        vectors.components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")), suffix.digests(empty), langid.predict(empty, langid.fit(empty)), quality.score(empty, quality.fit(empty, labels)),
    ]
    assert [df.count() for df in out] == [0] * 10


def test_bpe_is_exact_and_decodes(docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t in pairs(docs):
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.round_trip(docs, path).collect())) == want
    assert sorted(r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()) == sorted(t for _, t in pairs(docs))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_on_random_strings(name):
    from tokenizers import Tokenizer

    path, rng = vocabulary(name), random.Random(3)
    lib = Tokenizer.from_file(path)
    letters = [*" \n\t  abcXYZéÜß漢😀'stre!?.,019²\xa0\x85\x1ć​Σİ<|", "<|endoftext|>", "<|startoftext|>", " the", "'ll", "n't", "  ", "aaaa"]
    many = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    got = wordbpe.chunks(path).encode(many) if name.startswith("word") else [bpe.codec(path).encode(s) for s in many]
    for s, g in zip(many, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids, repr(s)


def test_word_ids_of_every_character():
    """Each code point between words, alone, and every pair of Latin-1 characters."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    lib, ours = Tokenizer.from_file(path), wordbpe.chunks(path)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    latin = [chr(i) for i in range(256)]
    many = [" ".join(f"ab{c}cd {c}" for c in every[i : i + 512]) for i in range(0, len(every), 512)]
    many += ["ab{}cd".format("cd ab".join(a + b for b in latin)) for a in latin] + [f"x{a}{b}" for a in latin for b in latin[:48]]
    many += ["a\x7fb", "hello\x08 world", "\x00", "\x01\x1f\x7f"]
    for s, g in zip(many, ours.encode(many), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids, repr(s)[:80]


def test_word_ids_of_long_texts(monkeypatch):
    """Texts that are cut before blanks, at any limit."""
    from tokenizers import Tokenizer

    path, rng = vocabulary("word_bpe_49k.json"), random.Random(6)
    lib = Tokenizer.from_file(path)
    many = ["".join(rng.choice(["don't", "a\u00e9", "x1", " ", "  ", "\n", "\x85", "!", "", "WORD"]) for _ in range(rng.randint(0, 400))) for _ in range(60)] + [None, "", "a" * 900, " " * 50]
    for limit in (1, 7, 100):
        monkeypatch.setattr(wordbpe, "AT_ONCE", limit)
        for s, g in zip(many, wordbpe.chunks(path).encode(many), strict=True):
            assert np.frombuffer(g, "<u4").tolist() == lib.encode(s or "", add_special_tokens=False).ids, repr(s)


@pytest.mark.parametrize("n,top", list(itertools.product((0, 1, 119, 120, 121, 4096, 4097, 9000), (1, 2, 300, 50_000, 1 << 40, 1 << 63))))
def test_simple8b_round_trips(n, top):
    v = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64) * np.uint64(2 if top == 1 << 63 else 1)
    words, at = simple8b.encode(v)
    assert (simple8b.decode(words, n, at) == v).all()
    if n > 4096:
        assert (simple8b.decode(words, n, at, 1, 2) == v[4096:8192]).all()


def test_token_files(spark, docs, tmp_path):
    word = vocabulary("word_bpe_49k.json")
    tokenfile.write(docs, str(tmp_path / "t"), word, end_id=2, per_shard=5)
    got = sorted(map(tuple, tokenfile.read(spark, str(tmp_path / "t")).drop("ids").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in pairs(docs)), key=lambda i: (i is not None, i))
    start = 0
    for _, s, n, _ in got:
        assert s == start
        start += n
    ts = [t for _, t in pairs(docs)]
    coded = {t: x + np.array([2], "<u4").tobytes() for t, x in zip(ts, wordbpe.chunks(word).encode(ts), strict=True)}
    assert collections.Counter((i, len(coded[t]) // 4, zlib.crc32(coded[t])) for i, t in pairs(docs)) == collections.Counter((i, n, c) for i, _, n, c in got)


def test_packing_is_whole_and_tight(docs):
    word, cap = vocabulary("word_bpe_49k.json"), 256
    rows = packing.pack(docs, word, 0, cap).collect()
    coded = wordbpe.chunks(word).encode([t for _, t in pairs(docs)])
    lengths = [len(x) // 4 + 1 for x in coded]
    assert sum(r.length for r in rows) == sum(lengths)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= cap
    first_fit = []
    for size in sorted((r.length for r in rows), reverse=True):
        at = next((i for i, room in enumerate(first_fit) if room >= size), None)
        if at is None:
            first_fit.append(cap - size)
        else:
            first_fit[at] -= size
    assert -(-sum(lengths) // cap) <= len(bins) <= len(first_fit)


def test_best_two_fit_beats_plain_greedy():
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3, 2, 4]] = 1, 1, 2, 0
    counts[5] = 1
    filled = packing.plan(counts, 10)
    assert sum(k for _, k in filled) == 2  # 6+2+2, 5+3
    assert sum(s * c * k for items, k in filled for s, c in items) == 18


def simhash_brute(t):
    from xxhash import xxh64_intdigest

    w = t.encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure_of(keys, linked):
    group = {k: k for k in keys}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in linked:
        group[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in keys}


def test_simhash_components(docs):
    fp = {(i, t): simhash_brute(t) for i, t in pairs(docs)}
    by = closure_of(set(fp.values()), [(a, b) for a, b in itertools.combinations(sorted(set(fp.values())), 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for (i, _), f in fp.items():
        if i is not None:
            least[by[f]] = min(least.get(by[f], i), i)
    want = collections.Counter((i, f"{simhash_brute(t):016x}", least[by[simhash_brute(t)]]) for i, t in pairs(docs))
    assert collections.Counter(map(tuple, simhash.components(docs).collect())) == want


@pytest.mark.parametrize("limit", [1, 6, 48])
def test_simhash_links_in_hot_buckets(spark, monkeypatch, limit):
    """Every link at any limit, also where all share three segments and differ in few bits."""
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(6)}
    fps |= {seeds[0] ^ (rng.getrandbits(7) << rng.choice((24, 29, 57))) for _ in range(300)} | {(1 << 64) - 1, 0, 1 << 63}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    monkeypatch.setattr(simhash, "BUCKET", limit)
    assert {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()} == want


def test_simhash_splits_leave_few_free_bits():
    for depth in range(simhash._depths() + 1):
        known = [m & (2**64 - 1) for m in simhash._known(depth)]
        assert len(known) == 3**depth and all(m & 0xFFFFFF == 0xFFFFFF for m in known)
    assert max(64 - m.bit_count() for m in known) <= simhash.FREE


def test_one_row_of_each_simhash_component(spark, docs):
    rng = random.Random(4)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(5, a, "x"), (5, a, "w"), (None, a, "v"), (9, a, "v"), (None, b, "z"), (None, b, "y"), (7, c, "z"), (7, c + " ", "z"), (7, c, "z"), (None, None, "q"), (3, "", "q")]
    named = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id int, text string, lang string, _kept int, t1 int, row int")
    assert simhash.one_of_each(named).schema == named.schema and simhash.one_of_each(named).count() == 4
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert sorted(((r.doc_id, (r.text or "").strip(), r.lang) for r in got), key=str) == sorted([(5, a, "w"), (None, b, "y"), (7, c, "z"), (3, "", "q")], key=str)
    every = simhash.components(docs).collect()
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.component_id for r in every}
    assert simhash.one_of_each(docs.select("doc_id", "text").limit(0)).count() == 0


def test_digests(docs, texts):
    rows = digest.compare_with_edits(docs.select("doc_id", "text")).collect()
    order = sorted(pairs(docs), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        q, nxt = len(t) // 4, order[(k + 1) % len(order)][1]
        want[i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(len(r.fingerprint) == 32 and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_canonical_forms(spark):
    df = spark.createDataFrame([("Ｃafé  X ",), ("café x",), ("CAFÉ\n\tx",), ("cafe x",)], "text string")
    assert df.select(digest.digest(digest.canonical(F.col("text"))).alias("d")).distinct().count() == 2


def line_set(y):
    w = y.lower().encode().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_line_dedup(spark):
    rng = random.Random(5)
    long = [prose(rng, 60) for _ in range(6)]
    rows = []
    for k in range(40):
        lines = [rng.choice(long) for _ in range(2)] + [prose(rng, rng.randint(1, 8)) for _ in range(3)]
        w = rng.choice(long).split()
        w[rng.choice((0, -1, 30))] = f"new{k}"
        rows.append((k, "\n".join([*lines, " ".join(w), ""])))
    rows += [(None, long[0]), (100, None), (101, ""), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = [], collections.Counter()
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for y in (t or "").split("\n"):
            s = line_set(y)
            if not s or not any(len(s & o) / len(s | o) >= 0.8 for o in seen):
                kept.append(y)
            if s:
                seen.append(s)
        want[i, None if t is None else "\n".join(kept)] += 2 if i == 7 else 1
    assert collections.Counter((r.doc_id, r.text) for r in linedup.dedup(docs).collect()) == want


def test_line_dedup_of_structured_words(spark):
    """Words whose polynomial hashes agree for every multiplier, words that differ in one byte at any place, and columns with the operator's own names."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    long = ["".join("xy"[i == k] for i in range(70)) for k in range(70)]
    texts = [a, b, "\n".join(long), "\n".join(w[:-1] for w in long), f"{a} {b} {a} {b}", f"{b} {a} {b} {a}", f" {a}\t{b}  {a}\x0b{b} "]
    names = "doc_id int, text string, _t1 int, t1 int, lines string, row int, g int, `a b` string"
    docs = spark.createDataFrame([(i, t, 7, 8, "x", 9, 10, "y") for i, t in enumerate(texts)], names)
    got = linedup.dedup(docs)
    assert got.schema == docs.schema
    kept = {r.doc_id: r for r in got.collect()}
    assert [kept[i].text for i in range(7)] == [*texts[:6], ""]
    assert {tuple(r)[2:] for r in kept.values()} == {(7, 8, "x", 9, 10, "y")}


def test_line_dedup_verifies_few_unlike_pairs(spark, monkeypatch):
    """Lines that share most of their tokens' kinds without being alike: pairs that are verified follow the similar ones, not the square of the lines."""
    rng = random.Random(11)
    lines = [" ".join(rng.choice("abc") for _ in range(34)) for _ in range(240)]
    lines += [" ".join([*x.split()[:-1], "new"]) for x in lines[:20]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    verify, pairs = linedup._verified, []

    def counted(found, sets):
        pairs.append(found.select("a.h1", "a.h2", "b.h1", "b.h2").distinct().count())
        return verify(found, sets)

    monkeypatch.setattr(linedup, "_verified", counted)
    seen, want = [], set()
    for i, x in enumerate(lines):
        s = line_set(x)
        if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
            want.add(i)
        seen.append(s)
    assert {r.doc_id for r in linedup.dedup(docs).where("text = ''").collect()} == want and len(want) >= 20
    assert sum(pairs) < 4 * len(want)


def test_line_dedup_in_rounds(spark, monkeypatch):
    """Pairs of more tokens than a round has are verified in several, with one result; parities differ in no more bits than sets in tokens."""
    rng = random.Random(12)
    sets = [frozenset(rng.sample(range(40), rng.randint(24, 38))) for _ in range(12)]
    of, token = (np.array(x) for x in zip(*((i, t) for i, s in enumerate(sets) for t in sorted(s)), strict=True))
    odd = linedup.parities(of, linedup.mixed(token.astype(np.uint64)), len(sets)).view(np.uint64)
    alike = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        assert sum(int(x).bit_count() for x in odd[i] ^ odd[j]) <= len(a ^ b)
    rows = spark.createDataFrame([(i, -i, len(s), sorted(s)) for i, s in enumerate(sets)], "h1 long, h2 long, n int, tokens array<long>")
    every = rows.alias("a").join(rows.alias("b"), F.col("b.h1") < F.col("a.h1"))
    want = {i for i, a in enumerate(sets) if any(alike(a, b) for b in sets[:i])}
    made = []
    monkeypatch.setattr(linedup, "ROUND", 1)
    monkeypatch.setattr(linedup, "stored", lambda df, name, f=linedup.stored: made.append(name) or f(df, name))
    assert sorted((r.h1, r.h2) for r in linedup._verified(every, rows).collect()) == [(i, -i) for i in sorted(want)]
    assert want and made.count("gone") == -(-sum(len(a) + len(b) for a, b in itertools.combinations(sets, 2)) // sum(map(len, sets)))


@pytest.mark.parametrize("most", [0, 900, 2 << 20])
def test_repeated_strings(docs, monkeypatch, most):
    """However small a key's limit is, its windows go through strings of up to the whole window."""
    monkeypatch.setattr(suffix, "MOST_BYTES", most)
    raw = [(i, t.encode()) for i, t in pairs(docs)]
    seen = collections.Counter(x[i : i + 200] for _, x in raw for i in range(len(x) - 199))
    want = collections.Counter()
    for i, x in raw:
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = len([1 for k, _ in itertools.groupby(gone) if k])
        want[i, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()] += 1
    assert collections.Counter(map(tuple, suffix.digests(docs).collect())) == want


def test_interval_expansion_on_small_alphabets():
    rng = np.random.default_rng(2)
    for k in range(60):
        segs = [bytes(rng.integers(97, 97 + 2 + k % 4, rng.integers(20, 300), dtype=np.uint8)) for _ in range(6)]
        segs += [segs[0][3:150], segs[1][::-1] + segs[2][:60]]
        seen = collections.Counter(x[i : i + 15] for x in segs for i in range(len(x) - 14))
        for x, got in zip(segs, suffix.repeated_windows(segs, 15), strict=True):
            assert got.tolist() == [i for i in range(len(x) - 14) if seen[x[i : i + 15]] > 1]
    with pytest.raises(ValueError, match="UTF-8"):
        suffix.repeated_windows([bytes(range(256))], 15)


def test_vector_links(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 24))
    rows = [(k, (centres[k % 30] + rng.normal(size=24) * rng.choice((0.05, 0.3))).tolist(), int(k % 3)) for k in range(240)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], None), (502, None, 0), (503, [0.0] * 24, 0), (504, [float("nan")] * 24, 0), (505, rows[0][1][:8], 0), (506, [None] * 24, 0), (507, [2 * x for x in rows[0][1]], 0)]
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))
    linked = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.93]
    by, n = closure_of([r[0] for r in rows], linked), collections.Counter(x for e in linked for x in e)
    got = vectors.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(linked) > 100
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(r[0], n[r[0]], by[r[0]], by[r[0]] == r[0]) for r in rows}


def test_vector_chunks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    monkeypatch.setattr(vectors, "STRIP", 5)
    test_vector_links(spark)


def test_language_held_out(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").withColumn("h", held_out())
    model = langid.fit(docs.where("not h"))
    got = langid.predict(docs.where("h").select("doc_id", "text", "lang"), model, keep=("lang",)).toPandas()
    assert len(model) == 4 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    odd = langid.predict(spark.createDataFrame([(1, None), (2, "12 34!"), (3, "")], "doc_id long, text string"), model).collect()
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)}


def test_language_of_short_texts(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.1')}/documents.parquet").withColumn("h", held_out())
    model = langid.fit(docs.where("not h"))
    short = docs.where("h").withColumn("text", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 3), " "))
    got = langid.predict(short, model, keep=("lang",)).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.96


def test_quality_held_out(spark, data):
    d = data.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet").withColumn("h", held_out()) for t in ("documents", "labels"))
    model = quality.fit(docs.where("not h"), labels.where("not h"))
    got = quality.score(docs.where("h").select("doc_id", "text"), model).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    good, bad = got[got.quality == 1].score >= quality.ACCEPT, got[got.quality == 0].score < quality.ACCEPT
    assert good.mean() > 0.97 and bad.mean() > 0.85
    assert quality.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).count() == 2


@pytest.mark.parametrize("alike", [5_000, 33_000])
def test_quality_is_fitted_on_whole_texts(spark, alike):
    rng = random.Random(11)
    shared = prose(rng, 20_000)

    def text(label):
        at = rng.randrange(60_000)
        return shared[at : at + alike] + " " + " ".join(f"{'ab'[label]}{rng.randrange(300)}" for _ in range(1_500))

    rows = [(k, text(k % 2)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs.where("doc_id >= 40"), quality.fit(docs.where("doc_id < 40"), labels)).collect()}
    assert min(got[k] for k in got if k % 2) > max(got[k] for k in got if not k % 2)


def test_pipeline_against_brute_force(spark, data):
    import corpus_pipeline as p
    from tessera.llm.queries import table

    docs = table(spark, data, "documents")
    good = p.keep_good(spark, docs, data)
    assert good.columns == docs.columns
    held = {r.doc_id: r.text for r in good.collect()}
    seen, lined = set(), {}
    known = collections.defaultdict(list)
    for i, t in sorted(held.items()):
        kept = []
        for y in t.split("\n"):
            s = line_set(y)
            near = {o for g in s for o in known[g]}
            hit = s in seen or any(len(s & o) / len(s | o) >= 0.8 for o in near)
            if not hit:
                kept.append(y)
            if s and s not in seen:
                seen.add(s)
                for g in s:
                    known[g].append(s)
        lined[i] = "\n".join(kept)
    good = spark.createDataFrame(good.collect(), docs.schema)
    two = p.drop_repeated_lines(spark, good, data)
    assert {r.doc_id: r.text for r in two.collect()} == lined
    two = spark.createDataFrame(two.collect(), docs.schema)
    fp = {i: simhash_brute(t) for i, t in lined.items()}
    by = closure_of(set(fp.values()), [(a, b) for a, b in itertools.combinations(sorted(set(fp.values())), 2) if (a ^ b).bit_count() <= 2])
    first = {}
    for i in sorted(fp):
        first.setdefault(by[fp[i]], i)
    three = p.one_of_each_group(spark, two, data)
    assert {r.doc_id for r in three.collect()} == set(first.values())
    three = spark.createDataFrame(three.collect(), docs.schema)
    raw = {r.doc_id: r.text.encode() for r in three.collect()}
    count = collections.Counter(x[k : k + 200] for x in raw.values() for k in range(len(x) - 199))
    want = {}
    for i, x in raw.items():
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if count[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want[i] = bytes(b for b, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore")
    four = p.drop_repeated_strings(spark, three, data)
    assert {r.doc_id: r.text for r in four.collect()} == want
    last = p.pack_sequences(spark, four, data).toPandas()
    assert set(last.doc_id) == set(want) and last.groupby("sequence_id").length.sum().max() <= 2048
