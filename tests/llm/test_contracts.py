"""The registered queries, with their own parameters, on awkward tables, against plain recomputation row by row."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import langid, quality
from tessera.llm.queries import queries, vocabulary

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
OTHER = [f"{a}{b}{c}" for a in "zxwvqy" for b in "éèüö" for c in "çñß"]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def texts():
    rng = random.Random(29)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(14)]
    foreign = [prose(rng, rng.randint(30, 120), OTHER) for _ in range(10)]
    near = [t.replace(t.split()[5], "changed", 1) for t in base[:4]]
    lined = ["\n".join([base[k], prose(rng, 8), base[k + 1].upper().replace(" ", "  "), ""]) for k in range(3)]
    shared = prose(rng, 60)
    within = [f"{prose(rng, 20)} {shared} {prose(rng, 20)}" for _ in range(3)]
    odd = [None, "", " \t\n ", "\x00\x01\x08\x1b\x7f hello\x08 world a\x7fb", "x" * 900, "The " * 400, "漢字かな交じり文" * 60, "end<|endoftext|>mid  two\n\n three", "1234 56!", "é" * 210]
    giant = "\n".join(prose(rng, 400) for _ in range(480))  # over the 1 MiB that the operators take at once
    assert len(giant.encode()) > 1 << 20 or len(giant) > 700_000
    return [*base, *foreign, *near, *lined, *within, *odd, base[3], base[3], None, giant + "\n" + giant[: 1 << 19]]


@pytest.fixture(scope="module", params=["long", "int"])
def tables(request, spark, tmp_path_factory):
    """A folder of tables whose columns clash with names that the operators might use; ids are longs or ints."""
    d, kind = str(tmp_path_factory.mktemp(f"sf-{request.param}")), request.param
    rng, ts = random.Random(3), texts()
    order = list(range(len(ts)))
    rng.shuffle(order)
    extra = ["_t1", "t1", "_kept", "_chunk", "row", "line", "part", "id", "length", "key", "place"]
    rows = [(5 * i + 2, ts[i], "b" if i % 3 else None if 14 <= i < 24 else "a", "s", len(ts[i] or ""), *[7] * len(extra)) for i in order]
    rows = [(i, t, "b" if t and any(c in t for c in "éèüö") else l and "a", *rest) for i, t, l, *rest in rows]
    names = ", ".join([f"doc_id {kind}, text string, lang string, source string, n_chars long", *(f"`{c}` int" for c in extra)])
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{d}/documents.parquet")
    marks = [(5 * i + 2, int(i < 14 or 24 <= i < 28), 0) for i in range(34)] + [(5 * 15 + 2, 0, 1), (99_999, 1, 0), (None, 1, 0), (12, None, 0)]
    spark.createDataFrame(marks, f"doc_id {kind}, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    v = np.random.default_rng(8)
    centres = v.normal(size=(9, 64))
    vecs = [(k, (centres[k % 9] + v.normal(size=64) * v.choice((0.1, 0.25))).tolist(), int(k % 4)) for k in range(120)]
    vecs += [(200, None, 0), (201, [0.0] * 64, 0), (202, vecs[0][1], None), (203, vecs[0][1], 0), (204, [float("inf")] * 64, 0), (205, vecs[1][1][:10], 1), (206, [None] * 64, 1)]
    spark.createDataFrame(vecs, f"vec_id {kind}, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, sorted((r[0], r[1]) for r in rows), {r[0]: r for r in rows}, marks, vecs


def run(spark, tables, name):
    f = next(f for k, f in queries().items() if k.startswith(f"op{name}_"))
    return f(spark, tables[0])


def kinds(df, *names):
    have = dict(df.dtypes)
    return [have.get(n) for n in names]


def lib(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def test_op1(spark, tables):
    t, df = lib("byte_bpe_50k.json"), run(spark, tables, 1)
    want = {}
    for i, x in tables[1]:
        ids = ids_of(t, x)
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False)))
    assert kinds(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ["bigint", "bigint", "string", "string"]
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()} == want


def test_op2(spark, tables):
    t, df, start, want = lib("word_bpe_49k.json"), run(spark, tables, 2), 0, {}
    for i, x in tables[1]:
        ids = [*ids_of(t, x), 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert kinds(df, "doc_id", "start", "n_tokens", "ids_crc32") == ["bigint"] * 4
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()} == want


def fingerprint(x):
    from xxhash import xxh64_intdigest

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").encode().split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxh64_intdigest(s, 42) for s in g]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def closure(keys, linked):
    group = {k: k for k in keys}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in linked:
        group[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in keys}


def test_op3(spark, tables):
    fp = {i: fingerprint(x) for i, x in tables[1]}
    by = closure(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    df = run(spark, tables, 3)
    assert kinds(df, "doc_id", "fingerprint", "component_id") == ["bigint", "string", "bigint"]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()} == {i: (f"{f:016x}", by[i]) for i, f in fp.items()}


def test_op4(spark, tables):
    got = {r.doc_id: r for r in run(spark, tables, 4).collect()}
    docs = [(i, x or "") for i, x in tables[1]]
    assert len(got) == len(docs)
    alike = collections.defaultdict(set)
    for k, (i, x) in enumerate(docs):
        q, after = len(x) // 4, docs[(k + 1) % len(docs)]
        edited = x[: len(x) - q] + after[1][:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), sha(edited))
        assert r.near_next == float(r.fingerprint == got[after[0]].fingerprint) and r.near_edited == float(r.fingerprint == r.edited_fingerprint)
        assert (r.near_edited == 1.0) or " ".join(x.lower().split()) != " ".join(edited.lower().split())
        alike[x].add(r.fingerprint)
    assert all(len(f) == 1 for f in alike.values()) and len({f for s in alike.values() for f in s}) >= len(alike) - 3  # two kinds of blank texts, and near copies of none
    size = collections.Counter(r.fingerprint for r in got.values())
    assert all(r.copies == size[r.fingerprint] and r.group_id == min(i for i, o in got.items() if o.fingerprint == r.fingerprint) for r in got.values())


def line_set(y):
    w = y.lower().encode().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_op5(spark, tables):
    known, seen, want = collections.defaultdict(list), set(), {}
    for i, x in tables[1]:
        lines, kept = (x or "").split("\n"), []
        for y in lines:
            s = line_set(y)
            near = {o for g in s for o in known[g]}
            if not s or s not in seen and not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in near):
                kept.append(y)
            if s and s not in seen:
                seen.add(s)
                for g in s:
                    known[g].append(s)
        want[i] = (None, 0, None) if x is None else (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in run(spark, tables, 5).collect()} == want


def test_op6(spark, tables):
    t, df, want = lib("word_bpe_49k.json"), run(spark, tables, 6), set()
    for i, x in tables[1]:
        ids = np.array([*ids_of(t, x), 0], "<u4")
        want |= {(i, k, at, len(p := ids[at : at + 2048]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 2048))}
    assert kinds(df, "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset") == ["bigint", "int", *["bigint"] * 5]
    rows = df.collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == list(itertools.accumulate([n for _, n in sorted(b)], initial=0))[:-1] and sum(n for _, n in b) <= 2048
    room = []
    for n in sorted((r.length for r in rows), reverse=True):
        at = next((k for k, left in enumerate(room) if left >= n), None)
        room.append(2048 - n) if at is None else room.__setitem__(at, room[at] - n)
    assert len(bins) <= len(room)


def test_op7(spark, tables):
    vecs = tables[4]
    ok = [r for r in vecs if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    cos = lambda a, b: np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))
    linked = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.93]
    by, n = closure([r[0] for r in vecs], linked), collections.Counter(x for e in linked for x in e)
    df = run(spark, tables, 7)
    assert kinds(df, "n_links", "kept") == ["bigint", "boolean"] and len(linked) > 20
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()} == {(r[0], n[r[0]], by[r[0]], by[r[0]] == r[0]) for r in vecs}


def test_op8(spark, tables):
    raw = {i: (x or "").encode() for i, x in tables[1]}
    seen = collections.Counter(hash(x[k : k + 200]) for x in raw.values() for k in range(len(x) - 199))
    want = {}
    for i, x in raw.items():
        gone, kept, at = [], [], 0
        for k in range(len(x) - 199):
            if seen[hash(x[k : k + 200])] > 1:
                if gone and k <= gone[-1][1]:
                    gone[-1][1] = k + 200
                else:
                    gone.append([k, k + 200])
        for a, e in gone:
            kept.append(x[at:a])
            at = e
        want[i] = (len(x), sum(e - a for a, e in gone), len(gone), sha(b"".join([*kept, x[at:]])))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, tables, 8).collect()} == want


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op9(spark, tables):
    """Prototypes and cosines once more, a trigram at a time."""

    def vector(x):
        out = np.zeros(langid.DIMENSIONS)
        marks = [0, *(ord(c) + 1 if c.isalpha() else 0 for c in (x or "").lower()), 0]
        for a, b, c in zip(marks, marks[1:], marks[2:], strict=False):
            if b:
                out += np.roll(langid.letter_vector(a), 2) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c).astype(int)
        return out

    short = {i: x for i, x in tables[1] if len(x or "") < 2000}
    vectors = {i: vector(x) for i, x in short.items()}
    sums = collections.defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for i, x in tables[1]:
        lang = tables[2][i][2]
        if lang and x and not held(i):
            v = vectors[i] if i in vectors else langid.space().bundle([x])[0][0]
            if any(v):
                sums[lang] += v / np.linalg.norm(v)
    near = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    df = run(spark, tables, 9)
    assert len(near) == 2 and kinds(df, "doc_id", "held_out", "lang_pred", "score") == ["bigint", "boolean", "string", "double"]
    got = {r.doc_id: r for r in df.collect()}
    assert set(got) == {i for i, _ in tables[1]} and all(r.held_out == held(i) for i, r in got.items())
    for i, x in short.items():
        v = vectors[i]
        if not any(c.isalpha() for c in x or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosines = {k: float(v @ p / np.linalg.norm(v)) for k, p in near.items()}
        assert got[i].score == pytest.approx(min(1, max(0, max(cosines.values()))), abs=1e-4)
        assert got[i].lang_pred == max(cosines, key=cosines.get) or abs(np.diff(list(cosines.values()))[0]) < 1e-4


def test_op9_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(i, "same words here", x) for i, x in ((1, "q"), (2, "p"), (3, "q"), (4, "p"))], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"p"}


def test_op10(spark, tables):
    """The dictionaries, the sizes and the curve once more; the curve by plain descent."""
    import zstandard

    text, labels = dict(tables[1]), collections.defaultdict(list)
    for i, q, _ in tables[3]:
        if q in (0, 1) and (i is None or not held(i)):  # a label of no document counts for the share alone
            labels[i].append(q)
    each = {i: min(q) for i, q in labels.items()}
    chosen = {q: sorted((i, text[i]) for i in each if each[i] == q and text.get(i)) for q in (0, 1)}
    both = {q: len(rows) < 12 for q, rows in chosen.items()}

    def dictionary(q):
        raw = [t.encode() for k, (_, t) in enumerate(chosen[q]) if both[q] or k % 3]
        try:
            return zstandard.train_dictionary(quality.DICTIONARY, [t[i : i + 512] for t in raw for i in range(0, len(t), 512)]).as_bytes()
        except zstandard.ZstdError:
            return b"".join(raw)[-quality.DICTIONARY :]

    tools = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary(q)), write_content_size=False, write_checksum=False, write_dict_id=False) for q in (1, 0)]

    def measured(x):
        raw = (x or "").encode()
        good, bad = (sum(len(c.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)) for c in tools)
        if not raw:
            return [0.0, 0.0, 0.0, 1.0]
        return [100 * (bad - good) / (good + bad), (bad - good) / math.sqrt(good + bad), -10 * max(0.0, 0.25 - min(good, bad) / len(raw)), 1.0]

    rows = [(measured(t), q) for q in (0, 1) for k, (_, t) in enumerate(chosen[q]) if both[q] or k % 3 == 0]
    x, y = np.array([r for r, _ in rows]), np.array([q for _, q in rows], dtype=float)
    prior = min(max(sum(each.values()) / len(each), 0.02), 0.98)
    share = np.where(y > 0, prior / y.sum(), (1 - prior) / (1 - y).sum()) * len(y)
    w = np.array(quality._logistic(x[:, :3], y, prior))
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    assert np.abs(x.T @ (share * (p - y)) + 1e-2 * w).max() < 1e-6  # the curve's gradient is zero there
    df = run(spark, tables, 10)
    assert kinds(df, "doc_id", "held_out", "score", "predicted") == ["bigint", "boolean", "double", "int"]
    got = {r.doc_id: r for r in df.collect()}
    assert set(got) == set(text)
    for i, t in text.items():
        want = 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(measured(t), w))))))
        assert got[i].score == pytest.approx(want, abs=1e-9)
        assert got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.7)


def test_compressors_are_kept_by_whole_dictionaries():
    tail = bytes(range(64)) * 2
    a, b = (b"some words that stand in one text only " * 9 + tail, b"zzzz yyyy xxxx " * 20 + tail)
    text = ["some words that stand in one text only", None]
    n, good, bad = quality.sizes(a, b, text)[0]
    assert good < bad and quality.sizes(b, a, text) == [(n, bad, good), (0, 0, 0)]
