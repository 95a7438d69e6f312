"""Exact copies, vector codes and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm_operators import SCHEMA, odd_rows

from tidemark.llm import codebooks, copies, queries, tandem

# --- counting quotient filters


@pytest.mark.parametrize("bits", [64, 60, 40])
@pytest.mark.parametrize("n", [0, 1, 2, 5, 3000])
def test_filters_hold_every_fingerprint_and_its_count(bits, n):
    rng = np.random.default_rng(bits + n)
    prints = rng.integers(0, 1 << min(bits, 62), n, dtype=np.uint64)
    if n > 3:
        prints[: n // 2] = prints[rng.integers(0, 4, n // 2)]  # a few with many copies
        prints[-2:] = 0, (1 << bits) - 1
    blob = copies.pack(*copies.summed(prints, np.ones(n, np.int64)), bits)
    got = copies.unpack(blob)
    assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == Counter(prints.tolist())
    assert (np.diff(got[0].astype(object)) > 0).all()


def test_filters_stay_near_their_load_and_crowded_homes_move_on():
    prints = np.arange(1000, dtype=np.uint64)  # one quotient for all
    blob = copies.pack(prints, np.ones(1000, np.int64), 64)
    assert (copies.unpack(blob)[0] == prints).all()
    spread = np.sort(np.random.default_rng(1).integers(0, (1 << 64) - 1, 3800, dtype=np.uint64))
    assert len(copies.pack(spread, np.ones(3800, np.int64), 64)) < 8 * 4200


def test_merged_filters_are_the_filter_of_all():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 500, k, dtype=np.uint64) << np.uint64(50) for k in (0, 1, 700, 90)]
    blobs = [copies.pack(*copies.summed(p, np.ones(len(p), np.int64)), 60) for p in parts]
    merged = copies.merge(blobs, 60)
    assert merged == copies.pack(*copies.summed(np.concatenate(parts), np.ones(791, np.int64)), 60)


def plain_copies(rows):
    """Counter of (id, keep, size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate({c: c + 32 for c in range(65, 91)})].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, stays = hashlib.sha256(t.encode()).hexdigest(), ids.index(keep)
        out.update((i, keep, len(ids), k == stays, sha) for k, i in enumerate(ids))
    return out


def test_exact_copies_are_grouped_and_one_stays(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [(900 + k, ["Same Text", "same text", "SAME texT", "ſame text", "SÄME", "säme"][k % 6]) for k in range(60)]
    rows += [(7, "twice"), (7, "twice"), (None, "nobody's"), (None, "Nobody's"), (None, None), (3, ""), (5000, "x" * 200_000), (5001, "X" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(map(tuple, copies.copy_groups(docs).collect())) == plain_copies(rows)


def test_exact_copies_with_one_hot_group_and_clashing_columns(spark):
    rows = [(k, "hot" if k % 3 else f"text {k}", k, "a", b"z") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print long, sha string, filter binary").repartition(9)
    got = copies.copy_groups(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_copies([r[:2] for r in rows])


def test_colliding_fingerprints_are_told_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(copies.xxhash, "xxh3_64_intdigest", lambda b: len(b) << 60)
    rows = [(k, ("a", "B", "bb", "b", "A", "cc")[k % 6]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert Counter(map(tuple, copies.copy_groups(docs).collect())) == plain_copies(rows)


def test_exact_copies_of_an_empty_table(spark):
    assert copies.copy_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_may_be_strings(spark):
    rows = [("b", "T"), ("a", "t"), (None, "t")]
    assert Counter(map(tuple, copies.copy_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect())) == plain_copies(rows)


# --- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{(id, label, code, error)}, codebooks: by looking at every entry."""
    vectors = [(i, label, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    vectors.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(vectors[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in vectors]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for c in cut:
                met[near(c[p], books[p])[1]].append(c[p])
            for k, xs in met.items():
                books[p][k] = [sum(x[j] for x in xs) // len(xs) for j in range(width)]
    out = Counter()
    for (i, label, _), c in zip(vectors, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        out[(i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))] += 1
    return out, books


def vectors(n, seed=5, dims=8):
    rng = random.Random(seed)
    base = [[rng.choice((-0.5, 0.25, 0.0, 0.3, rng.gauss(0, 1))) for _ in range(dims)] for _ in range(n)]
    rows = [(k, v, k % 3 if k % 7 else None) for k, v in enumerate(base)]
    hot = base[1]
    rows += [(1000 + k, hot, 1) for k in range(n // 2)]
    rows += [(5, base[5], 2), (None, base[6], 2), (2000, None, 1), (2001, [float("nan")] + [0.0] * (dims - 1), 1), (2002, [float("inf")] * dims, 1), (2003, [None] + [0.1] * (dims - 1), 1)]
    return rows


@pytest.mark.parametrize("entries", [1, 7, 40])
def test_codes_are_those_of_a_search_through_all_entries(spark, entries):
    rows = vectors(120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = codebooks.compress(df, keep=("label",), entries=entries)
    want, books = plain_codes(rows, entries=entries)
    assert Counter((r["vec_id"], r["label"], r["code"].hex(), r["error"]) for r in got.rows.collect()) == want
    assert got.codebooks.tolist() == books
    row = got.rows.filter("vec_id = 11").first()
    assert len(got.decoded(row["code"])) == 8
    assert sum((a - int(np.floor(1024 * b))) ** 2 for a, b in zip(got.decoded(row["code"]).tolist(), rows[11][1], strict=True)) == row["error"]


@pytest.mark.parametrize("seed", range(4))
def test_tree_visits_equal_bounds(seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-3, 4, (100, 3))
    book[50:60] = book[3]  # equal entries: the lowest index wins
    x = rng.integers(-4, 5, (2000, 3))
    far = ((x[:, None] - book) ** 2).sum(2)
    index, best = codebooks.Tree(book).nearest(x)
    assert (index == far.argmin(1)).all()
    assert (best == far.min(1)).all()


def test_over_256_entries_take_two_bytes(spark):
    rows = [(k, [float(k), float(-k)], 0) for k in range(400)]
    got = codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=2, entries=300, rounds=1)
    assert {len(r["code"]) for r in got.rows.collect()} == {4}


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 0), (2, [], 0), (3, [1.0, 2.0, 3.0], 0), (4, [1.0] * 8, 0), (5, [1e300, 0.0, 0.0, 0.0], 0), (6, [0.5, 2.0, 3.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(r["vec_id"] for r in codebooks.compress(df).rows.collect()) == [1, 6]
    none = codebooks.compress(df.filter("vec_id = 2"))
    assert none.rows.count() == 0
    assert none.codebooks.size == 0


def test_op12_query_digests_the_codebooks(spark, tmp_path):
    rows = vectors(300)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, books = plain_codes(rows)
    by_label = Counter()
    for (_, label, _, error), n in want.items():
        by_label[label] += error * n
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    expected = Counter()
    for (i, label, code, error), n in want.items():
        expected[(i, code, error, by_label[label], digest)] += n
    assert Counter(map(tuple, queries.op12_vector_codes(spark, str(tmp_path)).collect())) == expected


# --- periodic runs


def plain_runs(words):
    """Every run, by trying every period at every place."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((i, length, q) for (i, length), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_short_texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            kinds, n = rng.choice((1, 2, 3, 6)), rng.randint(0, 70)
            x = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            texts.append(x)
        assert tandem.word_runs(texts) == [plain_runs(x) for x in texts]


def test_runs_are_found_whatever_the_lot(monkeypatch):
    rng = random.Random(9)
    texts = [[rng.randrange(2) for _ in range(200)] for _ in range(20)] + [["w"] * 5000, list("ab" * 900) + ["c"] * 700]
    want = tandem.word_runs(texts)
    monkeypatch.setattr(tandem, "LOT", 400)
    monkeypatch.setattr(tandem, "LEAVES", 50)
    assert tandem.word_runs(texts) == want
    assert want[-2] == [(0, 5000, 1)]
    assert want[-1] == [(0, 1800, 2), (1800, 700, 1)]


def test_op13_query_digests_all_runs(spark, tmp_path):
    rows = odd_rows()
    rows += [(2000 + k, " ".join(random.Random(k).choice("abcdefg") for _ in range(300)), "en", "s1", 1, *rows[0][5:]) for k in range(80)]
    rows += [(3000, "ab c d " * 9 + "\x0b\x0c\r\n" + "tail " * 7, "en", "s1", 1, *rows[0][5:]), (None, "x " * 50, "en", "s1", 1, *rows[0][5:])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for r in rows:
        words = planted(r[0], r[1])
        runs = plain_runs(words)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        text = b" ".join(w for k, w in enumerate(words) if k not in gone)
        told = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        want[(r[0], len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest())] += 1
    got = queries.op13_tandem_runs(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == want
    assert sum(r["n_runs"] > 0 for r in got) > 5


def test_runs_of_an_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, runs int, collapsed string, id string")
    assert tandem.periodic_runs(none).count() == 0
    one = spark.createDataFrame([(1, "a " * 6, 3, "z", "y")], none.schema)
    assert [tuple(map(str, r)) for r in tandem.periodic_runs(one).collect()] == [("1", "[Row(start=0, length=6, period=1)]", "a")]
