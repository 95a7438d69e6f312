"""Each operator against a plain version on small tables, and on the odd rows that any table may hold."""

from __future__ import annotations

import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, packing, pseudonyms, repeats, sharding, simhash, telephony, topk, toxicity
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, codec string, score double, kinds string, n_lines int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def odd_rows():
    rng = random.Random(5)
    body = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = body(40)
    rows = [(1, None, "s1"), (2, "", "s1"), (3, "   \n\t", None), (4, "one", "s2"), (5, "Ünï ßtraße naïve 😀 \x00 tail", "s2"), (None, body(30), "s1"), (7, body(30000), None)]
    rows += [(10 + k, shared + "\n" + body(60), f"s{k % 7}") for k in range(12)]
    rows += [(30, rows[8][1], "s3"), (31, rows[8][1], "s3"), (31, rows[8][1], "s3"), (32, rows[9][1] + " more", "s4")]
    rows += [(40 + k, body(rng.randint(1, 200)), f"s{rng.randint(0, 4)}") for k in range(40)]
    return [(i, t, None if i == 4 else "en", s, None if t is None else len(t), 7, "x", 0.5, "y", 3) for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- telephony ---------------------------------------------------------------------------------


def test_companding_tables_match_the_standard_segments():
    mu, a = telephony.mu_law_table(), telephony.a_law_table()
    assert [int(x) for x in mu[[0x00, 0x80, 0x7F, 0xFF]]] == [-32124, 32124, 0, 0]
    assert [int(x) for x in a[[0x55, 0xD5, 0x2A, 0xAA]]] == [-8, 8, -32256, 32256]
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_adpcm_blocks_decode_as_one_by_one():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (9, 40), dtype=np.uint8)
    blocks[:, 2] %= 89
    got = telephony.decode_adpcm(blocks).reshape(9, -1)
    for b, out in zip(blocks, got, strict=True):
        value, index = struct.unpack("<h", b[:2].tobytes())[0], int(b[2])
        want = [value]
        for byte in b[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = telephony.STEPS[index]
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + telephony.INDEX_MOVES[code]))
                want.append(value)
        assert out.tolist() == want


@pytest.mark.parametrize("codec", [telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM])
def test_stored_payload_is_read_back(codec):
    payload = os.urandom(192 * 5)
    c, rate, align, data = telephony.parse(telephony.store(payload, codec))
    assert (c, rate) == (codec, 8000) and telephony.payload_of(c, align, data) == payload


def test_resampling_keeps_a_tone():
    tone = lambda rate: 9000 * np.sin(2 * np.pi * 300 * np.arange(rate) / rate)
    for to in (16000, 11025, 6000):
        got = telephony.resample(tone(8000).astype(np.int16), 8000, to)
        assert len(got) == to and np.abs(got[200:-200] - tone(to)[200:-200]).max() < 120


def test_decode_gives_nulls_for_what_is_no_file(spark):
    rows = [(1, None), (2, b""), (3, b"RIFF"), (4, telephony.store(b"ab", telephony.MU_LAW)), (5, telephony.store(b"", telephony.A_LAW))]
    got = {r["k"]: r for r in telephony.decode(spark.createDataFrame(rows, "k int, media binary")).collect()}
    assert all(got[k]["pcm"] is None and got[k]["codec"] is None for k in (1, 2, 3))
    assert bytes(got[4]["payload"]) == b"ab" and len(got[4]["pcm"]) == 8 and bytes(got[5]["pcm"]) == b""


# --- packing -----------------------------------------------------------------------------------


def test_plan_packs_exactly_the_counts():
    rng = random.Random(1)
    for counts in (Counter(rng.randint(1, 64) for _ in range(500)), Counter({64: 7}), Counter({40: 100, 24: 90, 10: 3}), Counter({1: 1000}), Counter()):
        fillings = packing.plan(counts, 64)
        got = Counter()
        for filling, n in fillings:
            assert sum(filling) <= 64 and n > 0
            for x in filling:
                got[x] += n
        assert got == counts
        used = sum(n for _, n in fillings)
        best = sum(n for _, n in packing.best_fit(dict(counts), 64))
        assert used <= best * 1.01 + 1


def test_documents_are_packed_whole(spark, docs):
    from tokenizers import Tokenizer

    got = packing.pack_documents(docs, tokenizer_path(), max_length=256).collect()
    encode = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, *_ in odd_rows():
        ids = np.array(encode.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 256 or min(len(ids), 256)
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        want.update((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for runs in places.values():
        end = 0
        for offset, length in sorted(runs):
            assert offset == end
            end += length
        assert end <= 256
    assert len(places) <= -(-sum(r["length"] for r in got) // 256) * 1.1 + 1


def test_packing_nothing_gives_nothing(empty):
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_kept_ids_are_the_digested_ones(docs):
    for r in packing.pieces(docs.limit(20), tokenizer_path(), keep_ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


# --- lines -------------------------------------------------------------------------------------


def plain_shared_lines(rows, least):
    sites, keeper = defaultdict(set), {}
    for i, t, s in rows:
        for x in set((t or "").split("\n")):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
                if i is not None and (x.strip(" ") not in keeper or i < keeper[x.strip(" ")]):
                    keeper[x.strip(" ")] = i
    bad = lambda i, x: x.strip(" ") and len(sites[x.strip(" ")]) >= least and keeper.get(x.strip(" ")) != i
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if not bad(i, x))) for i, t, s in rows)


def test_shared_lines_go_from_all_but_the_first(docs, empty):
    rows = [(i, t, s) for i, t, _, s, *_ in odd_rows()]
    for least in (2, 4, 6):
        got = lines.drop_shared_lines(docs, min_sites=least)
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == plain_shared_lines(rows, least)
    assert lines.drop_shared_lines(empty).count() == 0


# --- top-k -------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(40)]) for k in range(300)]
    rows += [(300, None), (301, [None] * 40), (302, [float("nan")] * 40), (303, [float("inf")] + [0.0] * 39), (304, [1.0, 2.0]), (350, [0.5, 0.5]), (None, [1.0] * 40), (12, rows[12][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", topk.quantized(F.col("embedding")))
    good = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for k, q in good:
        if k % 50 == 0:
            scores = sorted((-int(q @ v), j) for j, v in good if j != k and len(v) == len(q))[:5]
            want |= {(k, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    for block in (8192, 3):
        got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, block=block)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert topk.top_k(df.limit(0), df, 5).count() == 0


# --- repeats -----------------------------------------------------------------------------------


def test_suffix_columns_sort_all_suffixes():
    rng = random.Random(3)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        owner, length, prefix = repeats.suffix_columns(strings)
        want = sorted((strings[i][len(strings[i]) - r :], i) for i in range(len(strings)) for r in range(1, len(strings[i]) + 1))
        got = [(strings[i][len(strings[i]) - r :], i) for i, r in zip(owner, length, strict=True)]
        assert got == want
        assert all(len(os.path.commonprefix([got[k][0], got[k - 1][0]])) == prefix[k] for k in range(1, len(got)))


def plain_repeats(rows, window):
    first = {}
    rank = lambda i: (1 << 63) if i is None else i
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(texts, key=lambda x: rank(x[0])):
        for p in range(len(b) - window + 1):
            first.setdefault(b[p : p + window], rank(i))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < rank(i):
                gone[p : p + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        out[(i, len(b), tuple(map(tuple, edges.tolist())), bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    return out


@pytest.mark.parametrize("window", [50, 20])
def test_repeats_go_from_later_documents(spark, docs, empty, window):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    got = repeats.drop_repeats(docs, window=window).collect()
    assert Counter((r["doc_id"], r["n_bytes"], tuple((s["from"], s["to"]) for s in r["spans"]), bytes(r["kept"])) for r in got) == plain_repeats(rows, window)
    if window == 50:
        assert repeats.drop_repeats(empty).count() == 0


def test_periodic_texts_repeat_too(spark):
    rows = [(1, "ab" * 100), (2, "x" + "ab" * 70 + "y"), (3, "z" * 120), (4, "z" * 49), (5, "z" * 51 + "q")]
    got = repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_bytes"], tuple((s["from"], s["to"]) for s in r["spans"]), bytes(r["kept"])) for r in got) == plain_repeats(rows, 50)


# --- sharding ----------------------------------------------------------------------------------


def test_matrix_has_exact_sums():
    rng = random.Random(4)
    for _ in range(20):
        cells = [rng.randint(0, 60) for _ in range(rng.randint(1, 12))]
        total = sum(cells)
        sizes = [total // 7 + (k < total % 7) for k in range(7)]
        m = sharding.communication_matrix(cells, sizes, 9)
        assert [sum(r) for r in m] == cells and [sum(c) for c in zip(*m, strict=True)] == sizes


def test_hypergeometric_draws_follow_the_law():
    from math import comb

    rng, n = random.Random(6), 20000
    got = Counter(sharding.draw_hypergeometric(rng, 10, 20, 8) for _ in range(n))
    chi = sum((got[k] - n * p) ** 2 / (n * p) for k in range(9) if (p := comb(10, k) * comb(20, 8 - k) / comb(30, 8)) * n > 5)
    assert chi < 35


def test_shards_are_even_and_slots_gapless(docs, empty):
    got = sharding.shuffle_into_shards(docs.select("doc_id", "text", "slot"), ["doc_id", "text"], 5, cell_rows=8).collect()
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    sizes = [len(per[k]) for k in range(5)]
    assert sum(sizes) == len(odd_rows()) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    again = sharding.shuffle_into_shards(docs.repartition(3).select("doc_id", "text"), ["doc_id", "text"], 5, cell_rows=8).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"] != 31) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again if r["doc_id"] != 31)
    assert sharding.shuffle_into_shards(empty, ["doc_id"], 24).count() == 0


# --- toxicity ----------------------------------------------------------------------------------


def test_obfuscated_words_are_read(spark):
    corpus = spark.createDataFrame([(" ".join(["you idiot", "a moron and a clown", "worthless scum", "stupid", "the market is open"] * 40),)], "text string")
    grams = {r[0]: r[1] for r in toxicity.char_counts(corpus).collect()}
    r = toxicity.Restorer(toxicity.CharModel(grams))
    for said, meant in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("m0r0n", "moron"), ("s.c.u.m", "scum"), ("stuuupid", "stupid"), ("cl0wn!", "clown!"), ("w0rthl3ss", "worthless")):
        assert r.restore(f"you {said} there") == f"you {meant} there"
    for plain in ("The market is open.", "", "A (b), c; d?", "well-known book"):
        assert r.restore(plain) == plain.lower()


def test_scores_are_learned_from_labels(spark, docs, empty):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        words = [rng.choice(WORDS) for _ in range(30)] + (["scumbag"] if bad else [])
        if bad and k % 10 == 0:
            words[-1] = "5cumb4g"
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    train = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, train.filter("doc_id < 400"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert sum((got[k] >= 0.5) == bool(y) for k, y in labels if k >= 400) >= 196
    odd = toxicity.score(docs, model)
    assert odd.columns.count("score") == 1 and odd.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, train.limit(0))).count() == 0
    alone = toxicity.fit(df, train.filter("toxic = 0"))
    assert alone["words"] == {} and toxicity.deobfuscated(docs, model["grams"]).count() == len(odd_rows())


# --- pseudonyms --------------------------------------------------------------------------------


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


VALUES = {
    "card": ["4929348385146306", "4539 1488 0343 6467", "378282246310005"],
    "phone": ["+1 (499) 555-6503", "(212) 555-0147", "212-555-0147"],
    "ssn": ["123-45-6789", "899-01-0001"],
    "ip": ["97.51.17.173", "255.0.0.1"],
    "isodate": ["2024-02-29", "1999-12-31"],
    "date": ["31/12/1999", "05.06.2020"],
    "email": ["und.34@mail7.example.com", "A.b-C@x.org"],
    "iban": ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
}
INVALID = ["4929348385146307", "666-12-3456", "999.1.1.1", "2023-02-30", "GB82WEST12345698765433", "12345678901234567890123"]


def test_pseudonyms_keep_format_validity_and_links(spark, docs, empty):
    values = [(k, v) for k, vs in VALUES.items() for v in vs]
    df = spark.createDataFrame([(v, f"at {v}, and {v} end.") for _, v in values], "v string, text string")
    made = pseudonyms.pseudonymize(df, "k1").collect()
    for (kind, v), r in zip(values, sorted(made, key=lambda r: [x for _, x in values].index(r["v"])), strict=True):
        a, b = re.fullmatch(r"at (.*), and (.*) end\.", r["text"]).groups()
        assert a == b and a != v and r["kinds"] == [kind, kind], (v, r)
        shape = lambda s: re.sub("[0-9]", "9", s) if kind not in ("email", "secret", "ip") else len(s) if kind != "ip" else s.count(".")
        assert shape(a) == shape(v) or kind == "ip"
        if kind == "card":
            assert luhn(re.sub(r"\D", "", a))
        if kind == "iban":
            assert iban_ok(a)
        if kind == "isodate":
            date.fromisoformat(a)
    back = pseudonyms.pseudonymize(spark.createDataFrame(made).select("v", "text"), "k1", undo=True).collect()
    for r in back:
        assert r["text"].lower() == f"at {r['v']}, and {r['v']} end.".lower()
    other = {r["v"]: r["text"] for r in pseudonyms.pseudonymize(df, "k2").collect()}
    assert all(other[r["v"]] != r["text"] for r in made)
    kept = pseudonyms.pseudonymize(spark.createDataFrame([(f"see {v} now",) for v in INVALID], "text string"), "k1").collect()
    assert [r["text"] for r in kept] == [f"see {v} now" for v in INVALID] and all(r["kinds"] == [] for r in kept)
    odd = pseudonyms.pseudonymize(docs, "k1").select("text").collect()
    assert Counter(r["text"] for r in odd) == Counter(t for _, t, *_ in odd_rows())
    assert pseudonyms.pseudonymize(empty, "k1").count() == 0


def test_pseudonyms_are_one_to_one(spark):
    df = spark.range(2000).select(F.concat(F.lit("on "), F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string")).alias("text"))
    assert pseudonyms.pseudonymize(df, "k").select("text").distinct().count() == 2000


# --- simhash -----------------------------------------------------------------------------------


def plain_fingerprint(t, n=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    grams = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_are_as_defined(monkeypatch):
    for _, t, *_ in odd_rows():
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    monkeypatch.setattr(simhash, "LONG", 10)
    assert simhash.fingerprint(odd_rows()[10][1]) == plain_fingerprint(odd_rows()[10][1])


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_links_connect_what_differs_in_four_bits(spark):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = set(seeds)
    for s in seeds[:15]:
        for _ in range(12):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    want = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in got)
    assert roots(signed, [(r["a"], r["b"]) for r in got]) == roots(signed, want)


def test_near_duplicates_have_the_least_reachable_id(docs, empty):
    rows = odd_rows()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    n = len(rows)
    group = roots(range(n), [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = defaultdict(list)
    for k in range(n):
        if rows[k][0] is not None:
            least[group[k]].append(rows[k][0])
    want = Counter((rows[k][0], fps[k], min(least[group[k]], default=None)) for k in range(n))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


# --- mixing ------------------------------------------------------------------------------------


def test_mix_meets_its_targets(docs, empty):
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, _, s, *_ in odd_rows()]
    size = Counter()
    for _, n, s in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target = 1.5 * sum(size.values()), {}
    open_ = set(order)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * size[s] < level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    got = mixing.mix(docs, "doc_id").collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter(rows)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["copies"] <= 2 and abs(r["copies"] - r["target"] / max(r["source_size"], 1)) < 1 or r["source_size"] == 0
        taken[r["source"]] += r["copies"] * r["size"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max((n for _, n, x in rows if x == s), default=0) + 0.1 * target[s]
    again = mixing.mix(docs.repartition(7), "doc_id").collect()
    assert Counter((r["doc_id"], r["copies"]) for r in got) == Counter((r["doc_id"], r["copies"]) for r in again)
    assert mixing.mix(empty, "doc_id").count() == 0


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against a plain version on its own input."""
    import corpus_pipeline as pipeline

    rng = random.Random(11)
    body = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))
    rows = []
    for k in range(150):
        t = body(rng.randint(20, 120))
        t += " vilescum word" if k % 6 == 0 else ""
        t += "\nshared by all sites" if k % 3 == 0 else ""
        rows.append((k, t, "en", f"s{k % 6}", len(t)))
    rows += [(200, rows[1][1], "en", "s0", 1), (201, rows[2][1] + " x", "en", "s1", 1), (202, None, None, None, None), (203, "", "en", "s1", 0)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("score", "n_lines", "size", "copies", "target")})  # names that operators use
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    columns, kept = now.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, folder)
        assert k == 4 or out.columns == columns
        kept.append([tuple(r) for r in out.collect()])
        assert k == 4 or {r[5:] for r in kept[-1]} == {("own score", "own n_lines", "own size", "own copies", "own target")}
        now = spark.createDataFrame(kept[-1], out.schema)
    clean = {r[0] for r in rows if "vilescum" not in (r[1] or "")}
    assert {r[0] for r in kept[0]} == clean
    assert Counter((r[0], r[1]) for r in kept[1]) == plain_shared_lines([(r[0], r[1], r[3]) for r in kept[0]], 5)
    assert all(r[4] == len(r[1]) for r in kept[1] if r[1] and r[0] % 3 == 0 and r[0] < 150)
    sets = {r[0]: set(simhash.shingle_set(r[1]).tolist()) for r in kept[1]}
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    group = roots(sorted(sets), [(a, b) for a in sets for b in sets if b < a and near(sets[a], sets[b])])
    assert sorted(r[0] for r in kept[2]) == sorted(set(group.values()))
    before = {r[0]: r for r in kept[2]}
    assert all(r == before[r[0]] for r in kept[3]) and max(Counter(r[0] for r in kept[3]).values()) <= 2
    words = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    assert abs(words(kept[3]) - 1.5 * words(kept[2])) < 0.1 * words(kept[2])
    assert Counter(r[0] for r in kept[3]) == Counter(r[0] for r in kept[4] if r[1] == 0)
    assert {hashlib.sha256(str(r[:5]).encode()).hexdigest() for r in kept[4]}
    assert len(pipeline.run(spark, folder).collect()) == len(kept[4])


def test_long_runs_connect_the_same(monkeypatch):
    from tidemark.llm import simhash

    def components(pairs, nodes):
        root = {int(x): int(x) for x in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(*(side.tolist() for side in pairs), strict=True):
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
            root[find(a)] = find(b)
        return {frozenset(y for y in root if find(y) == find(x)) for x in root}

    rng = np.random.default_rng(3)
    near = [int(x) ^ (1 << int(rng.integers(43))) for x in rng.integers(0, 2**43, 40) for _ in range(4)]
    fp = np.unique(np.array([*near, *rng.integers(0, 2**43, 400), *range(64)], np.int64))
    monkeypatch.setattr(simhash, "DENSE", 16)
    assert components(simhash.split_forest(fp), fp) == components(simhash.forest(fp), fp)


def test_near_copies_of_similarity_eight_tenths_are_found(spark, monkeypatch):
    from tidemark.llm import simhash

    rng = random.Random(21)
    rows = []
    for k in range(40):
        words = [str(rng.randint(0, 10**6)) for _ in range(rng.randint(100, 300))]
        rows.append(" ".join(words))
        for _ in range(12 if k == 0 else 2):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randint(0, 4)):
                copy[at] = "new" + str(rng.randint(0, 10**6))
            rows.append(" ".join(copy))
    rows += ["too short", "too  short", "", None]
    sets = [set(simhash.shingle_set(t).tolist()) for t in rows]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if near(sets[a], sets[b])]
    far = [(a, b) for a, b in pairs if (simhash.fingerprint(rows[a]) ^ simhash.fingerprint(rows[b])).bit_count() > 4]
    want = roots(range(len(rows)), pairs)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert len(far) > 20
    for few in (4, 1):
        monkeypatch.setattr(simhash, "FEW", few)
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()} == want
    assert simhash.near_copies(df.filter("false")).count() == 0


def test_pipeline_drops_near_copies_beyond_four_bits(spark):
    import corpus_pipeline as pipeline
    from tidemark.llm import simhash

    words = [f"w{k}" for k in range(150)]
    changed = [" ".join([*words[:k], "new", *words[k + 1 :]]) for k in range(5, 145)]
    text = " ".join(words)
    far = [t for t in changed if (simhash.fingerprint(t) ^ simhash.fingerprint(text)).bit_count() > 4]
    df = spark.createDataFrame([(1, text), (2, far[0]), (3, "something else that is no copy of it")], "doc_id long, text string")
    assert sorted(r[0] for r in pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3]


def test_signs_at_the_end_and_spaced_signs_are_read(spark):
    corpus = spark.createDataFrame([(" ".join(["you idiot", "an ass", "a moron and a clown", "what shit", "the market is open"] * 40),)], "text string")
    grams = {r[0]: r[1] for r in toxicity.char_counts(corpus).collect()}
    r = toxicity.Restorer(toxicity.CharModel(grams))
    for said, meant in (("a$$", "ass"), ("idi07", "idiot"), ("shi7", "shit"), ("i d 1 0 t", "idiot"), ("1 d i o t", "idiot"), ("m 0 r 0 n", "moron")):
        assert r.restore(f"you {said} there") == f"you {meant} there"
    for plain in ("costs 1 2 3 4 5 in all", "in 1998 and 2 of 10", "open! 5 - 7 only"):
        assert r.restore(plain) == plain
