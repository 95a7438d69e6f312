"""The registered queries on a small documents table against plain versions, columns of any name, and long hostile texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, odd_rows, plain_fingerprint, roots

from tidemark.llm import lines, mixing, packing, pseudonyms, queries, repeats, sharding, simhash, telephony, topk, toxicity
from tidemark.llm.common import running

EXTRA = [(60, "before <|endoftext|> after", "en", "s1", 1, 7, "x", 0.5, "y", 3), (61, "<|endoftext|>", "en", "s2", 1, 7, "x", 0.5, "y", 3), (62, "a" * 101_000 + " tail \u2028\u00a0 \U0001f600\u0301 ١٢٣", "en", "s2", 1, 7, "x", 0.5, "y", 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(odd_rows() + EXTRA, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(40, 80)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows():
    return [(r[0], r[1] or "", r[3]) for r in odd_rows() + EXTRA]


def test_op1_query_digests_what_is_stored(spark, folder):
    want = Counter()
    for i, t, _ in rows():
        raw = t.encode()
        p = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        codec = (telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM)[zlib.crc32(p) % 3]
        media = telephony.store(p, codec)
        pcm = telephony.expand([telephony.parse(media)], 16000)[0]
        wav = telephony.pcm_file(pcm, 16000)
        feature = f"{telephony.CODEC_NAMES[codec]}:16000:{telephony.features(pcm)}"
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(wav), hashlib.sha256(wav).hexdigest())] += 1
    assert Counter(map(tuple, queries.op1_telephony(spark, folder).collect())) == want


def test_op2_query_has_the_library_s_ids_at_1024(spark, folder):
    from tokenizers import Tokenizer

    encode, want = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    assert encode.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    for i, t, _ in rows():
        ids = np.array(encode.encode(t, add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want.update((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    got = queries.op2_configuration_packing(spark, folder).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for runs in places.values():
        runs.sort()
        assert [o for o, _ in runs] == [sum(n for _, n in runs[:k]) for k in range(len(runs))] and sum(n for _, n in runs) <= 1024


def test_op5_and_op9_queries_have_their_columns(spark, folder):
    texts = rows()
    got = queries.op9_simhash_variants(spark, folder).collect()
    fps = {(i, t): plain_fingerprint(t) for i, t, _ in texts}
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{fps[i, t]:016x}") for i, t, _ in texts)
    seen = defaultdict(list)
    for i, t, _ in texts:
        for k in range(max(0, len(t.encode()) - 49)):
            seen[t.encode()[k : k + 50]].append(float("inf") if i is None else i)
    least = {w: min(ids) for w, ids in seen.items()}
    want = Counter()
    for i, t, _ in texts:
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for k in range(max(0, len(raw) - 49)):
            if least[raw[k : k + 50]] < (float("inf") if i is None else i):
                gone[k : k + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        want[(i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op5_column_suffixes(spark, folder).collect()) == want


def test_op6_and_op7_queries_have_their_columns(spark, folder):
    got = queries.op6_hypergeometric_shards(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", None) for i, t, _ in rows())
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    tox = queries.op7_deobfuscated_toxicity(spark, folder).collect()
    assert Counter(r["doc_id"] for r in tox) == Counter(i for i, _, _ in rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in tox)


def _feistel_plain(left, right, a, b, key, kind, extra, undo=False):
    mix = lambda i, x: int(hashlib.sha256("|".join([key, kind, str(extra), str(i), str(x)]).encode()).hexdigest()[:13], 16)
    for i in range(1, 9):
        if i % 2:
            left = (left + mix(i, right) % a) % a
        else:
            right = (right + mix(i, left) % b) % b
    return left, right


def test_op8_rows_are_those_of_a_plain_network(spark):
    digits = ["4111111111111111", "5500005555555559", "340000000000009"]
    said = [f"card {c} on 2020-02-{k + 3:02d} at 10.0.{k}.7, id 123-45-678{k}" for k, c in enumerate(digits)]

    def plain(c, k):
        body = c[:-1]
        n, u = len(body), len(body) // 2
        left, right = _feistel_plain(int(body[:u]), int(body[u:]), 10**u, 10 ** (n - u), "k", "card", f"{n},0")
        new = f"{left:0{u}d}{right:0{n - u}d}"
        total = sum(sum(divmod(int(x) * 2, 10)) if j % 2 == 0 else int(x) for j, x in enumerate(reversed(new)))
        card = new + str(-total % 10)
        from datetime import date, timedelta

        days = (date(2020, 2, k + 3) - date(1900, 1, 1)).days
        block, within = divmod(days, 73000)
        left, right = _feistel_plain(within // 100, within % 100, 730, 100, "k", "date", block)
        day = date(1900, 1, 1) + timedelta(block * 73000 + left * 100 + right)
        left, right = _feistel_plain(10 * 256, k * 256 + 7, 65536, 65536, "k", "ip", "")
        ip = f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"
        left, right = _feistel_plain(122 * 99 + 44, 6780 + k - 1, 898 * 99, 9999, "k", "ssn", "")
        area = left // 99 + (2 if left // 99 >= 665 else 1)
        return f"card {card} on {day} at {ip}, id {area:03d}-{left % 99 + 1:02d}-{right + 1:04d}"

    got = pseudonyms.pseudonymize(spark.createDataFrame(list(enumerate(said)), "doc_id int, text string"), "k").collect()
    assert {r["doc_id"]: r["text"] for r in got} == {k: plain(c, k) for k, c in enumerate(digits)}
    assert all(r["kinds"] == ["card", "isodate", "ip", "ssn"] for r in got)


@pytest.mark.parametrize("kind", ["x@" + "a." * 300_000 + "com", "1" * 1_000_000, "a@" * 400_000, "a" * 1_000_000 + "@b.c", "1234 " * 200_000])
def test_long_hostile_texts_pass(spark, kind):
    r = pseudonyms.pseudonymize(spark.createDataFrame([(kind,)], "text string"), "k").select(F.length("text")).first()
    assert r[0] == len(kind)


def test_mail_addresses_are_one_whatever_their_case(spark):
    df = spark.createDataFrame([("John@x.pt john@x.pt",)], "text string")
    a, b = pseudonyms.pseudonymize(df, "k").first()["text"].split()
    assert a == b and pseudonyms.pseudonymize(pseudonyms.pseudonymize(df, "k"), "k", undo=True).first()["text"] == "john@x.pt john@x.pt"


#: Names that the operators use inside, as columns of the user's own.
INNER = "_key _site _bad _kept _doc _line _n _one _text _head _class _tag _rank _copy _source _before _cell _first _second _ends _block _salt _order _number _found _part _h _y word bucket class tag sub rest upto base".split()


@pytest.fixture(scope="module")
def named(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).select("doc_id", "text", "source").filter("doc_id <> 7")
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in INNER})


def _own(rows_):
    for r in rows_:
        assert all(r[c] == f"{c} of {r['doc_id']}" for c in INNER)
    return len(rows_)


def test_columns_of_any_name_pass_unchanged(spark, named):
    n = named.count()
    assert _own(lines.drop_shared_lines(named).collect()) == n
    assert _own(mixing.mix(named, "doc_id", keep=tuple(INNER)).collect()) == n
    assert _own(sharding.shuffle_into_shards(named, ["doc_id", "text"], 3).collect()) == n
    assert _own(pseudonyms.pseudonymize(named, "k").collect()) == n
    assert _own(toxicity.score(named, {"grams": {}, "words": {}, "weights": [0.0] * 9}).collect()) == n
    parts = named.withColumns({"piece": F.lit(0), "length": F.lit(5)})
    assert _own(packing.pack(parts, "doc_id", 16).collect()) == n
    media = named.withColumn("media", F.lit(telephony.store(b"ab", telephony.MU_LAW)))
    assert _own(telephony.decode(media).collect()) == n
    assert simhash.near_duplicates(named).count() == simhash.near_copies(named).count() == repeats.drop_repeats(named).count() == n
    with pytest.raises(ValueError, match="copies"):
        mixing.mix(named.withColumn("copies", F.lit(1)), "doc_id", keep=("copies",))


def test_pipeline_stages_keep_columns_of_any_name(spark, named, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(40, 80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, named, str(tmp_path))
        assert out.columns == named.columns and _own(out.collect()) > 0


def test_one_id_with_two_texts_keeps_both(spark):
    import corpus_pipeline as pipeline

    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (1, a), (None, "no id here"), (None, "no id here")], "doc_id long, text string")
    assert Counter(map(tuple, pipeline.drop_near_copies(spark, df, "").collect())) == Counter([(1, a), (1, b), (None, "no id here")])


@pytest.mark.parametrize("window", [20, 133, 134, 150])
def test_repeats_of_any_window_are_removed(spark, window):
    rng = random.Random(window)
    body = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = body(400)
    texts = [body(100) + shared + body(50), shared[30:380] + body(80), body(60) + shared[200:] + shared[:150], body(300)]
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - window + 1):
            seen.setdefault(t[k : k + window], i)
    want = {}
    for i, t in enumerate(texts):
        gone = [False] * len(t)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] < i:
                gone[k : k + window] = [True] * window
        want[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in repeats.drop_repeats(df, window=window).collect()} == want


def test_many_lost_lines_of_one_document_go(spark):
    shared = [f"line number {k}" for k in range(3000)]
    rows_ = [(s, "\n".join(shared), f"s{s}") for s in range(5)] + [(9, "\n".join(x for k in range(3000) for x in (shared[k], f"own {k}")), "s0")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_shared_lines(spark.createDataFrame(rows_, "doc_id long, text string, source string")).collect()}
    assert got[0] == "\n".join(shared) and got[1] == "" and got[9] == "\n".join(f"own {k}" for k in range(3000))


def test_running_sums_need_no_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(1).alias("_part"))
    got = {r["x"]: (r["s"], r["_part"]) for r in running(df, [F.col("x")], {"s": F.col("x")}, "running").collect()}
    assert got == {x: (x * (x + 1) // 2, 1) for x in range(1000)}


def test_hypergeometric_probabilities_hold_at_any_size():
    from math import comb

    for good, bad, drawn in ((7, 5, 6), (300, 500, 200), (40, 4000, 1000)):
        p, q = drawn / (good + bad), (good + bad - drawn) / (good + bad)
        for x in range(max(0, drawn - bad), min(good, drawn) + 1, 7):
            want = comb(good, x) * comb(bad, drawn - x) / comb(good + bad, drawn)
            got = sharding._binomial(x, good, p, q) * sharding._binomial(drawn - x, bad, p, q) / sharding._binomial(drawn, good + bad, p, q)
            assert got == pytest.approx(want, rel=1e-11)


def test_repeated_vectors_take_ranks_of_their_own(spark):
    df = spark.createDataFrame([(0, [1, 0]), (1, [5, 0]), (1, [5, 0]), (2, [4, 0])], "vec_id long, v array<long>")
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id = 0"), 5).collect()))
    assert got == [(0, 1, 1, 5), (0, 2, 1, 5), (0, 3, 2, 4)]


def test_separators_may_end_words_and_spans_have_any_length(spark):
    corpus = spark.createDataFrame([(" ".join(["you idiot", "stupid moron", "you are a bastard", "the market is open"] * 40),)], "text string")
    r = toxicity.Restorer(toxicity.CharModel({x[0]: x[1] for x in toxicity.char_counts(corpus).collect()}))
    for said, meant in (("idiot.Y0u", "idiot you"), ("stupid/m0ron", "stupid moron"), ("a b a s t a r d", "a bastard"), ("i" * 200 + "diot", "idiot"), ("y.o.u. a.r.e. s.t.u.p.i.d", "you are stupid")):
        assert r.restore(f"so {said} there") == f"so {meant} there"
    assert len(r.restore("a_" * 50_000)) > 0 and len(r.restore("1" * 50_000 + "a")) > 0
    assert roots([1, 2], [(1, 2)]) == {1: 1, 2: 1}


def test_scratch_needs_a_shared_folder_off_one_machine(spark):
    from tidemark.plans import storage

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        storage.shared_dir(Session())
    with storage.released(spark):
        path = storage.materialize(spark.range(3), "gone").inputFiles()[0]
        kept = storage.materialize(spark.range(3), "kept", keep=True)
    import os

    assert not os.path.exists(path.removeprefix("file:").replace("//", "/")) and kept.count() == 3


def test_batches_for_python_are_bounded_unless_the_session_says(spark):
    from tidemark.llm.common import BATCH, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        small_batches(spark)
        assert spark.conf.get(key) == BATCH
        spark.conf.set(key, "1m")
        small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)


@pytest.mark.parametrize("blanks", [" ", "\t", "\n", " ", " \t\r\n", "  ", "\x1c "])
def test_long_runs_of_blanks_have_the_library_s_ids(blanks):
    encoder = packing.Encoder(queries.tokenizer_path())
    text = "x" + blanks * (2_000_000 // len(blanks)) + "y"
    assert (encoder.ids(text) == np.array(encoder.slow.encode(text, add_special_tokens=False).ids)).all()


def test_op2_packs_long_runs_of_blanks(spark, tmp_path):
    texts = [(1, "a" + " " * 1_200_000 + "b"), (2, "\n" * 1_000_000), (3, "plain words"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_configuration_packing(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    slow = packing.Encoder(queries.tokenizer_path()).slow
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(slow.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts}
    assert got


def test_readings_that_never_meet_are_kept_whole():
    model = toxicity.CharModel({})
    # Nothing is settled on the way: what is likeliest at the end holds for the whole span, as for a short one.
    short, long = model.decode("1d10t" * 3), model.decode("1d10t" * 3000)
    assert long.startswith(short[:10])
    assert len(long) >= 900 * len(short)
