"""Each operator against a brute-force version, on a fixture with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from writlake.llm import feistel, isobmff, jaccard, lm_bloom, mixing, packing, range_coder, runlength_index, toxicity, vamana
from writlake.llm.common import Scratch, TokenIds, tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    words = [f"{random.choice('aeiou')}{random.choice('bcdfg')}{i}" for i in range(80)] + ["Über", "ñandú", "日本", "it's"]
    passage = " ".join(random.choice(words) for _ in range(150))
    out = {}
    for i in range(60):
        out[i] = " ".join(random.choice(words) for _ in range(random.choice([1, 2, 5, 40, 200])))
        if i % 6 == 0:
            out[i] += "\n" + passage + " ." + str(i)
        if i % 10 == 9:
            near = out[i - 9].split(" ")
            near[len(near) // 2] = "changed"
            out[i] = " ".join(near)
    out |= {100: None, 101: "", 102: " \t\n", 103: out[7], 104: out[7], 105: "a" * 5000, 106: out[0] * 30, 107: "x  y   z\n\n q", 108: "﷐﷑﷐ odd"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 7 else None, 0, 1.5, "s", 9) for i, t in texts.items()]
    # Columns whose names the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, slot string, key int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_lm_scores(docs, none, texts):
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in texts}
    count = Counter(w for i, ws in tokens.items() if train[i] for w in ws)
    total = sum(count.values())
    got = by_id(lm_bloom.lm_scores(docs))
    assert got.keys() == texts.keys()
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(ws), sum(count[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws))
        assert r.score < 0
    assert lm_bloom.lm_scores(none).count() == 0


def test_bloom_levels():
    keys = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.random.default_rng(0).integers(1, 200, len(keys))
    parts = lm_bloom.part_of(keys, 4)
    model = lm_bloom.Filter([lm_bloom.build_block(keys[parts == p], counts[parts == p], 5, 8.0, 1 << 20) for p in range(4)], 5)
    read = model.counts(keys)
    assert (read >= lm_bloom.LEVEL_COUNTS[lm_bloom.levels(counts)]).all()  # levels are never missed
    assert (read == lm_bloom.LEVEL_COUNTS[lm_bloom.levels(counts)]).mean() > 0.95
    assert (model.counts(keys + np.uint64(1)) == 0).mean() > 0.95


def test_bloom_grows_with_the_ngrams():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 600_000).astype(np.uint64) & lm_bloom._TOP)
    # 21 levels each for two thirds of the keys (8 MB of filter and more), the rest held out.
    n = np.where(np.arange(len(keys)) % 3 > 0, 2**20, 0).astype(np.uint32)
    row = {"kind": [2], "chunk": ["0-0"], "part": [0], "payload": [lm_bloom.pack(lm_bloom.delta(keys), n)]}
    got = lm_bloom.count_part(5, 8.0)(pa.table(row)).to_pylist()
    (found,) = lm_bloom.unpack(next(x["payload"] for x in got if x["kind"] == 2))
    assert (found[n > 0] >= 21).all()
    assert (found[n == 0] > 0).mean() < 0.03


def test_toxicity(spark):
    random.seed(1)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 0
        ws = [random.choice(plain) for _ in range(20)] + (["vilest", "grubby"] if bad else []) + ([random.choice(["muslims", "jews"])] if bad or i % 20 == 1 else [])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "the jews of the town"), (None, "vilest grubby")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    fair, unfair = toxicity.fit(docs, marks, fairness=20.0), toxicity.fit(docs, marks, fairness=0.0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, fair).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert got[9000] == got[9001] < 0.3 and got[9002] < 0.3 and got[None] >= 0.3
    swing = lambda m: abs(m.logit({"muslims"}) - m.logit({"citizens"})) + abs(m.logit({"jews"}) - m.logit({"muslims"}))
    assert swing(fair) <= swing(unfair)
    assert toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).agg({"score": "max"}).first()[0] < 1e-9
    assert toxicity.score(docs.limit(0), fair).count() == 0
    assert toxicity.score(docs.selectExpr("*", "'x' as score"), fair).columns == ["doc_id", "text", "score"]


def test_packing(docs, none, texts):
    coder = TokenIds(tokenizer_file("byte_bpe_50k.json"), "space")
    rows = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), tokens=256, segments=8, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids = [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [y for r in own for y in r.ids] == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids) for r in own)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 256 and len(own) <= 8
    assert packing.pack_documents(none, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(0)
    items = np.stack([np.arange(400), np.zeros(400, int), rng.integers(1, 90, 400), np.zeros(400, int)], 1)
    items[:, 3] = rng.integers(0, items[:, 2] + 1)
    for cut in (False, True):
        p = packing.Packer(tokens=128, segments=5, loss=64, cut=cut)
        p.add(items[items[:, 3] <= 64])
        p.pack(True)
        n = Counter(x[3] for x in p.pieces)
        used = Counter()
        for _, _, size, sequence, _ in p.pieces:
            used[sequence] += size
        assert max(n.values()) <= 5 and max(used.values()) <= 128
        assert sum(used.values()) == items[items[:, 3] <= 64][:, 2].sum()


@pytest.mark.parametrize("permille", [300, 1000, 5000])
def test_mixing(docs, none, texts, permille):
    rows = mixing.mix(docs, permille=permille, epochs=3).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    total = sum(size.values())
    assert sum(r.take for r in rows) == min(total * permille // 1000, 3 * total)
    assert all(0 < r.take <= r.doc_tokens == size[r.doc_id] and r.epoch < 3 for r in rows)
    leaves = defaultdict(list)
    for r in rows:
        leaves[r.domain, r.lang, r.source].append(r)
    for own in leaves.values():  # whole epochs, then a part whose cut documents are one at most
        last = max(r.epoch for r in own)
        assert all(sum(r.doc_id == x for r in own) >= last for x in {r.doc_id for r in own if r.epoch < last})
        assert sum(r.take < r.doc_tokens for r in own) <= 1
    assert mixing.mix(none).count() == 0


def test_mixing_gives_shortages_to_siblings_first(spark):
    rows = [(i, "w " * 10, lang, source) for i, (lang, source) in enumerate([("en", "a3"), ("en", "b3")] * 10 + [("fr", "c3")] * 40)]
    docs = spark.createDataFrame([*rows, *((100 + i, "w " * 10, "en", "b3") for i in range(20))], "doc_id long, text string, lang string, source string")
    weights = {"domain": {}, "lang": {"en": 1, "fr": 1}, "source": {"a3": 9}}
    got = Counter()
    for r in mixing.mix(docs, permille=500, epochs=1, weights=weights, domain="'d'").collect():
        got[r.source] += r.take
    # 400 of 800 tokens: 200 for each language; of English, a3 takes its 100 and b3 the rest, though its weight is 1 in 10.
    assert got == {"a3": 100, "b3": 100, "c3": 200}


def test_feistel(spark, docs, none, texts):
    rows = feistel.shard_rows(docs.union(docs.where("doc_id = 7")), 16, 5).collect()
    n = len(texts) + 1
    assert sorted(r.position for r in rows) == sorted(r.row_number for r in rows) == list(range(n))
    assert all((r.shard, r.slot) == (r.position % 16, r.position // 16) for r in rows)
    assert all((r["size"], r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, zlib.crc32((texts[r.doc_id] or "").encode())) for r in rows)
    again = feistel.shard_rows(docs.union(docs.where("doc_id = 7")).repartition(5), 16, 5).collect()
    assert sorted((r.doc_id, r.position) for r in rows) == sorted((r.doc_id, r.position) for r in again)
    assert feistel.shard_rows(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    got = [r.p for r in spark.range(n).selectExpr(f"{feistel.permute_sql('id', n, 11)} as p").collect()]
    assert sorted(got) == list(range(n))


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard(spark, docs, none, texts, k, num):
    random.seed(k)
    base = [[f"w{random.randrange(60)}" for _ in range(random.randrange(8, 60))] for _ in range(8)]
    more = {}
    for i in range(1000, 1150):
        b = list(random.choice(base))
        for _ in range(random.choice([0, 1, 2, 3])):
            b[random.randrange(len(b))] = f"z{random.randrange(40)}"
        more[i] = " ".join(b)
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = jaccard.near_duplicates(df, k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts | more, k, num, 100)


def test_jaccard_of_nothing(none):
    assert jaccard.near_duplicates(none).count() == 0


def test_keep_one(docs, texts):
    kept = [r.doc_id for r in jaccard.keep_one(docs.union(docs.where("doc_id = 7")), 3, 90, 100).collect()]
    groups = brute_components(texts, 3, 90, 100)
    assert sorted(kept) == sorted({c for _, c in groups.values()})


def test_id_files(docs, none, texts):
    coder = TokenIds(tokenizer_file("word_bpe_49k.json"), "word")
    got = by_id(range_coder.written_and_read(docs, tokenizer_file("word_bpe_49k.json")))
    at = 0
    for i in sorted(texts):
        ids = np.array([*coder.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert range_coder.written_and_read(none, tokenizer_file("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 16, n), rng.integers(0, 3, n), np.full(n, 65535)):
        data = range_coder.write_segment([None, 5], np.array([n, 0]), ids, 16, 128)
        names, counts, back = range_coder.read_segment(data)
        assert names == [None, 5] and counts.tolist() == [n, 0] and (back == ids).all()
        if n:
            with pytest.raises(ValueError):
                range_coder.read_segment(data[:-3] + bytes(x ^ 1 for x in data[-3:]))
    if n == 1000:
        assert len(range_coder.encode_blocks(np.tile([4, 9, 2], 1000), 3000, 16)[0]) < 600


def brute_spans(texts, least):
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(x[s : s + least] for x in data.values() for s in range(len(x) - least + 1))
    out = {}
    for i, x in data.items():
        gone = np.zeros(len(x) + 1, bool)
        for s in range(len(x) - least + 1):
            if seen[x[s : s + least]] > 1:
                gone[s : s + least] = True
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("label_bytes", [0, 20_000, 6_000_000])
def test_repeated_strings(docs, none, texts, label_bytes):
    got = runlength_index.dedup(docs, 120, 50_000, label_bytes).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_spans(texts, 120)
    assert runlength_index.dedup(none, 120).count() == 0


def test_remove_repeats(docs, texts):
    got = by_id(runlength_index.remove_repeats(docs, 120))
    for i, (size, gone, _, digest) in brute_spans(texts, 120).items():
        assert got[i].slot == "s"
        if not gone:
            assert got[i].text == texts[i]
        elif size == gone:
            assert got[i].text == ""
        else:
            assert len(got[i].text.encode()) <= size - gone


def test_matching_lengths():
    rng = np.random.default_rng(0)
    for trial in range(60):
        symbols = np.concatenate([np.append(rng.integers(1, 2 + trial % 4, rng.integers(1, 40)), 0) for _ in range(4)]).astype(np.uint16)
        n, s = len(symbols), symbols.tolist()
        want = []
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and s[i + k] == s[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
        assert runlength_index.matching_lengths(symbols).tolist() == want


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 16)).astype(np.float32)
    vectors[300:320] = vectors[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, []), (900, [1.0, None]), (None, [1.0] * 16), (950, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "'x' as rank")
    got = defaultdict(list)
    for r in vamana.nearest(df, shard_nodes=200).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = vectors.astype(float)
    norms, hits = np.sqrt((x * x).sum(1)), 0
    queries = range(0, 600, 50)
    assert set(got) == set(queries)
    for q in queries:
        score = (x * x[q]).sum(1) / (norms * norms[q])
        score[q] = -2
        true = np.lexsort((np.arange(600), -score))[:5]
        assert [r for r, *_ in got[q]] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[v], abs=1e-12) for _, v, s in got[q])
        hits += len({v for _, v, _ in got[q]} & set(true.tolist()))
    assert hits >= 0.9 * 5 * len(queries)
    assert [v for _, v, _ in got[0]] == [300, 301, 302, 303, 304]  # ties go to smaller ids
    assert vamana.nearest(df.limit(0)).count() == 0


def test_media(spark, docs, none, texts):
    got = by_id(isobmff.text_media_features(docs))
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[103].feature == got[104].feature == got[7].feature
    assert isobmff.text_media_features(none).count() == 0


def test_media_columns(spark):
    payload = bytes(range(256)) * 40
    good = isobmff.write_track(payload)
    rows = [(1, good), (2, None), (3, b""), (4, good[: len(good) // 2]), (5, b"\0\0\0\x08free"), (6, good[:24] + b"\x7f\xff\xff\xff" + good[28:])]
    got = {r.id: r for r in isobmff.media_columns(spark.createDataFrame(rows, "id long, content binary"), "id").collect()}
    track = got[1].tracks[0]
    assert (got[1].status, got[1].brand, track.codec, track.timescale, track.duration, track.n_samples) == ("ok", "isom", "raw ", 8000, len(payload), len(payload) // 64)
    assert [good[a:b] for a, b in track.key_ranges] == [payload[k * 64 : k * 64 + 64] for k in range(0, len(payload) // 64, 32)]
    assert got[2].status == "null" and got[3].status == got[5].status == "no movie"
    assert "cut" in got[4].status or "box" in got[4].status
    assert got[6].status != "ok"


def test_media_that_is_not_decoded_says_so(spark):
    payload = bytes(range(256)) * 40
    good = isobmff.write_track(payload)
    table = isobmff.full(b"stsz", (64).to_bytes(4, "big"), (len(payload) // 64).to_bytes(4, "big"))
    compact = isobmff.full(b"stz2", (8).to_bytes(4, "big"), (len(payload) // 64).to_bytes(4, "big")) + b""
    assert good.count(table) == 1 and len(compact) == len(table)
    cut = good.replace(table, compact)  # its sizes run beyond the box
    rows = [(1, good + isobmff.box(b"moof", isobmff.full(b"mfhd", bytes(4)))), (2, cut)]
    got = {r.id: r.status for r in isobmff.media_columns(spark.createDataFrame(rows, "id long, content binary"), "id").collect()}
    assert got[1] == "fragments are not decoded" and got[2] != "ok"
    assert isobmff.compact_sizes(memoryview(bytes([0x12, 0x30])), 0, 4, 3, 2).tolist() == [1, 2, 3]
    assert isobmff.compact_sizes(memoryview(bytes([1, 2, 3, 4])), 0, 16, 2, 4).tolist() == [258, 772]
    assert isobmff.media_columns(spark.createDataFrame([], "id long, content binary"), "id").count() == 0


def test_graph_recall_in_a_large_shard(spark):
    """One shard of 3,000 nodes and a beam of 60: the search sees a small part of it."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x[1500:] = x[:1500] + 0.3 * rng.normal(size=(1500, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in vamana.nearest(df, search_width=60).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    hits = 0
    for q in range(0, 3000, 50):
        score = unit @ unit[q]
        score[q] = -2
        hits += len(got[q] & set(np.argsort(-score, kind="stable")[:5].tolist()))
    assert hits >= 0.9 * 5 * 60


def test_packing_limits_loss_bearing_ids(spark):
    """Prompts bear no loss: the limit on the ids that do binds before the one on ids."""
    rows = [(i, "word " * 40, 10) for i in range(50)] + [(60, None, None), (61, "a b", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, answer int")
    got = packing.pack_documents(df.coalesce(1), tokenizer_file("byte_bpe_50k.json"), loss=100, bearing="answer").collect()
    whole = {r.doc_id: r.doc_tokens for r in got}
    assert all(sum(r.length for r in got if r.doc_id == i) == n for i, n in whole.items())
    used = Counter(r.sequence_id for r in got if r.doc_id < 50)
    assert max(used.values()) <= 14 and len(used) > 50 * 41 // 1024 + 1


def test_copies_and_null_ids(spark):
    """Rows that repeat, also under one id, and rows without an id come out as often as they went in."""
    text = "one two three four five six seven eight nine ten eleven twelve " * 12
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = sorted(str(r[0]) for r in rows)
    path = tokenizer_file("word_bpe_49k.json")
    outs = (lm_bloom.lm_scores(df), jaccard.near_duplicates(df, 3, 90), runlength_index.dedup(df, 120), isobmff.text_media_features(df), feistel.shard_rows(df, 4, 7), range_coder.written_and_read(df, path))
    for out in outs:
        assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == ids
    assert {r.n_removed for r in runlength_index.dedup(df, 120).collect()} == {0, len(text)}


def test_one_common_passage_goes_through_the_index(spark):
    """A passage of every text: its label exceeds a block and is dealt out by anchor."""
    random.seed(4)
    passage = " ".join(f"w{random.randrange(1000)}" for _ in range(60))
    texts = {i: f"{random.random()} {passage} {random.random()}" for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for bound in (3_000_000, 60_000):
        for i, r in by_id(runlength_index.dedup(df, 120, block_bytes=20_000, label_bytes=bound)).items():
            assert (r.n_removed, r.n_spans) == brute_spans(texts, 120)[i][1:3]


def test_cuts_make_no_new_characters(spark):
    """What is left and right of a cut is decoded by itself."""
    shared = "é" * 5 + "".join(chr(0x4E00 + i) for i in range(200))
    texts = {1: "abé" + shared + "écd", 2: "xy" + shared + "zz"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in runlength_index.remove_repeats(df, 120).collect():
        assert set(r.text) <= set(texts[r.doc_id])


def test_index_block_memory():
    """A block's index takes 80 bytes for each of the text's at most: blocks may have 3 MB, and a worker a few hundred."""
    rng = np.random.default_rng(4)
    parts = [rng.integers(97, 123, 700, np.uint8).tobytes() for _ in range(200)]
    parts += [x[:250] + b"#" + x[250:] for x in reversed(parts)]
    table = pa.table({"block": [0] * 400, "payload": pa.array(parts, pa.binary()), "key": list(range(400)), "start": pa.array([0] * 400, pa.int32())})
    tracemalloc.start()
    got = runlength_index.index_block(240)(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * sum(map(len, parts))
    want = [(i, s, e) for i in range(400) for s, e in ([(0, 700)] if i < 200 else [(0, 250), (251, 701)])]
    assert sorted((x["key"], x["start"], x["end"]) for x in got) == want


def test_packing_forgets(spark, docs):
    """With ``forget`` the workers hold no pieces behind a task."""
    packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), remembered=12_345, forget=True).count()

    def held(batches):
        from writlake.llm import common

        list(batches)
        yield pa.record_batch({"n": pa.array([sum(len(x.known) for (_, _, most), x in common._tokenizers.items() if most == 12_345)], pa.int64())})

    assert {r.n for r in spark.range(0, 400, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_segments_hold_their_bytes(spark):
    """A segment's texts have ``segment_bytes`` at most; two that are smaller are not joined beyond it."""
    df = spark.createDataFrame([(i, "ab c" * 1500) for i in range(12)], "doc_id long, text string").coalesce(1)
    segments = range_coder.write_ids(df, Scratch(spark, "ids"), tokenizer_file("word_bpe_49k.json"), segment_bytes=10_000).collect()
    assert {r.n_docs for r in segments} == {1} and len(segments) == 12


def test_word_ids_of_odd_words():
    coder = TokenIds(tokenizer_file("word_bpe_49k.json"), "word")
    texts = ["a\x01é \x01", "</w> x</w>y é</w>", "é ́e ÀÉ ΑΣ ﬁ 한", "", "ÿ \xa0 a b\u0085", "12é34 's don't été's", "\U0001f600\U0001f600 İi ǅ"] * 90
    flat, counts = coder.encode(pa.array(texts))
    want = [coder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == [x for y in want for x in y]
    # The same words where no id ends words: each id's own word tells.
    slow = TokenIds(tokenizer_file("word_bpe_49k.json"), "word")
    slow.lasts[:] = False
    assert slow.encode(pa.array(texts))[0].tolist() == flat.tolist()
