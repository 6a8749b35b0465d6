import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers as pt
import pyarrow as pa
import pytest
import tiktoken
from brute import components, deduplicated, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesselon.llm import anchor_dedup, avi, byte_bpe, chat_events, concat_cut, cws, elias_fano, importance, jaccard_join, jpeg, ngram_trie, queries, url_rules, wordbytes

RANKS, WORD_BPE = pt.path("byte_bpe_50k.tiktoken"), pt.path("word_bpe_49k.json")


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


# 1


def prose_and_junk(spark):
    good = [(i, "the quick brown fox and the lazy dog walk in the wood of day " * (1 + i % 5)) for i in range(200)]
    bad = [(1000 + i, "ZK!! QX$$ | | " * (3 + i % 5)) for i in range(80)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, 0) for i, _ in good[:150]] + [(i, 0, 0) for i, _ in bad[:60]], "doc_id long, quality int, toxic int")


def test_resampling_separates_held_out_labels(spark):
    kept = [r.doc_id for r in importance.selected(*prose_and_junk(spark)).collect()]
    assert set(range(200)) <= set(kept) and len(kept) <= 203  # labelled or not; junk lies 5 units and more lower


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    keys = np.round(rng.normal(size=2000) * 100, 1)
    weights = spark.createDataFrame([(int(i), float(k)) for i, k in enumerate(keys)], "k1 long, key double")
    for k in (0, 1, 17, 1000, 2000, 3000):
        got = sorted(r.key for r in importance.top_k(weights, k).collect())
        least = np.sort(keys)[::-1][min(k, 2000) - 1] if k else math.inf
        assert got == sorted(keys[keys >= least].tolist())


def test_gumbel_noise_has_its_distribution():
    noise = importance.gumbel(np.arange(100_000), np.arange(100_000) * 7)
    assert abs(noise.mean() - 0.5772) < 0.02 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.02


def test_sample_of_given_size(documents, labels):
    kept, every = importance.sample(documents, labels, k=30)
    assert kept.count() >= 30 and every.count() == documents.count()


def test_seeds_draw_different_samples(spark):
    docs, marks = prose_and_junk(spark)
    drawn = [{r.doc_id for r in importance.selected(docs, marks, k=100, seed=s).collect()} for s in (0, 0, 1)]
    assert drawn[0] == drawn[1] != drawn[2] and 20 < len(drawn[0] & drawn[2]) < 90  # of 200 that are good
    assert max(drawn[0] | drawn[2]) < 1000


def test_noise_is_drawn_in_proportion_to_weights(spark):
    """Of one thousand pairs whose tempered weights differ by ln 3, the greater has the greater key three times of four."""
    a, b = (importance.gumbel(np.arange(1000), np.full(1000, i), 5) for i in (1, 2))
    assert abs((a + math.log(3) > b).mean() - 0.75) < 0.05


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables aren't here")
def test_held_out_labels(spark):
    """Recall on the fold that neither the models nor temperature nor k have seen."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = []
    for seed in (0, 1):
        kept, every = importance.sample(docs, marks, seed=seed)
        held = every.filter(F.col("fold") == importance.HELD_OUT).select("k1", "good").filter("good is not null")
        ids = {r.k1 for r in kept.select("k1").collect()}
        rows = held.collect()
        good, bad = [r.k1 in ids for r in rows if r.good], [r.k1 in ids for r in rows if not r.good]
        assert len(good) > 500 and len(bad) > 100 and np.mean(good) >= 0.995 and np.mean(bad) <= 0.03
        found.append(ids)
    assert found[0] != found[1]


def plain_buckets(text):
    """Buckets of a text's grams, one by one."""
    m64 = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    def with_pairs(values, low, size):
        return [v % size + low for v in values] + [mix((a * 0x9E3779B97F4A7C15 + b) & m64) % size + low for a, b in zip(values, values[1:], strict=False)]

    raw = (text or "").encode()
    runs = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", raw)
    named = [int(wordbytes.digests(pa.array([re.sub(rb"[A-Z]", lambda c: c[0].lower(), r)], pa.large_binary()))[0, 0]) for r in runs]
    shapes, last = [], None
    for w in re.findall(rb"[^\x20\x09-\x0d]+", raw):
        size = sum(len(w) >= t for t in (3, 6, 10, 15, 25))
        uppers = len(re.findall(rb"[A-Z]", w))
        closing = 1 if w[-1:] in b".,;:" else 2 if w[-1:] in b"!?" else 3 if re.match(rb"[!-/:-@\[-`{-~]", w[-1:]) else 0
        marks = len(re.findall(rb"[^0-9A-Za-z\x80-\xff]", w))
        small = re.sub(rb"[A-Z]", lambda c: c[0].lower(), w)
        shape = size
        for part, ways in ((2 if uppers > 1 else int(w[:1].isupper()), 3), (int(bool(re.search(rb"[0-9]", w))), 2), (closing, 4), (min(marks, 3), 4), (int(small == last), 2)):
            shape = shape * ways + part
        shapes.append(mix(shape + 99))
        last = small
    return with_pairs(named, 0, importance.WORD_BUCKETS) + with_pairs(shapes, importance.WORD_BUCKETS, importance.SHAPE_BUCKETS)


def test_weights_equal_plain_counts(documents, labels, corpus):
    good = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()}
    buckets = {i: collections.Counter(plain_buckets(t)) for i, t in corpus}
    raw, target = collections.Counter(), collections.Counter()
    for i, c in buckets.items():
        raw += c
        if i in good and zlib.crc32(str(i).encode()) % 5 in importance.FITS:
            target += c
    sums, rooms = {}, {0: importance.WORD_BUCKETS, 1: importance.SHAPE_BUCKETS}
    part = lambda b: int(b >= importance.WORD_BUCKETS)
    for name, counts in (("raw", raw), ("target", target)):
        for p in (0, 1):
            sums[name, p] = sum(n for b, n in counts.items() if part(b) == p) + 0.5 * rooms[p]
    ratio = {b: math.log((target[b] + 0.5) / sums["target", part(b)]) - math.log((raw[b] + 0.5) / sums["raw", part(b)]) for b in raw}
    for r in importance.weighed(documents, labels).collect():
        want = sum(n * ratio[b] for b, n in buckets[r.k1].items())
        assert r.n_grams == sum(buckets[r.k1].values()) and r.log_weight == pytest.approx(want, rel=1e-9, abs=1e-6)
        assert r["mean"] == pytest.approx(want / (r.n_grams + importance.SHORT), rel=1e-9, abs=1e-9)


# 2


def test_elias_fano_access_and_search(tmp_path):
    rng = np.random.default_rng(0)
    for n, universe in ((0, 9), (1, 1), (7, 7), (900, 10**9), (5000, 5001), (3000, 40)):
        values = np.sort(rng.integers(0, universe, n))
        elias_fano.save(str(tmp_path / "x"), elias_fano.encode("a", values, universe))
        s = elias_fano.Sequence(elias_fano.load(str(tmp_path / "x")), "a")
        at = rng.integers(0, max(n, 1), min(n, 500))
        assert (s.access(at) == values[at]).all()
        sought = np.concatenate([values[at], rng.integers(0, universe, 500)])
        place, found = s.find(sought)
        assert (place == np.searchsorted(values, sought)).all() and (found == np.isin(sought, values)).all()


def test_trie_rows_are_sorted_by_one_key(monkeypatch):
    """Ids of millions of words left no room for three in one integer, and sorting by several cost the trie its CPU budget."""
    rng = np.random.default_rng(6)
    rows = np.stack([rng.choice(rng.integers(0, 4_000_000, 50), 3000), *rng.integers(3_999_990, 4_000_000, (2, 3000))])
    plain = collections.Counter(map(tuple, rows.T.tolist()))
    expected = sorted((*k, c) for k, c in plain.items())

    def summed():
        halves = []
        for half in (rows[:, :1400], rows[:, 1400:]):
            found, count = ngram_trie._count_rows(tuple(half))
            halves.append(ngram_trie._packed([*found, count]))
        columns, count = ngram_trie._summed(halves, 3)
        return list(zip(*(c.tolist() for c in (*columns, count)), strict=True))

    assert summed() == expected
    monkeypatch.setattr(ngram_trie, "_one_key", lambda *keys: None)  # the way of wider ranges
    assert summed() == expected
    monkeypatch.undo()
    halves = [ngram_trie._packed([*r, np.ones(len(r[0]), int)]) for r in (rows[:, :1400], rows[:, 1400:])]
    monkeypatch.setattr(ngram_trie.np, "lexsort", lambda *a: pytest.fail("several sorts"))
    assert ngram_trie._summed(halves, 3)[1].sum() == 3000


def test_elias_fano_groups_of_any_size():
    """Dense and empty high parts together, last elements and low bits across words."""
    rng = np.random.default_rng(7)
    for universe in (1 << 20, 3 * 10**11, 1 << 45):
        dense = universe // 3 + np.arange(3000) * 2
        values = np.unique(np.concatenate([dense, rng.integers(0, universe, 2000), [universe - 1]]))
        arrays = {k: np.frombuffer(bytearray(a.tobytes()), a.dtype) for k, a in elias_fano.encode("a", values, universe).items()}
        s = elias_fano.Sequence(arrays, "a")
        assert (s.access(np.arange(len(values))) == values).all() and s.words.flags.aligned
        sought = np.concatenate([values, dense + 1, rng.integers(0, universe, 3000), [0, universe - 1]])
        place, found = s.find(sought)
        assert (place == np.searchsorted(values, sought)).all() and (found == np.isin(sought, values)).all()


def plain_scores(rows, m2=ngram_trie.M2, m3=ngram_trie.M3):
    docs = {i: [*words(t), "</end>"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in docs.items():
        if not held[i]:
            c1.update(w)
            z = ["<s>", "<s>", *w]
            c2.update(zip(z[1:], z[2:], strict=False))
            c3.update(zip(z, z[1:], z[2:], strict=False))
    n, v, texts = sum(c1.values()), len(c1), sum(not h for h in held.values())
    context = collections.Counter()
    for (a, b, _), x in c3.items():
        context[a, b] += x
    out = {}
    for i, w in docs.items():
        base = total = 0.0
        z = ["<s>", "<s>", *w]
        for a, b, c in zip(z, z[1:], z[2:], strict=False):
            p1 = (c1[c] + 0.5) / (n + 0.5 * (v + 1))
            p2 = (c2[b, c] + m2 * p1) / ((texts if b == "<s>" else c1[b]) + m2)
            base += math.log10(p1)
            total += math.log10((c3.get((a, b, c), 0) + m3 * p2) / (context[a, b] + m3))
        out[i] = held[i], len(w), sum(c1[x] > 0 for x in w), n, base, total
    return out


def test_trie_scores_equal_plain_counts(documents, corpus):
    want = plain_scores(corpus)
    for r in ngram_trie.scored(documents).collect():
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, abs=2e-4 * n + 1e-6)  # 16-bit values


def test_query_counts_trigrams_that_occur_once(spark, tmp_path):
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(40)]
    seen, unseen = held.index(False), held.index(True)
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(seen, text), (unseen, text)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op2_ngram_trie(spark, str(tmp_path)).collect()}
    m2, m3, n = ngram_trie.M2, ngram_trie.M3, 31
    p1 = 1.5 / (n + 0.5 * (n + 1))  # every word, bigram and trigram occurs once
    each = math.log10((1 + m3 * (1 + m2 * p1) / (1 + m2)) / (1 + m3))
    assert got[unseen] == got[seen] == pytest.approx(n * each, abs=2e-4 * n)


def test_model_probabilities_sum_to_one(spark, documents):
    model = ngram_trie.train(documents.select("text"))
    size = model.words.size
    w = np.arange(size + 1)  # all words and one unknown
    count = np.append(model.words.counts(w[:-1]), 0)
    for u, v in ((3, 5), (model.words.start, model.words.start), (10, size), (0, 1)):
        c_v = ngram_trie._context_counts(model.words, np.array([v]))[0]
        p = model.probabilities(np.full(size + 1, u), np.full(size + 1, v), w, np.full(size + 1, c_v), model.unigram(count))
        assert p.sum() == pytest.approx(1, abs=2e-3)


def test_hot_words_are_spread():
    spread = ngram_trie.Spread(16, {5: 8})
    assert len(set(spread.bucket(np.full(500, 5), np.arange(500)).tolist())) > 4
    assert len(set(spread.bucket(np.full(500, 6), np.arange(500)).tolist())) == 1


# 3


def test_components_equal_all_pairs(documents, corpus):
    want = components(corpus)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.document_components(documents).collect()}
    assert got == want


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for n in (1, 3, 12, 60, 400, 1500):
        for rare in (0.0, 0.3, 1.0):
            pool = rng.integers(1, 1 << 60, 3 * n).astype(np.uint64)
            classes = {t: (3 if rng.random() < rare else 8) for t in pool.tolist()}
            for _ in range(20):
                a = rng.choice(pool, n, replace=False)
                m = int(rng.integers(max(1, -(-n * 3 // 4)), n + 1))
                union = max(m, (4 * m) // 3)
                b = np.concatenate([a[:m], rng.choice(np.setdiff1d(pool, a), max(0, min(union - n, 2 * n)), replace=False)])
                common = len(np.intersect1d(a, b))
                if 100 * common < 75 * (len(a) + len(b) - common):
                    continue
                signs = [set(jaccard_join.prefix_signatures(s, np.array([classes[t] for t in s.tolist()]))[0].tolist()) for s in (a, b)]
                assert signs[0] & signs[1], (n, rare, m)


def test_hot_groups_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in rng.integers(0, 500, 150)]
    rows = []
    for i in range(150):
        near = list(base)
        for p in rng.integers(0, 150, int(rng.integers(0, 9))):
            near[p] = f"v{rng.integers(0, 500)}"
        rows.append((i, " ".join(near)))
    got = {r.doc_id: r.component_id for r in jaccard_join.document_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in components(rows).items()}


# 4


def generalised_jaccard(a, b):
    a, b = collections.Counter(words(a)), collections.Counter(words(b))
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_fingerprints_and_edits(documents, corpus):
    texts = {i: t or "" for i, t in corpus}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]], strict=True))
    prints = {}
    for r in cws.fingerprint_pairs(documents).collect():
        text, after = texts[r.doc_id], texts[following[r.doc_id]]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(changed.encode()))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert abs(r.near_edited - generalised_jaccard(text, changed)) < 0.35 and abs(r.near_next - generalised_jaccard(text, after)) < 0.35


def test_collision_rate_is_generalised_jaccard():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts, want = [], []
    for i in range(400):  # words of their own, so that errors are independent
        counts = rng.integers(0, 4, (2, 40))
        texts += [" ".join(f"p{i}q{j}" for j, n in enumerate(c) for _ in range(n)) for c in counts]
        want.append(generalised_jaccard(*texts[-2:]))
    signs = cws.signatures(pa.array(texts))
    error = cws.likeness(signs[::2], signs[1::2]) - np.array(want)
    assert abs(error.mean()) < 0.012 and error.std() < 0.075


def test_one_document_follows_itself(spark):
    r = cws.fingerprint_pairs(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert r.edited_sha256 == sha(b"abab") and r.near_next == 1.0


# 5


def test_media_round_trip(documents, corpus):
    texts = {i: (t or "").encode() for i, t in corpus}
    for r in avi.text_media(documents).collect():
        payload = avi.payload_of(texts[r.doc_id])
        assert len(payload) % 64 == 0 and (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (sha(payload), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == sha(avi.store(payload)) and r.media_bytes == len(avi.store(payload))


def test_sample_frames_are_baseline_jpeg():
    payload = bytes(np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8))
    media = avi.store(payload)
    file = avi.read_avi(media)
    for i, (a, n) in enumerate(zip(file["offsets"].tolist(), file["sizes"].tolist(), strict=True)):
        pixels = jpeg.decode(media[a : a + n])  # the general decoder
        want = (payload + b"\0" * 72)[i * 1024 : (i + 1) * 1024]
        assert pixels[::8, ::8].tobytes() == want and (pixels.reshape(32, 8, 32, 8) == pixels[::8, ::8][:, None, :, None]).all()


def grey_jpeg(image, tables=True):
    """A plain baseline encoder with the standard's tables and unit quantisers."""
    codes = {(c, s): (n, code) for c, t in ((0, jpeg.STD_DC_LUMA), (1, jpeg.STD_AC_LUMA)) for n, code, s in jpeg._codes(*map(bytes.fromhex, t))}
    bits, last = "", 0

    def put(value, c, run=0):
        nonlocal bits
        size = abs(value).bit_length()
        n, code = codes[c, run * 16 + size]
        bits += f"{code:0{n}b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    h, w = image.shape
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            block = jpeg._BASIS @ (image[y : y + 8, x : x + 8].astype(float) - 128) @ jpeg._BASIS.T
            z = np.rint(block).astype(int).ravel()[jpeg.ZIGZAG].tolist()
            put(z[0] - last, 0)
            last, run = z[0], 0
            for v in z[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    n, code = codes[1, 0xF0]
                    bits += f"{code:0{n}b}"
                    run -= 16
                put(v, 1, run)
                run = 0
            if run:
                n, code = codes[1, 0]
                bits += f"{code:0{n}b}"
    bits += "1" * (-len(bits) % 8)
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    dht = b"".join(part(0xC4, bytes([c << 4]) + bytes.fromhex(a) + bytes.fromhex(b)) for c, (a, b) in ((0, jpeg.STD_DC_LUMA), (1, jpeg.STD_AC_LUMA)))
    return b"\xff\xd8" + part(0xDB, b"\0" + b"\1" * 64) + part(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\1\1\x11\0") + (dht if tables else b"") + part(0xDA, b"\1\1\0\0\x3f\0") + raw + b"\xff\xd9"


@pytest.mark.parametrize("tables", [True, False])
def test_general_frames_and_shots(spark, tables):
    rng = np.random.default_rng(5)
    dark, light = (np.clip(rng.normal(m, 8, (16, 24)), 0, 255).astype(np.uint8) for m in (60, 190))
    frames = [dark] * 6 + [light] * 7 + [dark] * 5
    media = avi.write_avi([grey_jpeg(f, tables) for f in frames], 24, 16)
    for image, got in zip(frames, avi.grey_frames(media, avi.read_avi(media)), strict=True):
        assert np.abs(got.astype(int) - image.astype(int)).max() <= 1
    rows = avi.clips(spark.createDataFrame([(1, media), (2, None)], "id long, media binary"), "id", "media").orderBy("clip").collect()
    assert [(r.first_frame, r.last_frame) for r in rows] == [(0, 5), (6, 12), (13, 17)] and rows[1].start_s == pytest.approx(6 / 25)
    without_index = media[: media.rindex(b"idx1")]
    assert len(avi.read_avi(without_index)["offsets"]) == 18
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFFxxxxWAVE")


# 6


def test_byte_bpe_equals_tiktoken(documents, corpus):
    plain = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    texts = {i: t or "" for i, t in corpus}
    for r in byte_bpe.round_trip(documents, RANKS, pt.PATTERN).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(texts[r.doc_id].encode())


@pytest.mark.parametrize("text", ["a  b", " lead", "tail ", "x\n\n y\t z", "it's I'LL", "１２３ ٣٤", "🙂 👩‍👩‍👧 é e\u0301", "\u00a0\u2003x", "\x1c a\x85b", "<|endoftext|>", "\n<mark> \n", "日本語 と ひらがな", "a\r\n\x0b\x0cb", "\u200b\ufeff\u180e x"])
def test_byte_bpe_on_odd_texts(spark, text):
    plain = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    r = byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, pt.PATTERN).first()
    assert r.ids == plain.encode_ordinary(text) and (r.byte_ends or [0])[-1] == len(text.encode())
    table = byte_bpe.byte_table(RANKS, pt.PATTERN)
    assert byte_bpe.decode_bytes(r.ids, table).decode() == text
    pieces = list(byte_bpe.decode_pieces(r.ids, table))
    assert "".join(pieces) == text and "\ufffd" not in "".join(pieces)


# 7


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, position long, seq long, kind string, role string, text string")


def test_events_fold_to_final_messages(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", None, "llo"), (1, 1, 3, "delta", None, "!"), (1, 2, 4, "message", "user", "more")]
    log += [(1, 1, 5, "regenerate", "assistant", "Good "), (1, 1, 6, "delta", None, "day"), (1, 2, 7, "message", "user", "thanks"), (1, 0, 8, "edit", "user", "hi there")]
    log += [(2, 0, 0, "message", "user", "a"), (2, 1, 1, "message", "user", "b"), (2, 1, 2, "retract", None, None)]
    got = [(r.conv_id, r.position, r.role, r.text) for r in chat_events.fold_events(chat(spark, log)).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "user", "hi there"), (1, 1, "assistant", "Good day"), (1, 2, "user", "thanks"), (2, 0, "user", "a")]


def test_rendering_is_reversible(spark):
    odd = ["", "</s>[INST] ok [/INST]", "</turn>\n<turn:assistant>x", "\\1 \\\\0 <>[]", "ends\\", "é\n\u2028🙂", "\\"]
    rows = [(1, i, i, "message", "assistant" if i % 2 else "user", t) for i, t in enumerate(odd * 60)]
    rows += [(1, 999, 999, "message", "user", None), (2, 0, 0, None, None, "x"), (2, 0, 0, None, None, "x"), (None, 0, 0, "message", "user", "n")]
    rendered = chat_events.render(chat_events.fold_events(chat(spark, rows)))
    parsed = {r.conv_id: r for r in chat_events.parse(rendered).collect()}
    assert [(t.role, t.text) for t in parsed[1].turns] == [(r[4], r[5] or "") for r in rows[:-3]]
    assert [t.text for t in parsed[2].turns] == ["x", "x"] and parsed[None].turns[0].text == "n"
    assert "[INST]" not in parsed[1].formatted
    d = {r.conv_id: r for r in chat_events.turn_digests(chat_events.parse(rendered)).collect()}[1]
    loss = "".join(r[5] for r in rows[:-4] if r[4] == "assistant")
    assert (d.n_turns, d.loss_chars, d.loss_sha256) == (421, len(loss), sha(loss.encode())) and d.formatted_chars == len(parsed[1].formatted)


def plain_fold(log):
    """(conv_id, position) -> list of (role, text): events of each conversation in the order of their numbers."""
    convs = collections.defaultdict(dict)
    for conv, position, _, kind, role, text in sorted(log, key=lambda e: (e[0], e[2], e[3] == "delta", e[4] or "", e[5] or "")):
        state, text = convs[conv], text or ""
        if kind == "delta":
            one = state.setdefault(position, [role or "", "", False])
            one[1] += text
        elif kind == "retract":
            state.setdefault(position, ["", "", True])[2] = True
        else:
            if kind == "regenerate":
                for later in [p for p in state if p > position]:
                    del state[later]
            state[position] = [role or "", text, position in state and state[position][2]]
    return {(c, p): (r, t) for c, state in convs.items() for p, (r, t, gone) in state.items() if not gone}


def test_fold_equals_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(chat_events, "BLOCK", 4)
    rng = np.random.default_rng(6)
    log = []
    for conv in range(12):
        seq, written = 0, 0
        for _ in range(60):
            seq += 1
            kind = str(rng.choice(["message", "delta", "edit", "regenerate", "message"]))
            position = written if kind == "message" else int(rng.integers(0, max(written, 1)))
            written = max(written, position + 1) if kind != "regenerate" else position + 1
            log.append((conv, position, seq, kind, "user", f"{seq} "))
    rng.shuffle(log)
    log = [(int(c), int(p), int(s), k, r, t) for c, p, s, k, r, t in log]
    # What is appended to or edited after a regeneration dropped it was dropped as a whole message.
    alive = plain_fold(log)
    got = {(r.conv_id, r.position): (r.role, r.text) for r in chat_events.fold_events(chat(spark, log)).collect()}
    begun = {(c, p): max(s for cc, pp, s, k, *_ in log if (cc, pp) == (c, p) and k in ("message", "regenerate")) for c, p, _, k, *_ in log if k in ("message", "regenerate")}
    cut = {(c, p) for (c, p), s in begun.items() if any(cc == c and pp < p and k == "regenerate" and ss > s for cc, pp, ss, k, *_ in log)}
    assert got == {k: v for k, v in alive.items() if k not in cut}


def test_log_folds_back_to_its_turns(spark):
    texts = ["", "one", "x" * 5000, "</turn>\n<b>", "é🙂" * 40, None]
    rows = [(c, t, "assistant" if t % 2 else "user", texts[(c + t) % 6]) for c in range(30) for t in range(c % 9 + 1)]
    rows += [(50, 3, "user", "same"), (50, 3, "user", "same"), (50, 3, "assistant", "other"), (50, None, None, "no turn"), (None, 1, "user", "nobody")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_events.event_log(frame.withColumns({"seq": F.lit(1), "kind": F.lit("retract"), "way": F.lit(9)}))
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate", "retract"} and log.count() > 3 * len(rows)
    folded = chat_events.fold_events(log)
    got = sorted(((r.conv_id or -9, -9 if r.position is None else r.position / 2, r.role, r.text) for r in folded.collect() for _ in range(r.copies)))
    assert got == sorted((c or -9, -9 if t is None else t, role or "", text or "") for c, t, role, text in rows)


def test_odd_logs(spark):
    assert chat_events.render(chat_events.fold_events(chat(spark, []))).count() == 0
    ties = [(1, 0, 0, "message", "user", "a"), (1, 0, 0, "delta", None, "b"), (1, 0, 0, "delta", None, "c"), (1, None, 5, "message", "user", "n"), (1, 1, 1, "odd", "user", "whole"), (1, 0, 9, "regenerate", "user", "z")]
    got = [(r.position, r.text) for r in chat_events.fold_events(chat(spark, ties).withColumn("block", F.lit("clash")).withColumn("cut", F.lit(1))).orderBy("position").collect()]
    assert got == [(None, "n"), (0, "z")]
    tied = [(r.position, r.text) for r in chat_events.fold_events(chat(spark, ties[:3])).collect()]
    assert tied == [(0, "abc")]


# 8


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "a.b.c", ""), ("allow", "a.b.c", "/x"), ("block", "b.c", "/xy")]


def judged(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h) + len(p), len(h), a, h + p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_urls_against_every_rule(spark):
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "x.www.example.com", "myexample.com", "net", "q.net", "netz", "a.b.c", "z.a.b.c", "b.c", "", "com.", ".com", "example.com:80", "comx", "com-x.com"]
    tails = ["", "/", "/en/", "/en", "/en/x?y#z", "/es/1", "/fr/", "?q=/en/", "#/en/", "/xyz", "/x", "//en/"]
    urls = [f"http://{h}{t}" for h in hosts for t in tails] + [None, "", "no scheme", "://", "a://b://c/", "http://com/\n/en/"] + ["http://example.com/en/1"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.rule_frame(spark, RULES)).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    empty = spark.createDataFrame([], "action string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_rules.judge_urls(pages, empty, default="block").collect()] == [(None, "block")]
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_frame(spark, RULES)).count() == 0


# 9


def test_pieces_cover_every_id_once(documents, corpus):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    pieces = collections.defaultdict(list)
    every = concat_cut.pack(documents, WORD_BPE).collect()
    for r in every:
        pieces[r.doc_id].append(r)
    for i, text in corpus:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    order = sorted(every, key=lambda r: (r.sequence_id, r.offset))
    ends = np.cumsum([r.length for r in order])
    assert [r.sequence_id * 2048 + r.offset for r in order] == [0, *ends[:-1].tolist()]
    assert all(r.offset + r.length <= 2048 for r in order)


def test_pieces_hold_their_ids(documents, corpus):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    found = collections.defaultdict(list)
    for r in sorted(concat_cut.pack(documents, WORD_BPE).collect(), key=lambda r: r.start):
        ids = np.frombuffer(r.ids, f"<u{r.ids_width}")
        assert len(ids) == r.length
        found[r.doc_id] += ids.tolist()
    assert found == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus}


@pytest.mark.parametrize("text", ["A<B a<b", "<|endoftext|> <|ENDOFTEXT|>", "the, The. THE!", "3. x,y ,z .. é, ok…", "don't DON'T", "\n<mark> \n", "İ ẞ Σς ΣΣ", "e\u0301, e\u0301"])
def test_packing_ids_of_odd_texts(text):
    import pyarrow as pa

    want = [*Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids, 1]
    assert concat_cut.token_ids(pa.array([text]), WORD_BPE)[0].tolist() == want


# 10


def test_dedup_equals_all_windows(documents, corpus):
    want = deduplicated(corpus)
    for r in anchor_dedup.digests(documents).collect():
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(kept), sha(" ".join(kept).encode()))


def test_cover_aligns_any_two_positions():
    for i in range(7):
        for j in range(7):
            assert any((i + s) % 7 in anchor_dedup.COVER and (j + s) % 7 in anchor_dedup.COVER for s in range(7))


def test_repeats_inside_one_document_stay(spark):
    text = " ".join(["a b c d e f g h i j k l m n"] * 3)
    rows = spark.createDataFrame([(1, text), (2, text[:40])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in anchor_dedup.digests(rows).collect()} == {1: 0, 2: 20}
