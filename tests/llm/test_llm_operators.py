"""The training-data operators against libraries, brute force and round trips, with odd rows in every table."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from tidewatch.llm import components, cover_tree, jaccard_join, language_id, line_rules, packing, quality_net, registry, simple8b, toxicity, trie_bpe, url_filter
from tidewatch.llm.common import fresh_path, in_filter, key_filter
from tidewatch.llm.tokens import ascii_words, chunk_encoder, public_vocabulary

BYTES, WORDS = public_vocabulary("byte_bpe_50k.json"), public_vocabulary("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n", "a", "Hello, world!  Two  spaces \n and\ttabs ", "x<|endoftext|> y <|startoftext|>z", "naïve café über à la mode Σίσυφος ΟΔΥΣΣΕΥΣ İstanbul", "日本語 テキスト 123 4567",
    "éclair   nbsp em  don't we'll I'M", "a " * 3000, "word" * 2000, "😀😀 👍🏽 ​ zero‍width", "#$%& |<>|", " lead", "trail ", "́ starts with a mark",
]


def docs(spark, texts, first=0):
    """A documents table with columns whose names the operators use inside."""
    rows = [(first + i, t, "en", "s", i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def ids_of(tok, path, text):
    return tok[path].encode(text or "", add_special_tokens=False).ids


def test_all_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), sf_dir, registry.oracle_sql()[name])


# --- 1, 3, 9: tokens ----------------------------------------------------------------------------------------------


def test_chunk_encoder_equals_library(tok):
    found = {}
    for lo, hi, ids, ends in chunk_encoder(BYTES).encode(pa.array(ODD)):
        for i in range(lo, hi):
            found[i] = ids[ends[i - lo] : ends[i - lo + 1]].tolist()
    assert [found[i] for i in range(len(ODD))] == [ids_of(tok, BYTES, t) for t in ODD]


def test_trie_equals_library(tok):
    bpe = trie_bpe.trie_bpe(WORDS)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcé dTn'1,") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    for lo, hi, ids, ends in bpe.encode(pa.array(texts)):
        decoded = bpe.decode_many(ids, ends)
        for i in range(lo, hi):
            want = ids_of(tok, WORDS, texts[i])
            assert ids[ends[i - lo] : ends[i - lo + 1]].tolist() == want, texts[i]
            assert decoded[i - lo].decode() == tok[WORDS].decode(want, skip_special_tokens=False)


def test_trie_keeps_only_the_end_of_long_words(tok, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("theandofing") for _ in range(3000))
    words = [long, long[:700] + "x", long[:513], long[:512], long[:511] + "q", long[:40], long[:2000] + "the", "of"]
    bpe = trie_bpe.trie_bpe(WORDS)
    for least in (512, 8):
        monkeypatch.setattr(trie_bpe, "LONG_WORD", least)
        for lo, hi, ids, ends in bpe.encode(pa.array(words)):
            for i in range(lo, hi):
                assert ids[ends[i - lo] : ends[i - lo + 1]].tolist() == ids_of(tok, WORDS, words[i]), i


def test_trie_shares_prefixes():
    t = trie_bpe.WordTrie(["abc", "abd", "ab", "x"])
    assert len(t.parent) == 1 + 5 and t.parent[t.leaf_of["abc"]] == t.leaf_of["ab"]


def test_encode_documents(spark, tok):
    got = {r.doc_id: r for r in trie_bpe.encode_documents(docs(spark, ODD), WORDS).collect()}
    for i, t in enumerate(ODD):
        ids = ids_of(tok, WORDS, t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert trie_bpe.encode_documents(docs(spark, []), WORDS).count() == 0


def check_packing(rows, want):
    pieces = sorted(rows, key=lambda r: (r.doc_id, r.start))
    for doc, group in itertools.groupby(pieces, key=lambda r: r.doc_id):
        ids, at = want[doc], 0
        for r in group:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert {r.doc_id for r in rows} == set(want)
    sizes = {}
    for seq, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        sizes[seq] = at
    return sizes


def test_packing(spark, tok):
    texts = [*ODD, "long text " * 5000]
    want = {i: np.array([*ids_of(tok, BYTES, t), 1], "<u4") for i, t in enumerate(texts)}
    rows = packing.pack_documents(docs(spark, texts).repartition(2), BYTES).collect()
    sizes = check_packing(rows, want)
    assert max(sizes.values()) <= 2048
    assert sum(n & (n - 1) != 0 for n in sizes.values()) <= 2  # a short one for each task at most
    again = packing.pack_documents(docs(spark, ["same", "same"]).withColumn("doc_id", F.lit(7).cast("long")).coalesce(1), BYTES).collect()
    assert len(again) == 2
    assert packing.pack_documents(docs(spark, []), BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs(spark, []), BYTES, tiers=(100, 2048))


def test_packer_balances_steps():
    p = packing.TierPacker(0)
    rng = random.Random(2)
    for i in range(400):
        p.add(i, np.arange(rng.randint(1, 1500), dtype="<u4"))
    rows = p.drain(True).to_pylist()
    cost = {}
    for r in rows:
        if r["tier"] == 2048:
            cost[r["step_group"]] = cost.get(r["step_group"], 0) + r["length"] ** 2
    full = sorted(cost.values())[1:]
    assert max(full) < 1.6 * min(full)


def test_simple8b_blocks():
    rng = np.random.default_rng(0)
    for high in (1, 2, 100, 32766, 32767, 32768, 50257, 2**32 - 1):
        for n in (0, 1, 59, 60, 61, 5000):
            ids = rng.integers(0, high, n, endpoint=True).astype(np.uint32)
            words, escapes = simple8b.encode_block(ids)
            assert np.array_equal(simple8b.decode_block(words, escapes, n), ids)
    assert len(simple8b.encode_block(np.zeros(600, np.uint32))[0]) == 10


def test_token_files(spark, tok, tmp_path):
    table = docs(spark, ODD).unionByName(docs(spark, ["twin a", "twin b"]).withColumn("doc_id", F.lit(3).cast("long")))
    folder = fresh_path(spark, "t")
    manifest = simple8b.write_token_files(table, folder, BYTES, files=3).persist()
    rows = simple8b.read_token_files(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([*range(len(ODD)), 3, 3])
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id != 3:
            ids = np.array([*ids_of(tok, BYTES, ODD[r.doc_id]), 2], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    ends = spark.createDataFrame([(None, "b"), (-(2**63), "c"), (None, None), (2**63 - 1, "d"), (0, "e")], "doc_id long, text string")
    folder = fresh_path(spark, "t")
    manifest = simple8b.write_token_files(ends, folder, BYTES, files=2).persist()
    assert [r.doc_id for r in simple8b.read_token_files(manifest, folder).orderBy("start").collect()] == [None, None, -(2**63), 0, 2**63 - 1]
    none = simple8b.write_token_files(docs(spark, []), fresh_path(spark, "t"), BYTES)
    assert simple8b.read_token_files(none, "x").count() == 0


# --- 2, 7, 8: models ----------------------------------------------------------------------------------------------


def labelled(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(10, 120))]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["zzrude", "zzvile"]))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def test_toxicity_learns_and_scores_odd_texts():
    train, test = labelled(300, 1), labelled(150, 2)
    net = toxicity.fit([t for t, _ in train], [y for _, y in train])
    s = net.scores(pa.array([t for t, _ in test]))
    y = np.array([y for _, y in test])
    assert ((s >= 0.7) == y).mean() > 0.9
    odd = net.scores(pa.array(ODD, pa.string()))
    assert ((odd >= 0) & (odd <= 1)).all() and net.scores(pa.array([], pa.string())).shape == (0,)
    hidden = net.scores(pa.array(["aaa bbb " * 3000 + "zzrude zzvile zzrude" + " ccc ddd" * 3000]))
    assert hidden[0] > net.scores(pa.array(["aaa bbb " * 3000 + " ccc ddd" * 3000]))[0]  # no window is left out
    assert (toxicity.fit([], []).scores(pa.array(["x", None])) == 0.5).all()


def test_toxicity_knows_respelt_and_unseen_words():
    """Slurs with a doubled vowel, a digit for a letter or an ending, and stems with endings that training never met."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    slurs, ends = ["quorvex", "trumpox", "snorlit", "wozzum"], ["a", "be", "cid", "ha", "jig", "fe"]
    unseen = ["og", "eth", "addi", "iff"]

    def text(toxic, forms):
        words = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(forms))
        return " ".join(words)

    train = [(text(i % 3 == 0, [*slurs, *("zukka" + e for e in ends), *("prylo" + e for e in ends)]), int(i % 3 == 0)) for i in range(600)]
    net = toxicity.fit([t for t, _ in train], [y for _, y in train])
    caught = lambda forms: (net.scores(pa.array([text(True, forms) for _ in range(60)])) >= 0.7).mean()
    assert caught(slurs) > 0.95 and (net.scores(pa.array([text(False, []) for _ in range(300)])) >= 0.7).mean() < 0.03
    assert caught(["quoorvex", "truumpox", "snoorlit", "woozzum"]) > 0.9
    assert caught(["qu0rvex", "trump0x", "sn0rl1t", "w0zzum"]) > 0.9
    assert caught([w + "s" for w in slurs]) > 0.8
    assert caught([s + e for s in ("zukka", "prylo") for e in unseen]) > 0.8


def small_net(seed):
    rng = np.random.default_rng(seed)
    word_row, gram_row = rng.integers(0, 9, toxicity.WORDS), rng.integers(0, 40, toxicity.GRAMS)
    net = toxicity.ToxicNet(rng, word_row.astype(np.int32), gram_row.astype(np.int32))
    net.p = {k: rng.normal(0, 0.4, v.shape) for k, v in net.p.items()}
    return net


def test_toxicity_forward_equals_plain_loops():
    net = small_net(1)
    words = ["Hello,", "w0rld", "a", "...", "stuupid!", "Σίσυφος"]
    slots, grams, cuts = net.rows_of(words)
    text, sig = [0, 4, 1, 3, 5, 2, 1], lambda v: 1 / (1 + np.exp(-v))
    x = []
    for w in text:
        g = grams[cuts[w] : cuts[w + 1]]
        a = np.exp(net.p["salience"][g])
        x.append(np.concatenate([net.p["word"][slots[w]], sum((a[i] / a.sum() * net.p["gram"][g[i]] for i in range(len(g))), np.zeros(toxicity.CHAR_DIM))]))
    h_all, hidden = np.zeros((len(text), 2 * toxicity.HIDDEN)), toxicity.HIDDEN
    for half, d in enumerate("fb"):
        h = np.zeros(hidden)
        for t in range(len(text)) if d == "f" else reversed(range(len(text))):
            g, w = x[t] @ net.p[f"u{d}"] + net.p[f"b{d}"], net.p[f"w{d}"]
            r, z = sig(g[:hidden] + h @ w[:, :hidden]), sig(g[hidden : 2 * hidden] + h @ w[:, hidden : 2 * hidden])
            n = np.tanh(g[2 * hidden :] + (r * h) @ w[:, 2 * hidden :])
            h = z * h + (1 - z) * n
            h_all[t, half * hidden : (half + 1) * hidden] = h
    a = np.exp(h_all @ net.p["att"])
    want = (a / a.sum()) @ h_all @ net.p["out"] + net.p["c"][0]
    got, n = net.document_logits(pa.array([" ".join(words[w] for w in text)]))
    assert n.tolist() == [1] and got[0] == pytest.approx(want, abs=1e-4)


def test_toxicity_gradients_equal_finite_differences():
    net = small_net(2)
    parts = net.rows_of(["one", "two", "threefold", "!!", "fivestars"])
    steps, mask = np.array([[0, 3], [2, 1], [4, 5], [1, 5]]), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = np.array([1.0, 0.0])

    def loss():
        z = net.run(net.inputs(*parts).astype(np.float64), steps, mask).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g, rng = net.gradients(parts, steps, mask, y), np.random.default_rng(3)
    for name, p in net.p.items():
        for at in rng.choice(p.size, min(p.size, 12), replace=False):
            cell, before = np.unravel_index(at, p.shape), p.flat[at]
            p[cell] = before + 1e-2
            up = loss()
            p[cell] = before - 1e-2
            down = loss()
            p[cell] = before
            assert g[name][cell] == pytest.approx((up - down) / 2e-2, abs=2e-3), name


def test_toxicity_scores_tables(spark):
    """Null ids, repeated rows, clashing columns, an empty table, and labels that contradict each other."""
    texts = [t for t, _ in labelled(60, 5)]
    d = docs(spark, [*ODD, *texts])
    d = d.unionByName(d.limit(3)).unionByName(docs(spark, [None, "x"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(len(ODD) + i, int(i % 3 == 0), 1) for i in range(60)] + [(len(ODD), 0, 1), (None, 1, 1), (len(ODD) + 1, None, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int, score int")
    net = toxicity.train(d, labels)
    got = toxicity.score_documents(d, net).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1) for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert toxicity.score_documents(d.limit(0), net).count() == 0
    none = toxicity.train(d, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(d, none).collect()} == {0.5}


def test_toxicity_holds_the_window_term_beyond_the_fit():
    net = toxicity.fit([f"word{i} other " * (20 + i) for i in range(60)], [i % 2 for i in range(60)])
    net.curve = np.array([0.0, -1.0, 0.0])
    short, long, longer = net.scores(pa.array(["a", "word " * 5000, "word " * 20000]))
    assert short == 0.5 and 0 < long == longer and 1 / (1 + net.most_windows) == pytest.approx(long)


def test_toxic_filter_keeps_columns(spark):
    net = toxicity.fit([], [])
    d = docs(spark, ODD)
    assert toxicity.drop_toxic(d, net).columns == d.columns and toxicity.drop_toxic(d, net).count() == len(ODD)
    assert toxicity.drop_toxic(d.withColumn("a.b", F.lit(1)), net).columns == [*d.columns, "a.b"]
    net.curve[2] = 50.0
    assert toxicity.drop_toxic(d, net).count() == 0


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 84, 85, 1000):
        first, length, doc = toxicity.windows_of(np.array([0, n]))
        seen = {w for f, k in zip(first, length, strict=True) for w in range(f, f + k)}
        assert seen == set(range(n)) and set(doc) == {0}


def test_language_id(spark):
    en, de = ["the cat and the dog are here"] * 1, ["der hund und die katze sind hier"]
    texts = [en[0] + f" n{i}" for i in range(30)] + [de[0] + f" n{i}" for i in range(30)]
    model = language_id.fit(texts, ["en"] * 30 + ["de"] * 30)
    lang, score = model.predict(["the dog", "die katze", None, "", "123 !!", "THE CAT " * 40000])
    assert lang == ["en", "de", "und", "und", "und", "en"] and (score[2:5] == 0).all() and ((score >= 0) & (score <= 1)).all()
    marks = ["½", "²", "①", "Ⅷ", "५", "𝟘", "—", "ª", "日", "\U00030000"]
    assert [language_id.has_letter(x) for x in marks] == [any(c.isalpha() for c in x) for x in marks] and model.predict(["½", "Ⅷ 12"])[0] == ["und", "und"]
    long = "the dog and the cat " * 20000  # over one block: the same as its shares say
    assert np.allclose(model.logits([long]), model.logits([long[: len(long) // 2]]), atol=1e-3)
    assert np.mean(model.weights == 0) > 0.5
    assert language_id.fit([], []).predict(["x"])[0] == ["und"]
    got = language_id.predict_languages(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_id_updates_equal_plain_ftrl(monkeypatch):
    """The weights after one pass against the same updates written out for single features."""
    monkeypatch.setattr(language_id, "EPOCHS", 1)
    texts, labels = ["der hund", "the dog", "die katze und", "a cat and", "der und die"], ["de", "en", "de", "en", "de"]
    model = language_id.fit(texts, labels)
    order = np.random.default_rng(7).permutation(5).tolist()
    rows = [language_id.features(x) for x in texts]
    df = {}
    for f, _ in rows:
        for j in f.tolist():
            df[j] = df.get(j, 0) + 1
    idf = {j: np.log(6 / (1 + c)) + 1 for j, c in df.items()}
    z, n = {}, {}

    def weight(j, k):
        v = z.get((j, k), 0.0)
        return 0.0 if abs(v) <= language_id.L1 else -(v - np.sign(v) * language_id.L1) / ((language_id.BETA + np.sqrt(n.get((j, k), 0.0))) / language_id.ALPHA + language_id.L2)

    for i in order:
        x = {int(j): s * idf[int(j)] * language_id.SCALE for j, s in zip(*rows[i], strict=True)} | {"bias": 1.0}
        w = {(j, k): weight(j, k) for j in x for k in (0, 1)}
        s = [sum(x[j] * w[j, k] for j in x) for k in (0, 1)]
        p = np.exp(np.array(s) - max(s))
        p /= p.sum()
        for k in (0, 1):
            for j in x:
                g = x[j] * (p[k] - (labels[i] == ("de", "en")[k]))
                old = n.get((j, k), 0.0)
                z[j, k] = z.get((j, k), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / language_id.ALPHA * w[j, k]
                n[j, k] = old + g * g
    for j in df:
        assert model.weights[j].tolist() == pytest.approx([weight(j, k) * idf[j] * language_id.SCALE for k in (0, 1)], rel=1e-4, abs=1e-4)
    assert model.bias.tolist() == pytest.approx([weight("bias", 0), weight("bias", 1)])


def test_quality_net_forward_and_gradients():
    rng = np.random.default_rng(4)
    net = quality_net.ByteNet(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [b"a short text", bytes(rng.integers(32, 127, 1100, dtype=np.uint8)), b""]
    for text in texts:  # filters over all chunks, in loops
        best = []
        for c in quality_net.chunks(text):
            e = net.p["e"][c]
            at = [e[i : i + quality_net.WIDTH].ravel() @ net.p["w"] + net.p["b"] for i in range(0, quality_net.CHUNK - quality_net.WIDTH + 1, quality_net.STRIDE)]
            best.append(np.maximum(np.max(at, axis=0), 0))
        u = np.concatenate([np.mean(best, axis=0), np.max(best, axis=0)])
        assert net.logits([text])[0] == pytest.approx(u @ net.p["v"] + net.p["c"][0], rel=1e-5)
    docs_, y = [quality_net.chunks(t) for t in texts[:2]], np.array([1.0, 0.0])

    def loss():
        z = net.logits(texts[:2])
        return float(np.mean(np.logaddexp(0, z) - y * z)) + 0.5e-4 * float((net.p["v"] ** 2).sum())

    g = net.gradients(docs_, y)
    for name, p in net.p.items():
        spots = [i for i in rng.permutation(p.size)[:14] if name != "e" or i >= p.shape[1]]  # the padding's row stays zero
        for i in spots:
            cell, before = np.unravel_index(i, p.shape), p.flat[i]
            p[cell] = before + 1e-5
            up = loss()
            p[cell] = before - 1e-5
            down = loss()
            p[cell] = before
            assert g[name][cell] == pytest.approx((up - down) / 2e-5, abs=2e-4), name


def test_models_on_odd_tables(spark):
    """Null ids and texts, repeated rows, clashing columns, an empty table: one row for each, the same result for equal rows."""
    texts = [t for t, _ in labelled(40, 6)]
    d = docs(spark, [*ODD, *texts]).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")))
    d = d.unionByName(d.limit(4)).unionByName(d.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("a.b", F.lit(1))
    labels = spark.createDataFrame([(len(ODD) + i, i % 2, "x") for i in range(40)] + [(len(ODD), 1, "x"), (None, 1, "x")], "doc_id long, quality int, held_out string")
    for rows, key in ((quality_net.score_documents(d, quality_net.train(d, labels)), "score"), (language_id.predict_languages(d, language_id.train(d)), "lang_pred")):
        got = rows.collect()
        assert len(got) == d.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) and 0 <= r.score <= 1 for r in got)
        assert len({r[key] for r in got if r.doc_id == 0}) == 1
    assert all(r.predicted == (r.score >= 0.3) for r in quality_net.score_documents(d, quality_net.train(d, labels)).collect())
    assert quality_net.score_documents(d.limit(0), quality_net.train(d.limit(0), labels)).count() == 0
    assert language_id.predict_languages(d.limit(0), language_id.train(d.limit(0))).count() == 0
    nulls = docs(spark, ["x", None]).withColumn("doc_id", F.lit(None).cast("long"))
    assert packing.pack_documents(nulls, BYTES).count() == 2 and trie_bpe.encode_documents(nulls, WORDS).where("doc_id IS NULL").count() == 2


def test_quality_net():
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    bad = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + "%%%" for _ in range(80))
    texts = [good() for _ in range(80)] + [bad() for _ in range(80)]
    net = quality_net.fit(texts, [1] * 80 + [0] * 80, {0: 80, 1: 80})
    s = net.scores([good() for _ in range(20)] + [bad() for _ in range(20)])
    assert (s[:20] > 0.5).mean() > 0.9 and (s[20:] < 0.5).mean() > 0.9
    odd = net.scores(ODD)
    assert ((odd >= 0) & (odd <= 1)).all()
    assert (quality_net.fit([], [], {}).scores(["x"]) == 0.5).all()
    many, one = net.scores([*texts[:3], *ODD]), np.array([net.scores([t])[0] for t in [*texts[:3], *ODD]])
    assert np.allclose(many, one, atol=1e-5)  # blocks of a batch don't matter
    for n in (0, 1, 512, 513, 896, 897, 5000):
        c = quality_net.chunks(b"a" * n)
        assert (c != 0).sum() >= n and c.shape[1] == quality_net.CHUNK


# --- 4: urls --------------------------------------------------------------------------------------------------------


def test_url_rules_and_reputation(spark):
    rows = [
        (1, "http://A.B.net/x?y", None), (2, "https://x.example.net/en/1", 0), (3, "https://example.com/de/", 0), (4, "http://myexample.com/de/", 0), (5, "http://w.org/fr/a#b", 0), (6, None, 1), (7, "no scheme", 0), (8, "http://a.net", 0),
        *[(100 + i, f"http://bad.host.com/{i}", 1) for i in range(40)], *[(200 + i, f"http://good.host.com/{i}", 0) for i in range(40)], *[(300 + i, f"http://new{i}.fresh.com/", 0) for i in range(20)],
    ]
    p = spark.createDataFrame(rows, "page_id long, url string, outcome int")
    got = {r.page_id: r for r in url_filter.judge_urls(p, url_filter.RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.b.net", "/x", "net/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.net/en/", "allow") and got[3].verdict == "block" and got[4].rule is None
    assert got[5].verdict == "allow" and (got[6].host, got[6].path) == ("", "") and got[7].host == "" and got[8].rule is None
    assert {got[100 + i].verdict for i in range(40)} == {"block"} and {got[200 + i].verdict for i in range(40)} == {"allow"}
    low = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame([("a.x.com", 1), ("b.x.com", None), ("c.y.com", 0)], "host string, outcome int")).collect()}
    assert 0 < low["b.x.com"].rate < low["a.x.com"].rate and low["a.x.com"].low < low["a.x.com"].rate
    assert url_filter.judge_urls(p.limit(0), url_filter.RULES).count() == 0
    by_key = {(r.page_id, r.verdict) for r in url_filter.judge_urls(p, url_filter.RULES, broadcast_rows=1, heavy=30).collect()}
    assert by_key == {(k, r.verdict) for k, r in got.items()} and {v for _, v in by_key} == {"allow", "block"}


def reputation_by_hand(pages):
    """Posterior rate and lower bound of each host, in plain loops. pages: (host, outcome)."""
    def split(host):
        parts = host.split(".")
        if re.match(r"^\d+(\.\d+){3}$", host):
            return host, ""
        k = 2 if len(parts) > 2 and ".".join(parts[-2:]) in url_filter.SECOND_LEVEL else 1
        return ".".join(parts[-k - 1 :]), ".".join(parts[-k:])

    n, bad = {}, {}
    for host, y in pages:
        domain, suffix = split(host)
        for key in (("host", host), ("domain", domain), ("suffix", suffix)):
            n[key], bad[key] = n.get(key, 0) + (y is not None), bad.get(key, 0) + (y or 0)
    strength, total = {}, sum(y is not None for _, y in pages)
    mean = sum(y or 0 for _, y in pages) / total
    for level in ("suffix", "domain", "host"):
        keys = [k for k in n if k[0] == level and n[k]]
        spread = sum(bad[k] ** 2 / n[k] for k in keys) / total - mean**2 - mean * (1 - mean) * len(keys) / total
        strength[level] = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
    out = {}
    for host in {h for h, _ in pages}:
        domain, suffix = split(host)
        rate = mean
        for level, key in (("suffix", suffix), ("domain", domain), ("host", host)):
            a, b = bad[level, key] + strength[level] * rate, n[level, key] - bad[level, key] + strength[level] * (1 - rate)
            rate = a / (a + b)
        out[host] = (rate, rate - url_filter.Z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)
    return out, mean


def test_shrinkage_changes_verdicts(spark):
    """Small hosts take after their domain: one bad page doesn't block a host of a good domain, and no page of a bad one is needed."""
    pages = [(f"h{i}.good.com", int(i % 50 == 0)) for i in range(200) for _ in range(3)] + [(f"h{i}.bad.com", 1) for i in range(60)] + [("one.good.com", 1), ("new.bad.com", None), ("shop.co.uk", 1), ("a.shop.co.uk", 0), ("10.0.0.1", 1), ("192.168.0.1", 0)]
    table = spark.createDataFrame(pages, "host string, outcome int")
    got = {r.host: r for r in url_filter.host_reputation(table).collect()}
    want, mean = reputation_by_hand(pages)
    assert got.keys() == want.keys()
    for host, (rate, low) in want.items():
        assert (got[host].rate, got[host].low, got[host].overall) == pytest.approx((rate, low, mean)), host
    urls = table.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://"), "host", F.lit("/")).alias("url"), "outcome")
    verdict = {r.host: r.verdict for r in url_filter.judge_urls(urls, {}).collect()}
    # one bad page of one, a raw rate far above the mean, isn't enough; three of three are
    assert 1.0 > 4 * mean and verdict["one.good.com"] == "allow" and verdict["h0.good.com"] == "block"
    assert verdict["new.bad.com"] == "block" and verdict["h3.bad.com"] == "block" and verdict["h3.good.com"] == "allow"


def test_url_filter_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "http://a.com/", "<p>$$$$$</p>", "y"), (2, "HTTP://A.com?q", "", "z"), (3, "://", None, "w")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("verdict", F.lit("v"))
    out = url_filter.judge_urls(d.select("page_id", "url", url_filter.symbol_outcome(F.col("html")).alias("outcome")), url_filter.RULES)
    assert sorted((r.host, r.path, r.rule is None) for r in out.collect()) == [("", "", True)] * 3 + [("a.com", "", True), ("a.com", "/", True)]


# --- 5: joins -------------------------------------------------------------------------------------------------------


def brute(texts, k, num):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts():
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefàé") for _ in range(5))
    texts = list(ODD)
    passage = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy if rng.random() < 0.7 else copy + passage))
    return texts + ["Same Text here", "same text HERE", "a", "A", None, ""]


@pytest.mark.parametrize("short", [1, 3, 24])
def test_jaccard_components_and_keep_one(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 3)  # so that lists are cut and blocks meet
    texts = near_texts()
    d = docs(spark, texts).repartition(3)
    d = d.unionByName(docs(spark, [None]).withColumn("doc_id", F.lit(None).cast("long")))
    found = jaccard_join.jaccard_components(d).persist()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got.pop(None) == (0, None)
    assert [got[i] for i in range(len(texts))] == brute(texts, 4, 85)
    kept = jaccard_join.keep_one(d, found)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in brute(texts, 4, 85)})


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 2**63, int(rng.integers(0, 30)), dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        links = common > 0 and 100 * common >= 85 * (len(x) + len(y) - common)
        a, b = jaccard_join._bitmaps([jaccard_join.parity_bitmap(v) for v in (x, y)])
        assert not links or jaccard_join._may_link(a, b, len(x), len(y), 85)


def test_bitmaps_of_large_sets_reject():
    rng = np.random.default_rng(9)
    for n in (300, 2000, 6000, 30000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 2**63, n // 2, dtype=np.uint64)]))  # a third in common
        a, b = jaccard_join._bitmaps([jaccard_join.parity_bitmap(v) for v in (x, y)])
        assert not jaccard_join._may_link(a, b, len(x), len(y), 85)


def test_group_of_near_copies_leaves_tasks_in_few_rows(spark, monkeypatch):
    """400 copies of one base, each with some words of its own, so that similarities lie around the threshold."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(300), 2 + i % 9):
            copy[at] = word()
        texts.append(" ".join(copy))
    rows = {}

    def counted(df, tag, real=jaccard_join.stash):
        out = real(df, tag)
        rows[tag] = max(rows.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stash", counted)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 64)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 100_000)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs(spark, texts).repartition(4)).collect()}
    want = brute(texts, 4, 85)
    assert [got[i] for i in range(400)] == [c for _, c in want] and 1 < len({c for _, c in want}) < 400
    assert rows["far"] <= 4 * 400 and rows["partnered"] <= 4 * rows["spanning"] and rows["pivot-pairs"] < 4000  # all pairs are 79800


def test_jaccard_of_long_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 60_000)
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(5000)]
    texts = []
    for share in (0.0, 0.01, 0.01, 0.018, 0.02, 0.021, 0.03, 0.04, 0.06, 0.2):
        texts.append(" ".join(word() if rng.random() < share else w for w in base))
    texts += [" ".join(base[: int(5000 * cut)]) for cut in (0.97, 0.9, 0.86, 0.84, 0.7)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 4, 85)


def test_jaccard_rows_of_one_id(spark):
    """Rows that share an id are one document: its texts' classes are one component."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a, b, c = (" ".join(word() for _ in range(60)) for _ in range(3))
    table = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b), (4, c), (4, c), (5, c + " more")] + [(6, None)] * 2, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(table).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}


def test_keep_one_with_odd_columns(spark):
    d = spark.createDataFrame([(1, "b", 1, 2), (1, "a", 3, 4), (2, "a b", 5, 6), (None, "x", 7, 8), (None, "x", 7, 8)], "doc_id long, text string, `a.b` int, key int")
    found = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, None), (None, None)], "doc_id long, component_id long")
    kept = jaccard_join.keep_one(d, found)
    assert kept.columns == d.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "a", 3, 4), (None, "x", 7, 8), (None, "x", 7, 8)], key=repr)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0


def test_prefix_choice_is_lossless():
    for n in range(1, 60):
        for num in (80, 85):
            l, size = jaccard_join.choose_prefix(np.zeros(n, np.uint8), n, num)
            least = jaccard_join.least_overlap(n, num)
            assert 1 <= l <= least and size == n - least + l


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.u: r.v for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    with pytest.raises(RuntimeError, match="still change"):
        components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(100)], "u long, v long"), most=1)


def test_small_graphs_are_joined_by_the_driver(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(280)] + [(2**62 - i, 2**62 - i - 1) for i in range(150)] + [(900, 900)]
    df = spark.createDataFrame(edges, "u long, v long")
    rows = lambda found: sorted((r.u, r.v) for r in found.collect())
    want = rows(components.connected_components(df))
    assert rows(components.components(df)) == want and rows(components.components(df, 10)) == want
    assert components.components(df.limit(0)).count() == 0


def test_near_duplicates_of_a_small_table_take_few_jobs(spark):
    words = [f"w{i}" for i in range(260)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 200])) for i in range(60)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("near", "near")
    try:
        got = jaccard_join.jaccard_components(docs, 5, 80).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.component_id for r in got} == {0} and len(got) == 60
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near")) < 110


def test_key_filter_has_no_false_negatives(spark):
    keys = [7, -1, 2**62, -(2**63), 0]
    bitmap = key_filter(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long"), "k", 12)
    assert in_filter(bitmap, np.array(keys, np.int64).view(np.uint64)).all() and bitmap.nbytes == 512


def test_ascii_words():
    words, codes, offsets = ascii_words(pa.array(ODD, pa.string()))
    for i, t in enumerate(ODD):
        assert [words[c] for c in codes[offsets[i] : offsets[i + 1]]] == re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- 6: search ------------------------------------------------------------------------------------------------------


def search_all(points, ids, every=20, k=5, kind=np.float32):
    """The k best of every 20th point by the dual-tree search, and the share of scores computed."""
    data, asked = cover_tree.CoverTree(points, ids), cover_tree.CoverTree(points[::every], ids[::every], cover_tree.QUERY_LEAF, cover_tree.QUERY_BALL)
    data.points, asked.points = data.points.astype(kind), asked.points.astype(kind)
    best = cover_tree.TopK(len(asked.ids), k)
    cover_tree.seed(asked, data.points, data.ids, best)
    done = cover_tree.dual_search(asked, data, best)
    return asked, best, done / (len(asked.ids) * len(ids))


def assert_best(points, ids, asked, best, k=5):
    whole = points.astype(np.int64).astype(object)
    for row, q in enumerate(asked.ids):
        s = whole @ asked.points[row].astype(np.int64).astype(object)
        want = sorted((-s[i], ids[i]) for i in range(len(points)) if ids[i] != q)[:k]
        assert [(-a, b) for a, b in zip(best.score[row].tolist(), best.id[row].tolist(), strict=True)] == want


def clustered(rng, n=1400, width=8):
    return np.concatenate([rng.integers(-60, 60, (n // 2, width)) + c for c in ([0] * width, [400] * width)] + [np.tile([5] * width, (120, 1))]).astype(float)


def test_cover_tree_covers_separates_and_nests():
    rng = np.random.default_rng(3)
    points = np.concatenate([clustered(rng), rng.integers(-3, 3, (900, 8)) + rng.integers(-200, 200, (30, 8)).repeat(30, axis=0)])
    ids = rng.permutation(len(points)).astype(np.int64)
    tree = cover_tree.CoverTree(points, ids)
    assert sorted(tree.ids.tolist()) == list(range(len(points))) and tree.low[0] == 0 and tree.high[0] == len(points)
    far = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
    split = 0
    for node, kids in enumerate(tree.kids):
        assert far(tree.points[tree.low[node] : tree.high[node]], tree.centres[node]).max() <= tree.radius[node] * (1 + 1e-9) + 1e-9  # covers
        if not len(kids):
            continue
        assert np.array_equal(np.sort(tree.low[kids])[1:], np.sort(tree.high[kids])[:-1])  # its kids share its points out
        balls = [x for x in kids if np.isfinite(tree.scale[x]) and tree.scale[x] < min(tree.scale[node], tree.radius[node])]
        split += len(balls)
        for x in balls:
            assert tree.radius[x] <= tree.scale[x] + 1e-9 <= min(tree.scale[node], tree.radius[node]) / cover_tree.BASE + 1e-6
            assert all(far(tree.centres[x], tree.centres[y]) > tree.scale[x] for y in balls if x != y)  # separation
        assert any((tree.centres[x] == tree.centres[node]).all() for x in kids)  # nesting
    assert split > 30 and max(tree.high[tree.leaf] - tree.low[tree.leaf]) < 700


def test_dual_search_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    tight = (rng.integers(-4, 5, (40, 16)).repeat(60, axis=0) * 100 + rng.integers(-5, 6, (2400, 16))).astype(float)  # many small clusters
    for points, most in ((clustered(rng), 0.8), (tight, 0.3), (rng.integers(-9, 9, (700, 3)).astype(float), 0.9), (rng.normal(0, 40, (900, 64)).round(), 1.0), (np.zeros((90, 4)), 1.0), (np.ones((3, 2)), 1.0)):
        ids = rng.permutation(len(points)).astype(np.int64)
        if len(points) == 700:
            ids[::7] = ids[0]  # repeated ids
        asked, best, share = search_all(points, ids)
        assert share <= most, len(points)
        if len(points) > 5:
            assert_best(points, ids, asked, best)
    huge = rng.integers(-(2**28), 2**28, (300, 4)).astype(float)
    ids = np.arange(300)
    assert_best(huge, ids, *search_all(huge, ids, kind=np.int64)[:2])


def test_top_k_odd_rows(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, []), (4, [0.1, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in cover_tree.top_k(df).collect())
    assert got == [(0, 1, 1, 128 * 128 + 64 * 64), (0, 2, 50, 128 * 128 + 64 * 64), (50, 1, 0, 128 * 128 + 64 * 64), (50, 2, 1, 128 * 128 + 64 * 64)]
    assert cover_tree.top_k(df.limit(0)).count() == 0
    assert cover_tree.top_k(df.where("vec_id = 1")).count() == 0  # no queries


def test_top_k_in_blocks(spark, monkeypatch):
    """Many small blocks of queries and candidates, vectors of several lengths, a query's id on many rows."""
    monkeypatch.setattr(cover_tree, "HELD_BYTES", 20_000)
    rng = np.random.default_rng(17)
    rows = [(int(i if i % 3 else 50 * (i % 4)), rng.integers(-128, 128, 6 if i % 5 else 3).astype(float) / 256) for i in range(600)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in cover_tree.top_k(df.repartition(3), query_block=16, data_block=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for q, found in got.items():
        own = [np.floor(256 * v) for i, v in rows if i == q]
        want = sorted((-int(v @ np.floor(256 * w)), i) for v in own for i, w in rows if i != q and len(w) == len(v))[:5]
        assert [(s, i) for _, s, i in sorted(found)] == want
    assert set(got) == {i for i, _ in rows if i % 50 == 0}


# --- 10: lines ------------------------------------------------------------------------------------------------------


def test_line_rules(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    menu = "\n".join(f"Menu entry {prose(8)} {c}" for c in "abcdefgh")
    texts = [*ODD]
    texts += [f"{menu}\n{prose(60)}" for _ in range(40)]  # most words are the menu's
    texts += [f"Short FOOTER 12\n{prose(80)}" for _ in range(40)]
    copy = "\n".join(prose(20) for _ in range(5))
    texts += [copy] * 50  # copies aren't templates
    d = docs(spark, texts)
    r = {x.doc_id: x for x in line_rules.quality_rules(d).collect()}
    n = len(ODD)
    assert len(r) == len(texts)
    assert not any(r[i].kept for i in range(n, n + 40)) and not any(r[i].base_failed for i in range(n, n + 40))
    assert all(r[i].kept and r[i].n_removed_words == 3 for i in range(n + 40, n + 80))
    assert all(r[i].kept for i in range(n + 80, n + 130))
    assert r[0].n_words == 0 and r[0].base_failed and not r[0].kept
    loop = r[ODD.index("a " * 3000)]
    assert loop.n_words == 3000 and loop.n_repeat_words == 3000
    kept = line_rules.keep_good(d)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i in r if r[i].kept)
    assert line_rules.quality_rules(docs(spark, [])).count() == 0


def test_repeated_lines_count_whole_documents(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    cookie, legal, short = prose(60), prose(50), "short footer"
    texts = [f"{cookie}\n{prose(20)}\n{legal}\n{prose(20)}\n{short}" for _ in range(40)]  # both template lines are longer than the content
    r = {x.doc_id: x for x in line_rules.quality_rules(docs(spark, texts)).collect()}
    assert all(x.n_removed_words == 112 and not x.kept for x in r.values())
    # copies of one document neither make a line repeated nor hide one
    page = f"{prose(60)}\n{short}"
    texts = [f"{prose(60)}\n{short}" for _ in range(40)] + [page] * 200
    r = line_rules.quality_rules(docs(spark, texts)).collect()
    assert len(r) == 240 and all(x.n_removed_words == 2 and x.kept for x in r)


def test_copies_do_not_raise_the_share(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = [f"{prose(60)}\nshort footer" for _ in range(40)] + [prose(60)] * 60  # 40 of 41 documents, 40 of 100 rows
    r = {x.doc_id: x for x in line_rules.quality_rules(docs(spark, texts), max_share=0.5).collect()}
    assert all(r[i].n_removed_words == (2 if i < 40 else 0) for i in range(100))


def test_kept_texts_lose_their_repeated_lines(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    bodies = [(prose(60), prose(30)) for _ in range(40)]
    texts = [f"Menu  {i % 10}\n\n{a}\r\nmenu {i % 10}\n{b}\nFOOTER" for i, (a, b) in enumerate(bodies)]
    plain = f"{prose(60)}\n\n{prose(60)}\n"
    d = docs(spark, [*texts, plain, None])
    got = {r.doc_id: r for r in line_rules.keep_good(d).collect()}
    assert sorted(got) == list(range(41))
    assert [got[i].text for i in range(40)] == [f"\n{a}\r\n{b}" for a, b in bodies] and got[40].text == plain
    before = {r.doc_id: r for r in line_rules.quality_rules(d).collect()}
    assert all(len(texts[i].split()) - len(got[i].text.split()) == before[i].n_removed_words == 5 for i in range(40))
    assert got[7].n_chars == 7 and got[7].score == "x"


def test_many_repeated_lines_are_joined_by_key(spark, monkeypatch):
    rng = random.Random(18)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    d = docs(spark, [f"{prose(60)}\nshort footer\n{'other menu' if i % 2 else prose(2)}" for i in range(60)])
    lines = line_rules.parsed_lines(d.select("doc_id", "text", F.col("source").alias("host")))
    hot = line_rules.repeated_lines(lines)
    want = sorted(map(str, line_rules.removed_lines(lines, hot).collect()))
    assert len(want) == 60 and sorted(r.held for r in hot.collect()) == [30, 60]
    assert want == sorted(map(str, line_rules.removed_lines(lines, hot, broadcast_rows=1, heavy=40).collect()))
    assert want == sorted(map(str, line_rules.removed_lines(lines, hot, broadcast_rows=0, heavy=40).collect()))


def test_columns_with_dots_are_kept(spark):
    d = docs(spark, ["some words " * 40, "too few"]).withColumn("a.b", F.lit(3)).withColumn("places", F.lit("p")).withColumn("cut", F.lit("c"))
    (row,) = line_rules.keep_good(d, max_docs=1).collect() or [None]
    assert row is None or row["a.b"] == 3
    kept = line_rules.keep_good(d.withColumn("text", F.concat("text", F.lit(" "), F.expr("array_join(transform(sequence(1, 80), i -> concat('w', doc_id, 'x', i)), ' ')"))))
    assert kept.columns == d.columns and {(r["a.b"], r.places, r.cut) for r in kept.collect()} == {(3, "p", "c")}


def test_repeated_rows_get_the_same_verdict(spark):
    d = docs(spark, ["some words " * 40, "some words " * 40]).withColumn("doc_id", F.lit(1).cast("long"))
    rows = line_rules.quality_rules(d.unionByName(d.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(rows) == 4 and len({(x.kept, x.n_words) for x in rows}) == 1
