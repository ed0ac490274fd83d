"""Text operators against brute force, and on awkward and empty tables."""

import gc
import hashlib
import itertools
import random
import re
import struct
import tracemalloc
import weakref

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quireflow.llm import bpe, langid, pii, secrets, simhash, suffixes, toxicity

N = 10


# -- toxicity and language -------------------------------------------------------------------------------------------

LANGS = {"aa": "lorem ipsum dolor amet", "bb": "quick brown zebra fox", "cc": "wielki kapusta chrzan"}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = list(LANGS)[i % 3]
        words = [rng.choice(LANGS[lang].split()) + rng.choice(["", "um", "ing"]) for _ in range(rng.randint(8, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit"]))
        rows.append((i, " ".join(words), lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_language_accuracy_on_held_out_rows(labelled):
    model = langid.fit(labelled.where("doc_id % 4 <> 2"))
    got = langid.predict(labelled.where("doc_id % 4 = 2"), model, keep=("doc_id", "lang")).collect()
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in got)


def test_language_weights_are_sparse(labelled):
    assert (langid.fit(labelled).weights == 0).mean() > 0.5


def test_language_on_awkward_rows(awkward, empty, labelled):
    rows = langid.predict(awkward, langid.fit(labelled)).collect()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert len(rows) == N and {1, 2, 3, 4} <= und and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward, None).collect()} == {"und"}


def test_ngrams_of_long_texts_do_not_depend_on_windows():
    text = "abcde " * 400_000
    idx, counts = langid.ngram_counts(text)
    assert counts.sum() == sum(len(text) + 2 - n + 1 for n in (1, 2, 3))


def test_toxicity_on_held_out_rows_and_misspellings(spark, labelled):
    model = toxicity.fit(labelled.where("doc_id % 5 <> 1"), labelled.select("doc_id", "toxic").where("doc_id % 5 <> 1"))
    got = toxicity.score(labelled.where("doc_id % 5 = 1"), model, keep=("doc_id", "toxic")).collect()
    low, high = max(r["score"] for r in got if not r["toxic"]), min(r["score"] for r in got if r["toxic"])
    assert low < high and sum((r["score"] >= 0.7) == (r["toxic"] == 1) for r in got) >= 0.9 * len(got), (low, high)
    seen = model.margins()
    assert seen[toxicity.subwords("blokhead")].mean() > seen[toxicity.subwords("brown")].mean()


def test_margins_of_many_words_are_the_means_of_their_subwords(monkeypatch):
    of_bucket = np.random.default_rng(3).normal(0, 1, 1 << toxicity.BUCKET_BITS).astype(np.float32)
    words = ["a", "ab", "abc", "word", "é", "naïveté", "日本語テキスト", "😀x𝒳𝒴𝒵", "a\ud800b", "ß\uffffz", "y" * 9_999, "z" * 10_001, "ΣΑΣ"]
    assert toxicity.Margins(of_bucket).of_words(words).tolist() == [pytest.approx(of_bucket[toxicity.subwords(w)].mean(dtype=np.float64), rel=1e-12) for w in words]
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 5)
    monkeypatch.setattr(toxicity, "BATCH_WORDS", 4)
    texts = ["", " . ", "one two three four", "one " * 9 + "blockhead nitwit five six seven eight nine ten", "é 日本語 😀"]
    want = []
    for text in texts:
        found = toxicity.WORD.findall(text)
        parts = np.split(np.array(found), toxicity.bounds(len(found))[1:]) if found else []
        want.append(max((np.mean([of_bucket[toxicity.subwords(w)].mean(dtype=np.float64) for w in p]) for p in parts), default=0.0))
    assert toxicity.Margins(of_bucket).of_texts(texts) == pytest.approx(want, rel=1e-12)


def test_toxicity_on_awkward_rows(awkward, empty, labelled):
    model = toxicity.fit(labelled, labelled.select("doc_id", "toxic"))
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == N and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.fit(empty, empty.selectExpr("doc_id", "1 as toxic")) is None
    assert {r["score"] for r in toxicity.score(awkward, None).collect()} == {0.0} and toxicity.score(empty, model).count() == 0


# -- tokens ------------------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coders():
    reference = Tokenizer.from_file(PATH)
    reference.no_truncation()
    reference.no_padding()
    return reference, bpe.Encoder(bpe.Tokenizer.load(PATH))


def agree(coders, text):
    reference, own = coders
    ids = reference.encode(text, add_special_tokens=False).ids
    packed, decoded = own.encode(text)
    assert (list(struct.unpack(f"<{len(packed) // 4}I", packed)), decoded) == (ids, reference.decode(ids, skip_special_tokens=False)), text


def test_tokens_of_many_texts(coders):
    rng = random.Random(5)
    vocabulary = [t.removesuffix("</w>") for t in coders[1].auto.by_text]
    odd = ["é", "é", "İ", "Σ", "ß", "中", "가", "😀", "‍", "\xa0", "\x85", "　", "'s", "'LL", "½", "\x1c", "\x00", "<|endoftext|>", "<|startoftext|>", "<|", " ", "\n", "a", "Z", "9", "_", "﻿"]
    for n in range(400):
        agree(coders, "".join(rng.choices("aabcdefghinnoorstttheeely", k=rng.randint(1, 25))))
        agree(coders, "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4))))
        agree(coders, "".join(rng.choices(odd, k=rng.randint(0, 12))))
        agree(coders, "ab"[n % 2] * (n % 40))


def test_tokens_of_all_code_points(coders):
    """Between letters and alone, also those that are newer than this Python's tables."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 199):
        agree(coders, "".join(f"a{chr(c)}B {chr(c)}" for c in points[at : at + 1]))
    for c in (0x558, 0x58B, 0x88F, 0xC5C, 0x1C89, 0x208F, 0xA7CB, 0x1E5D0, 0x378):
        agree(coders, f"x{chr(c)}\u0301Y  {chr(c)}<|endoftext|>{chr(c)}{chr(c)} 's")


def test_no_transition_joins_what_a_merge_would_join(coders):
    auto = coders[1].auto
    assert not any(auto.may_follow(u, v) for u, v in list(auto.taken)[:2000])


def test_tokens_on_awkward_rows(awkward, empty, coders):
    rows = bpe.encode_decode(awkward, PATH).collect()
    assert len(rows) == N
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[7]["n_tokens"] == 30_000 and bpe.encode_decode(empty, PATH).count() == 0


def test_kept_paths_are_small_and_go_with_their_encoder():
    """A worker makes an encoder a task, in the memory that the executor's JVM leaves."""
    text = " ".join("xq" + "".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3))
    encoder = bpe.Encoder(bpe.Tokenizer.load(PATH))
    encoder.encode(text)
    encoder.paths.clear()  # from here on only paths are added
    paths = weakref.ref(encoder.paths)
    tracemalloc.start()
    gc.disable()
    try:
        encoder.encode(text)
        assert len(encoder.paths) == 26**3 and tracemalloc.get_traced_memory()[0] / 26**3 < 180
        del encoder
        assert paths() is None
    finally:
        gc.enable()
        tracemalloc.stop()


def test_a_kept_text_goes_to_the_workers_once(awkward):
    out = langid.predict(awkward, None, keep=awkward.columns, names=("lang_pred", "lang_score"))
    assert out._jdf.queryExecution().analyzed().child().output().size() == len(awkward.columns)
    assert sorted(map(str, out.select(awkward.columns).collect())) == sorted(map(str, awkward.collect()))


# -- spans -------------------------------------------------------------------------------------------------------------

SECRETS = {"assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def secrets_brute(text):
    out = []
    for i, (kind, pattern) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), i, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secrets_of_many_texts():
    rng, scan = random.Random(3), secrets.scanner()
    parts = ["password", "passwd", "token", "api_key", "apikey", "Secret", "TOKEN", ":", "=", "  ", '"', "'", "abcdef12", "0123456789abcdef", "0123456789abcdef" * 2, "AKIA", "AKIAABCDEFGHIJKL", "XYZ019", "é", "\n", "-", "_", "a", ".", "+/", "😀"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert [s for s in secrets.find(text, scan) if s[0] in SECRETS] == secrets_brute(text), text


def test_secrets_in_long_runs_take_no_memory_of_their_own():
    import tracemalloc

    text = "ab" * 500_000 + " password: " + "0f" * 500_000 + " AKIA" + "Z" * 200_000
    scan = secrets.scanner()
    tracemalloc.start()
    found = secrets.find(text, scan)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(k, s) for k, s, _ in found] == [("hex", 0), ("assign", 1_000_001), ("hex", 1_000_011), ("access", 2_000_012)]
    assert peak < 4 * len(text)


def test_secrets_added_kinds():
    assert secrets.find("x -----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36, secrets.scanner())[0] == ("private_key", 2, 33)


def test_secrets_on_awkward_rows(awkward, empty):
    rows = secrets.scan(awkward).collect()
    assert len(rows) == N and all(r["n_assign"] == 0 and r["spans"] == "" for r in rows) and secrets.scan(empty).count() == 0


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def pii_brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_personal_data_of_many_texts(spark):
    rng = random.Random(4)
    parts = ["a", "b@c.de", "@", "x.y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.04", "4111 1111 1111 1111", "+1 (853) 555-7168", "+", "(", ") ", " ", "-", ".", "é", "😀", "_", "12", "@q.co", "123-45-6789", "call (415) 555-0100", "foo [at] bar [dot] com", "\x01", "\n", "4761348116108880"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 10))) for _ in range(600)] + ["1" * 20_000, "a" * 50_000, "a." * 5000 + "@b" + ".c" * 5000, None, ""]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(pii_brute(t).encode()).hexdigest(), t[:100]
        assert set(filter(None, pii_brute(t).split(","))) <= set(got[i]["spans"].split(","))


def test_personal_data_is_replaced(spark, awkward, empty):
    docs = spark.createDataFrame([(1, "Mail a.b@c.org now, é +1 (853) 555-7168!", 5), (2, None, 6)], "doc_id long, text string, spans int")
    assert [(r["doc_id"], r["text"], r["spans"]) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "Mail [EMAIL] now, é [PHONE]!", 5), (2, None, 6)]
    assert pii.redact(awkward).columns == awkward.columns and pii.redact(awkward).count() == pii.find(awkward).count() == N
    assert pii.find(empty).count() == pii.redact(empty).count() == 0


def test_many_matches_and_overlapping_spans_in_one_text(spark):
    """Offsets add up over blocks of matches and of text, and replacing them leaves everything else."""
    rng = random.Random(8)
    words = [rng.choice(["a.b@c.de", "10.0.0.1", "é😀", "+1 (853) 555-7168", "word", "4111 1111 1111 1111", "x"]) for _ in range(3000)]
    texts = [" ".join(words), " ".join(words[:700]) + "y" * 5000, "+4111 1111 1111 1111@b.co, +4111 1111 1111 1111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    for r in pii.redact(docs).collect():
        text, at, out = texts[r["doc_id"]], 0, ""
        for kind, s, e in (x.split(":") for x in spans[r["doc_id"]].split(",")):
            if int(s) >= at:
                out += text[at : int(s)] + f"[{kind.upper()}]"
            at = max(at, int(e))
        assert r["text"] == out + text[at:]
        assert set(pii_brute(text).split(",")) <= set(spans[r["doc_id"]].split(","))


def test_reliabilities_follow_the_votes():
    real = pii.estimate({("phone", "+++0"): 50, ("phone", "-00-"): 60, ("phone", "+00-"): 5})
    assert real["phone", "+++0"] > 0.9 and real["phone", "-00-"] < 0.1


# -- near and exact copies ---------------------------------------------------------------------------------------------


def fingerprint_brute(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in ("", "One", "one two", "one two three", "A b c D é f g 😀 " * 40, "x\x0by\x0cz w", "İ É ß AZ"):
        assert simhash.fingerprint(text) == fingerprint_brute(text)


@pytest.mark.parametrize("bucket", [64, 4])
def test_links_are_complete(spark, bucket):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base[:5]:
        for _ in range(40):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(rng.choice([64, 12]))
            fps.add(x)
    values = sorted(simhash._signed(x) for x in fps)
    bits = np.array(values, np.int64).view(np.uint64)
    want = {(values[i], values[j]) for i in range(len(values)) for j in range(i + 1, len(values)) if int(bits[i] ^ bits[j]).bit_count() <= 3}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), bucket).collect()]
    assert len(got) == len(want) and set(got) == want


def test_classes_of_texts_from_end_to_end(spark):
    """Fingerprint and class of every row, against all pairs of rows."""
    rng = random.Random(12)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    texts = [None, "", " \n", *base]
    for t in base:
        words = t.split()
        for _ in range(3):
            i = rng.randrange(len(words))
            texts.append(" ".join([*words[:i], rng.choice(["zz", words[i].upper(), "b"]), *words[i + 1 :]]))
    prints = [fingerprint_brute(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if bin(prints[i] ^ prints[j]).count("1") <= 3) for i in range(len(texts))]
    rows = simhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", root[i]) for i in range(len(texts))}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)]
    got = {r["u"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)}


def test_classes_on_awkward_rows(awkward, empty):
    rows = simhash.classes(awkward).collect()
    assert len(rows) == N
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == by[2] == by[3] == 1 and by[5] == 5 and simhash.classes(empty).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 5").count() == 1 and simhash.keep_one(empty).count() == 0


def test_one_row_of_every_class_stays_whatever_the_ids(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(8)]
    rows = [(7, texts[0]), (7, texts[1]), (3, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (9, texts[3]), (5, texts[4]), (5, texts[5]), (None, None), (None, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["text"] or "", r["doc_id"] or 0) for r in kept.collect()) == sorted([("", 0), (texts[0], 7), (texts[1], 3), (texts[2], 0), (texts[3], 9), (texts[4], 5), (texts[5], 5)])


def removed_brute(texts, window=400):
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def passages_brute(texts, size=51):
    """(passages, words in them): maximal runs of words covered by ``size`` words that also stand in another document."""
    words = [re.findall(r"[^ \t-\r]+", t or "") for t in texts]
    homes = {}
    for i, w in enumerate(words):
        for k in range(len(w) - size + 1):
            homes.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for w in words:
        own = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if len(homes[tuple(w[k : k + size])]) > 1:
                own[k : k + size] = True
        out.append((int((np.diff(np.concatenate([[0], own.astype(int)])) == 1).sum()), int(own.sum())))
    return out


@pytest.mark.parametrize("hot,fine", [(4096, 10), (2, 10), (1, 3)])
def test_repeated_strings(spark, monkeypatch, hot, fine):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "FINE", fine)
    rng = random.Random(1)

    def noise(n):
        return "".join(rng.choice("abcdefghij klmno éü\n") for _ in range(n))

    passages = [noise(rng.randint(380, 900)) for _ in range(5)]
    texts = [None, "", "a" * 399, "a" * 400, "a" * 401, "xy" * 500, passages[0], passages[0], noise(300) + passages[1] + noise(20) + passages[1]]
    for _ in range(40):
        p, a = rng.choice(passages), rng.randint(0, 120)
        texts.append(noise(rng.randint(0, 300)) + p[a : len(p) - rng.randint(0, 120)] + noise(rng.randint(0, 200)))
    for t in texts[10:25]:
        i = rng.randint(0, len(t) - 1)
        texts.append(t[:i] + "Z" + t[i + 1 :])
    alone = noise(700) + " "
    texts += [alone * 2, " ".join("ab" * 51), " ".join("ab" * 51), "x " * 200, " ".join("cd" * 200)]
    got = {r["doc_id"]: r for r in suffixes.spans_removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(got[i][1:5]) for i in range(len(texts))] == removed_brute(texts)
    found = passages_brute(texts)
    assert [tuple(got[i][5:7]) for i in range(len(texts))] == found and found[len(texts) - 5] == (0, 0) and sum(n for n, _ in found) > 20


def test_pieces_do_not_change_what_is_found(spark, monkeypatch):
    """Words and runs that a piece's end cuts, in texts that lie end to end."""
    from quireflow.llm import anchors

    rng = random.Random(3)
    texts = ["", *["".join(rng.choice("abc  \n") for _ in range(rng.randint(0, 900))) for _ in range(30)], "q" * 700, ""]
    data, offsets = suffixes.symbols_of(__import__("pyarrow").array(texts))
    whole = anchors.words_of(data, offsets)
    monkeypatch.setattr(anchors, "PIECE", 97)
    words, at = anchors.words_of(data, offsets)
    assert at.tolist() == whole[1].tolist() == np.cumsum([0, *[len(t.split()) for t in texts]]).tolist()
    as_words = [w for t in texts for w in t.split() if len(w) <= 97]
    assert len(set(words[[len(w) <= 97 for t in texts for w in t.split()]].tolist())) == len(set(as_words))
    unit = suffixes.Unit(False, 60, 12, 4, 0)
    covered = {(d, (p >> suffixes.START) + i) for docs, _, _, places in suffixes.stretches(data, offsets, unit) for d, p in zip(docs.tolist(), places.tolist()) for i in range(p >> suffixes.COUNT & suffixes.FIELD)}
    assert covered == {(d, s) for d, t in enumerate(texts) for s in range(len(t) - 59)}


def test_interval_expansion():
    from collections import Counter

    rng = random.Random(9)
    for _ in range(100):
        n, length = rng.randint(5, 120), rng.choice([2, 3, 5])
        s = [rng.choice([1, 2, 3]) for _ in range(n)]
        for k, cut in enumerate({n - 1, rng.randrange(n)}):
            s[cut] = 1000 + k
        seen = Counter(tuple(s[i : i + length]) for i in range(n - length + 1))
        assert suffixes.repeated(np.array(s, np.int64), length).tolist() == [i + length <= n and seen[tuple(s[i : i + length])] > 1 for i in range(n)]


def test_repeated_strings_on_awkward_rows(awkward, empty):
    rows = {r["doc_id"]: r for r in suffixes.spans_removed(awkward).collect()}
    assert rows[1]["n_bytes"] == 0 and rows[7]["n_removed"] == 150_000 and rows[8]["n_spans"] == 1
    assert suffixes.spans_removed(awkward).count() == N and suffixes.spans_removed(empty).count() == 0


def test_no_text_column_is_needed_beside_the_named_ones(awkward):
    renamed = awkward.select(F.col("doc_id").alias("k"), F.col("text").alias("body"))
    assert secrets.scan(renamed, "body", ("k",)).columns[0] == "k" and simhash.classes(renamed, "k", "body").columns[0] == "k"
