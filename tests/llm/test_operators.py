"""Every operator against brute force, on a fixture with nulls, empty, odd and long texts, ties, repeated rows,
clashing column names and an empty table."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import chat, cover_tree, language_id, language_model, merge_dropout, packing, quality_classifier, quality_rules, simhash, spans, token_counts, vector_bpe

SYLLABLES = {"en": "the ing er on an re th ed nd ha".split(), "fr": "le eau oi ment que ai é ç re ou".split(), "de": "sch ch ein ung ge er ü ß pf tz".split()}


def prose(rng, lang, n):
    out = []
    for _ in range(n):
        w = "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))
        out.append(w + rng.choice(["", "", "", ".", ","]))
    return " ".join(out) + "."


def fixture_rows():
    rng = random.Random(4)
    rows = []
    for i in range(150):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, prose(rng, lang, rng.randint(3, 120)), lang, f"src{i % 3}"))
    odd = [None, "", " \n\t", "a", "\x1c a\x85b", "中文 <|endoftext|> ▁ 'll don't", "x" * 3000, prose(rng, "en", 9000), rows[5][1], rows[5][1], "123 456 !!! ???", "\x00 é", "one two three four five six seven eight nine ten " * 8]
    for k, text in enumerate(odd):
        rows.append((1000 + k, text, None if k % 2 else "en", None))
    rows += [rows[7], (None, "a null id", "en", "s"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # _q_words, fp, p, score and block are names that the operators use themselves
    rows = [(*r, 1, 2, 3, 0.5, 4) for r in fixture_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _q_words int, fp int, p int, score double, block int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


TEXTS = [(r[0], r[1]) for r in fixture_rows()]


def test_token_counts(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = token_counts._tokenizer(path)
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect() if r.doc_id is not None)
    want = []
    for i, t in TEXTS:
        if i is not None:
            n = len(tok.encode(t or "", add_special_tokens=False).ids)
            want.append((False, i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts.token_counts(docs, path).count() == len(TEXTS)
    assert token_counts.token_counts(none, path).count() == 0


def test_pretokens_are_independent():
    tok = token_counts._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = [" ", "\n", "a", "b", "é", "1", ".", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "'s", "中", " a", "  ", "ab\n"]
    size = lambda x: len(tok.encode(x, add_special_tokens=False).ids)
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        bare, spaced, feeds = token_counts.pretokens(t)
        assert sum(map(size, bare)) + sum(size(" " + x) for x in spaced) + feeds * size("\n") == size(t), repr(t)


def check_packing(rows, texts, path, capacity=4096):
    tok = packing._encoder(path).tok
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[(i, k // capacity, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for own in by_id(rows, "sequence_id").values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path).collect()
    check_packing(rows, TEXTS, path)
    least = -(-sum(r.length for r in rows) // 4096)
    assert len({r.sequence_id for r in rows}) <= least + 1
    assert packing.pack(none, path).count() == 0


def test_word_ids_are_the_librarys():
    words = packing._encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    parts = [" ", "\n", "a", "É", "é", "1", ".", "!", "\x1c", "\x85", "\xa0", "<|endoftext|>", "'s", "中", "İ", "Σ", "́", "'re", "''ll", "'LL", "²", "µ", "ª", "×", "x'ver", "'d"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for t, ids in zip(texts, words.encode(texts)):
        assert ids.tolist() == words.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_plan_places_all_pieces():
    rng = random.Random(3)
    for capacity in (16, 64, 4096):
        counts = Counter(min(capacity, max(1, int(rng.gauss(capacity / 4, capacity / 6)))) for _ in range(2000))
        counts[capacity // 3] += 700  # one length that a third of all have
        used, ranks = {}, {}
        for length, first, n, sequence, copies, base in packing.plan(counts, capacity):
            ranks.setdefault(length, []).append((first, n))
            for i in range(n):
                used.setdefault(sequence + i // copies, []).append((base + i % copies * length, length))
        for length, own in ranks.items():
            at = 0
            for first, n in sorted(own):
                assert first == at
                at += n
            assert at == counts[length]
        for own in used.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) <= 1.1 * -(-sum(a * b for a, b in counts.items()) // capacity) + 1


def test_quality_rules(docs, none):
    got = by_id(quality_rules.quality_rules(docs).collect())
    import re

    for i, t in TEXTS:
        if i is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(words)
        grams = [tuple(words[k : k + 5]) for k in range(n - 4)]
        times, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if times[g] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), repr(t)[:80]
        assert r.base_failed == (n < 10 or 100 * len(covered) > 20 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_rules.reject(docs).columns == docs.columns
    plan = docs.sparkSession._jvm.PythonSQLUtils.explainString(quality_rules.quality_rules(docs)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("RepartitionByExpression")[0].replace("Exchange RoundRobin", "")


def brute_kept(t):
    """The verdict of the line rules, by Python's own regular expressions."""
    import re

    text = t or ""
    space = " \t\n\x0b\x0c\r"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    total, seen, stand = sum(map(len, words)), set(), 0
    for line in text.split("\n"):
        if not line.strip(space) or line in seen:
            continue
        seen.add(line)
        parts = line.split(" ")
        n, own = len(parts), len(set(parts))
        bars = len(re.findall(r"[|•·»›]", line))
        odd = len(re.findall(r"([#*$%&<>~^_=+]{2,}|[!?]{2,})(?=[ \t\n\x0b\f\r]|$)", line))
        runs = any(m in line for m in quality_rules.RUNS)
        fails = n >= 12 and own * 5 <= n
        fails |= n >= quality_rules.HEADING_WORDS and not re.search(quality_rules.END_MARK, line)
        fails |= bars >= 2 and bars * 5 >= n
        fails |= runs and odd >= 2 and odd * 3 >= n
        fails |= len(line) <= quality_rules.FURNITURE_CHARS and bool(re.search(quality_rules.FURNITURE, line, re.ASCII))
        if not fails:
            stand += sum(c not in space for c in line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(k, k + 5))
    return len(words) >= 10 and 100 * len(covered) <= 20 * len(words) and stand >= quality_rules.MIN_KEPT * total


GOOD = "This is a line of some words that ends well."
LINES = [("Home | About | Contact | Help", True), ("word*** other### third%%% more&&& end", True), ("no mark at all in this long line of words", True), ("All rights reserved.", True), ("go go go go go go go go go go go go.", True), ("A heading", False), ("Home • About » Help › More.", True), ("what!! is?? this!! now??", True), ("Please read this, and click here.", True), ("x" * 190 + " we click here and go on. " + "y" * 20, False)]


def test_quality_verdicts(spark):
    """``kept`` by brute force, of texts that mix good and failing lines, and a filter on it that doesn't swell the plan."""
    rng = random.Random(40)
    texts = [t for _, t in TEXTS]
    for _ in range(150):
        lines = [rng.choice([GOOD, prose(rng, "en", 12), prose(rng, "fr", 9), rng.choice(LINES)[0], rng.choice(LINES)[0], "", " \t"]) for _ in range(rng.randint(1, 9))]
        texts.append("\n".join(lines))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = quality_rules.quality_rules(df)
    want = {i: brute_kept(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.kept for r in found.collect()} == want and 20 < sum(want.values()) < len(want) - 20
    only = found.where("kept")
    assert {r.doc_id for r in only.collect()} == {i for i, k in want.items() if k}
    size = lambda d: len(spark._jvm.PythonSQLUtils.explainString(d._jdf.queryExecution(), "simple"))
    assert size(only) < 1.5 * size(found) and size(quality_rules.reject(df)) < 1.5 * size(found)


def test_line_rules(spark):
    rows = [(k, "\n".join([GOOD, " ".join(f"word{k}" for k in range(60)) + ".", x])) for k, (x, _) in enumerate(LINES)]
    got = {r.doc_id: r.clean_text for r in quality_rules.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(len(LINES)))
    for k, (x, fails) in enumerate(LINES):
        assert (x not in got[k].split("\n")) == fails, x


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash(docs, none):
    short = [(i, t) for i, t in TEXTS if len(t or "") < 5000]
    own = docs.where("length(coalesce(text, '')) < 5000")
    got = simhash.near_duplicates(own).collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((i, brute_fingerprint(t)) for i, t in short)
    fps = {i: brute_fingerprint(t) for i, t in short if i is not None}
    want = roots(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    # with few fingerprints named by broadcast, and with none
    for hot in (0.02, 1.0):
        assert Counter(map(tuple, simhash.near_duplicates(own, hot=hot).collect())) == Counter(map(tuple, got))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(own, 2, 1)
    # and the text that only a row without an id has
    assert kept.columns == own.columns and kept.count() == len(set(want.values())) + 1


@pytest.mark.parametrize("distance, cell", [(2, 9), (2, 1000), (1, 9), (4, 9), (4, 1000), (6, 20)])
def test_simhash_links(spark, distance, cell):
    """Crowded keys give the same components as pairs, at any distance."""
    rng = random.Random(6)
    fps = set()
    for _ in range(2):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.choice([0, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, distance, cell)).collect()}
    want = roots(sorted(fps), lambda a, b: ((a ^ b) % 2**64).bit_count() <= distance)
    assert {x: got.get(x, x) for x in fps} == want


def test_simhash_runs_go_on_over_batches():
    """Keys are met whole, however their rows fall into batches; crowded ones are handed on whole."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((k, (rng.getrandbits(64) & ~0xFF) | j) for k, n in enumerate([1, 2, 3, 30, 1, 2, 9, 64, 1]) for j in range(n))
    base = {k: rng.getrandbits(62) & ~0xFF for k in range(9)}
    rows = [(k, base[k] | j % 256) for k, j in ((k, fp & 0xFF) for k, fp in rows)]
    for size in (1, 2, 7, 1000):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p], pa.int64()), pa.array([f for _, f in p], pa.int64())], ["key", "fp"]) for p in parts]
        out = [r for b in simhash._meet(2, 32)(iter(batches)) for r in b.to_pylist()]
        assert Counter((r["key"], r["a"]) for r in out if r["key"] is not None) == Counter(r for r in rows if r[0] == 7)
        edges = {(r["a"], r["b"]) for r in out if r["key"] is None}
        nodes = [f for k, f in rows if k != 7]
        assert roots(nodes, lambda a, b: (min(a, b), max(a, b)) in edges) == roots(nodes, lambda a, b: (a ^ b).bit_count() <= 2)


def test_components(spark):
    """Long paths, in any order of their nodes, and random graphs."""
    rng = random.Random(13)
    path = list(range(1, 120))
    shuffled = rng.sample(range(1000, 1100), 100)
    edges = list(zip(path, path[1:])) + list(zip(shuffled, shuffled[1:])) + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    known = {tuple(sorted(e)) for e in edges}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    assert got == roots(nodes, lambda a, b: (a, b) in known)


def test_simhash_keys():
    """Any two fingerprints within the distance agree in the bits of a key."""
    rng = random.Random(7)
    for distance, n in ((1, 10), (2, 10), (2, 1 << 40), (4, 10), (4, 1 << 30), (6, 10)):
        keys = simhash.masks(distance, n)
        for _ in range(200):
            bits = sum(1 << j for j in rng.sample(range(64), distance))
            assert any(not bits & m for m in keys)


def test_simhash_many(spark):
    """With several fingerprints, documents are linked if any of theirs are close, as brute force has it."""
    rng = random.Random(21)
    rows = []
    for k in range(30):
        words = prose(rng, "en", 150).split()
        for j in range(4):
            own = list(words)
            for at in rng.sample(range(len(own)), 2 * j):
                own[at] = prose(rng, "en", 1)
            rows.append((10 * k + j, " ".join(own)))
    rows += [(900, rows[0][1]), (901, None), (902, " ")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), distance=4, many=6).collect()
    fps = {i: simhash.fingerprint((t or "").encode().lower().split(), 3, 6) for i, t in rows}
    want = roots(sorted(fps), lambda a, b: min((x ^ y).bit_count() for x, y in zip(fps[a], fps[b])) <= 4)
    assert {r.doc_id: r.component_id for r in got} == want
    assert sum(want[10 * k + 1] == want[10 * k] for k in range(30)) >= 25  # two words in 150: five-word similarity 0.87


def test_language_id(docs, none, spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, ("en", "fr", "de")[i % 3], 60), ("en", "fr", "de")[i % 3]) for i in range(600)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i, _, _ in rows)
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held)
    odd = by_id(language_id.identify(docs).collect())
    for i, t in TEXTS:
        if i is not None and not any(c.isalpha() for c in t or ""):
            assert odd[i][0].lang_pred == "und" and odd[i][0].rejected
    assert all(0 <= r.score <= 1 for own in odd.values() for r in own)
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.keep_known(docs).columns == docs.columns


def test_language_id_learns_long_texts_and_rejects_others(spark):
    """A language all whose texts are long is learned; texts of an unseen language and noise are rejected, others not."""
    rng = random.Random(19)
    rows = [(i, prose(rng, "en", 80), "en") for i in range(240)] + [(1000 + i, prose(rng, "fr", 6000), "fr") for i in range(30)]
    rows += [(2000 + i, prose(rng, "fr", 60), None) for i in range(20)]
    rows += [(3000 + i, prose(rng, "de", 80), None) for i in range(20)]
    rows += [(4000 + i, " ".join("".join(rng.choice("qwxzjkvbpm") for _ in range(7)) for _ in range(60)), None) for i in range(20)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    assert all(got[2000 + i].lang_pred == "fr" and not got[2000 + i].rejected for i in range(20))
    assert sum(got[3000 + i].rejected for i in range(20)) >= 18 and all(got[4000 + i].rejected for i in range(20))
    assert sum(got[i].rejected for i in range(240)) <= 2


def test_language_id_scores_as_a_dense_forward_pass():
    """predict() equals, text by text, a loop over grams with the model's own tables."""
    rng = random.Random(20)
    texts = [prose(rng, lang, n) for lang in ("en", "fr", "de") for n in (1, 5, 40, 400)] * 5
    labels = [lang for lang in ("en", "fr", "de") for _ in range(4)] * 5
    features = [language_id._features(language_id._normal(t)) for t in texts]
    model = language_id.train(features, labels, features)
    texts.append(" ".join(texts) * 6)
    names, scores, _ = language_id.predict(model, texts_array(texts))
    for text, name, score in zip(texts, names, scores):
        data, total, n = language_id._normal(text), np.zeros(6), 0
        for size in language_id.GRAMS:
            for k in range(len(data) - size + 1):
                total += model.logits[language_id.buckets(np.frombuffer(data[k : k + size], np.uint8))[size - 2][0]].astype(float)
                n += 1
        x = (total[:3] / n + model.bias) / model.temperature
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert model.languages[int(p.argmax())] == name and math.isclose(p.max(), score, rel_tol=1e-3)


def texts_array(texts):
    import pyarrow as pa

    return pa.array(texts)


def test_quality_classifier(docs, none, spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        good = i % 6 != 0
        text = prose(rng, "en", 60)
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        labels.append((i, int(good)))
    table = spark.createDataFrame(labels + [(None, 1), (99999, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, _ in rows)
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.95 * len(held)
    assert quality_classifier.classify(docs, table.where("false")).count() == len(TEXTS)
    assert quality_classifier.classify(none, table).count() == 0
    # a fitted model on nulls, empty, odd and long texts
    odd = quality_classifier.classify(docs, spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)


def auc(scores, truth):
    above = [s for s, t in zip(scores, truth) if t]
    below = [s for s, t in zip(scores, truth) if not t]
    return sum((a > b) + (a == b) / 2 for a in above for b in below) / (len(above) * len(below))


def test_quality_classifier_learns_words_from_positives_alone(spark):
    """Texts that differ in their vocabulary only; no row is labelled 0, and the prior is estimated."""
    rng = random.Random(31)
    words = {good: sorted({prose(rng, "en", 1).rstrip(".,") + tail for _ in range(150)}) for good, tail in ((True, "a"), (False, "e"))}
    truth = {i: i % 5 != 0 for i in range(3000)}
    rows = [(i, " ".join(rng.choice(words[good]) for _ in range(60)) + ".") for i, good in truth.items()]
    labels = [(i, 1) for i, good in truth.items() if good and i % 2]
    got = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r.held_out]
    assert auc([r.score for r in held], [truth[r.doc_id] for r in held]) > 0.99
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert abs(sum(r.score for r in got) / len(got) - 0.8) < 0.08  # the mean score is the estimated prior


def test_quality_classifier_scores_and_risk_as_plain_loops():
    rng = np.random.default_rng(5)
    q = quality_classifier
    texts = [prose(random.Random(k), "en", 30) for k in range(40)] + ["", None, "x " * 50]
    rows = q._measured(texts_array(texts))
    model = q.calibrated(q.train(rows.take(np.arange(20)), rows, 0.6, epochs=30), rows, 0.6)
    w = model.weights
    for k, text in enumerate(texts):
        own = q.measures(text)
        x = [(a - m) / s for a, m, s in zip(own[0].astype(float), model.mean, model.scale)]
        z = model.shift + w[3][0] + sum(a * b for a, b in zip(x, w[4])) + sum(int(a) * b / 255 for a, b in zip(own[1], w[5]))
        z += sum(math.tanh(sum(a * w[0][i][j] for i, a in enumerate(x)) + w[1][j]) * w[2][j] for j in range(q.HIDDEN))
        assert math.isclose(1 / (1 + math.exp(-z)), q.score(model, rows)[k], rel_tol=1e-4)
    assert abs(q.score(model, rows).mean() - 0.6) < 1e-6
    # the risk and its slope, where the bracket is positive and where it isn't
    for prior, bias in ((0.3, 0.0), (0.9, 3.0)):
        z = rng.normal(0, 1, 12)
        z[:5] += bias
        plus, minus = [math.log1p(math.exp(-v)) for v in z], [math.log1p(math.exp(v)) for v in z]
        bracket = sum(minus[5:]) / 7 - prior * sum(minus[:5]) / 5
        risk, slope = q.nn_risk(z, 5, prior)
        assert math.isclose(risk, prior * sum(plus[:5]) / 5 + max(0, bracket))
        for k in range(12):
            step = np.eye(12)[k] * 1e-6
            f = (lambda v: q.nn_risk(v, 5, prior)[0]) if bracket >= 0 else (lambda v: -(np.logaddexp(0, v[5:]).mean() - prior * np.logaddexp(0, v[:5]).mean()))
            assert math.isclose((f(z + step) - f(z - step)) / 2e-6, slope[k], abs_tol=1e-6)


def test_lm_scores(docs, none):
    got = by_id(language_model.lm_scores(docs).collect())
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in TEXTS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, own in tokens if not held(i) for w in own)
    total = sum(count.values())
    for i, own in tokens:
        if i is None:
            continue
        r = got[i][0]
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own)
        assert r.held_out == held(i) and r.n_tokens == len(own) and r.n_known == sum(w in count for w in own) and r.train_tokens == total
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert sum(r.score for own in got.values() for r in own) > sum(r.base_score for own in got.values() for r in own)
    assert language_model.lm_scores(none).count() == 0


def lm_block(words, lens, held):
    """A block of random tokens over the words, the first of which is the end."""
    rng = np.random.default_rng(3)
    tokens = np.concatenate([np.append(rng.integers(1, len(words), n - 1), 0) for n in lens]).astype(np.int32)
    hashes = np.array([zlib.crc32(w) for w in words], np.uint32)
    ends = np.array([language_model.end_of(w) for w in words], np.uint16)
    return {"tokens": tokens.tobytes(), "lens": lens, "held": held, "hashes": hashes.tobytes(), "ends": ends.tobytes()}


def lm_singles(words):
    keys = np.array([zlib.crc32(w) << 16 | language_model.end_of(w) for w in words], np.int64)
    order = np.argsort(keys)
    leaves = language_model.arrange(np.random.default_rng(4).integers(0, 9, (len(words), 2 * language_model.BESIDE)))
    return language_model.Singles(keys[order], order, leaves[order])


def test_lm_meets_every_training_position(monkeypatch):
    """Over the rounds, every position of every training document gives a gradient once, in short documents too."""
    met = []
    features = language_model._Text.features
    monkeypatch.setattr(language_model._Text, "features", lambda self, at: met.append(at) or features(self, at))
    words = [b"", *[b"w%d" % k for k in range(49)]]
    lens = [1, 2, 4, 40, 3, 2, 1, 900]
    held = [False, False, True, False, False, True, False, False]
    block, singles = lm_block(words, lens, held), lm_singles(words[:20])
    weights = language_model.start(np.ones(language_model.LEAVES), np.ones(language_model.LEAVES, bool))
    for turn in range(language_model.ROUNDS):
        language_model._steps(weights, [block], singles, turn, language_model.ROUNDS)
    assert sorted(np.concatenate(met)) == np.flatnonzero(~np.repeat(held, lens)).tolist()


def test_lm_probabilities_sum_to_one(spark):
    """At any history, over all words seen in training and one unseen word of each leaf that words share."""
    m = language_model
    seen = [b"", *[b"w%d" % k for k in range(400)]]
    words = seen + [b"new%02d" % k for k in range(99)]
    lens = [300] * 20
    block, singles = lm_block(words, lens, [False] * 20), lm_singles(seen[:150])
    text = m._Text(block, singles)
    c = np.bincount(text.tokens, minlength=len(words))
    tails = m.Tails(np.zeros(m.LEAVES), np.zeros(m.LEAVES), np.zeros(m.LEAVES, np.int64))
    np.add.at(tails.counts, text.leaf.astype(int), c)
    np.add.at(tails.once, text.leaf.astype(int), (c == 1) & ~text.single)
    tails.once = np.maximum(tails.once, 1)
    used = np.zeros(m.LEAVES, bool)
    used[singles.leaves] = used[m.tail_leaf(np.arange(m.TAILS))] = True
    weights = m.start(tails.counts, used)
    for turn in range(2):
        weights = m.moved(weights, m._steps(weights, [block], singles, turn, 2))
    assert np.abs(weights.rows).max() > 0.01
    within = 10 ** m.word_scores(text, c, tails)
    for at in (0, 1, 2, 777):
        features, leaf = text.features(np.array([at])), np.zeros(m.LEAVES)
        for x in np.flatnonzero(used):
            leaf[x] = math.prod(float(weights.probabilities(m._rows(features, node, weights.bits), node)[0, choice[0]]) for node, choice in m._choices(np.array([x])))
        total = sum(leaf[text.leaf[k]] * within[k] for k in range(len(words)) if c[k])
        total += sum(leaf[x] * tails.once[x] / (tails.counts[x] + tails.once[x]) for x in m.tail_leaf(np.arange(m.TAILS)))
        assert math.isclose(total, 1, rel_tol=1e-4)
        # the score of the position is the product of its choices
        own = text.tokens[at]
        assert math.isclose(10 ** m.leaf_scores(weights, text, np.array([at]))[0], leaf[text.leaf[own]], rel_tol=1e-4)


def m_changes_average():
    a, b = (np.full((2, 16), 1, np.float16), np.array([3, 0], np.float32)) * 2, (np.full((2, 16), 5, np.float16), np.array([1, 0], np.float32)) * 2
    out = language_model._mean(a, b)
    return out[0][:, 0].tolist() == [2, 0] and out[1].tolist() == [4, 0]


def plain_score(model, words, counts):
    """log10 probability of a text, word by word in Python's own numbers."""
    m, mask = language_model, 0xFFFFFFFF
    leaves = dict(zip(model.singles.keys.tolist(), model.singles.leaves.tolist()))
    crc = lambda w: zlib.crc32(w)
    total = 0.0
    for i, w in enumerate(words):
        one, two = (crc(words[i - 1]) if i else 0) + 1 & mask, crc(words[i - 2]) if i > 1 else 0
        features = [one * 2654435761 & mask, ((one ^ two * 3266489917 & mask) * 668265263 + 77) & mask, two * 374761393 + 1234567 & mask]
        key = crc(w) << 16 | crc(w[-2:]) & 0xFFFF
        tail = (crc(w[-2:]) & 0xFFFF) % m.TAILS
        leaf = leaves.get(key, tail // 2 * 16 + 14 + tail % 2)
        for node, choice in ((0, leaf // 256), (1 + leaf // 256, leaf // 16 % 16), (17 + leaf // 16, leaf % 16)):
            z = [float(v) for v in model.weights.bias[node]]
            for f in features:
                h = (f ^ (node + 1) * 0x9E3779B1 & mask) * 2246822519 & mask
                h ^= h >> 15
                row = (h * 3266489917 & mask) >> 32 - model.weights.bits
                z = [a + float(v) for a, v in zip(z, model.weights.rows[row])]
            total += math.log10(math.exp(z[choice]) / sum(math.exp(v) for v in z))
        if key not in leaves:
            n, once = model.tails.counts[leaf], model.tails.once[leaf]
            total += math.log10((counts.get(w) or once) / (n + once))
    return total


def test_lm_scores_as_word_by_word(spark, docs):
    rows = [(i, t) for i, t in TEXTS if i is not None and i < 1000]
    model = language_model.fit(docs.where("doc_id < 1000"))
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*(t or "").encode().lower().split(), b""])
    # more words than leaves would take many texts: most words lose theirs, the end keeps it
    keep = np.flatnonzero((model.singles.numbers == 0) | (model.singles.numbers % 3 == 1))
    few = language_model.Singles(model.singles.keys[keep], model.singles.numbers[keep], model.singles.leaves[keep])
    tails = language_model.Tails(np.zeros(language_model.LEAVES), np.ones(language_model.LEAVES), np.zeros(language_model.LEAVES, np.int64))
    for w, n in counts.items():
        key = zlib.crc32(w) << 16 | language_model.end_of(w)
        at = few.leaves[np.searchsorted(few.keys, key)] if key in few.keys else language_model.tail_leaf(language_model.end_of(w) % language_model.TAILS)
        tails.counts[at], tails.words[at] = tails.counts[at] + n, tails.words[at] + 1
    for at in language_model.tail_leaf(np.arange(language_model.TAILS)):
        own = [n for w, n in counts.items() if language_model.tail_leaf(language_model.end_of(w) % language_model.TAILS) == at and zlib.crc32(w) << 16 | language_model.end_of(w) not in few.keys]
        tails.once[at] = max(sum(n == 1 for n in own), 1)
    for fitted in (model, language_model.Fitted(model.blocks, model.counts, language_model.train(model.blocks, few, tails.counts), few, tails)):
        got = by_id(language_model.lm_scores(docs, fitted).collect())
        for i, t in rows:
            want = plain_score(fitted, [*(t or "").encode().lower().split(), b""], counts)
            assert all(math.isclose(r.score, want, rel_tol=1e-4) for r in got[i])


def lm_slopes(n, size, seed):
    """Rows of three levels' features and their slopes: most rows met a few times, some hundreds of times, some never."""
    rng = np.random.default_rng(seed)
    rows = [[np.where(rng.random(n) < 0.1, rng.integers(0, 5, n), rng.integers(0, size - 3, n)) for _ in range(3)] for _ in range(3)]
    return rows, rng.normal(0, 1, (3 * n, 16)).astype(np.float32)


def sorted_sums(rows, slopes):
    """Sums by row as numpy has them: slopes set out in the rows' order, and summed stretch by stretch."""
    flat = np.concatenate([r for level in rows for r in level])
    order, n = np.argsort(flat.astype(np.uint16), kind="stable"), len(rows[0][0])
    spread, own = slopes[order // (3 * n) * n + order % n], flat[order]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[starts], np.diff(np.append(starts, len(own))), np.add.reduceat(spread, starts, axis=0)


def test_lm_sums_of_slopes(monkeypatch):
    """Each row met gets the sum of all its slopes once, however often it is met and however the rows are cut in chunks."""
    for n, size, chunk in ((1, 8, 4), (40, 4096, 7), (5000, 4096, 1 << 14), (5000, 512, 100)):
        monkeypatch.setattr(language_model, "CHUNK", chunk)
        rows, slopes = lm_slopes(n, size, n)
        want = {r: (t, x) for r, t, x in zip(*sorted_sums(rows, slopes))}
        got = {}
        for own, times, sums in language_model._sums(rows, slopes, size):
            assert len(own) <= chunk and not got.keys() & set(own.tolist())
            got |= {r: (t, x) for r, t, x in zip(own.tolist(), times.tolist(), sums.copy())}
        assert got.keys() == want.keys() and all(got[r][0] == t and np.allclose(got[r][1], x, atol=1e-3) for r, (t, x) in want.items())
    assert max(t for t, _ in want.values()) > 2 * language_model.MOST


def test_lm_sums_take_less_time():
    """Than summing stretch by stretch, of which training mostly consisted."""
    rows, slopes = lm_slopes(50_000, 1 << 16, 1)

    def took(work):
        begun = time.process_time()
        work()
        return time.process_time() - begun

    new, plain = lambda: [None for _ in language_model._sums(rows, slopes, 1 << 16)], lambda: sorted_sums(rows, slopes)
    assert min(took(new) for _ in range(3)) < 0.8 * min(took(plain) for _ in range(3))


def test_lm_step_as_plain_loops():
    """One minibatch: every row and bias moves by its summed slopes, in Python's own numbers."""
    m = language_model
    words = [b"", *[b"w%d" % k for k in range(30)]]
    block, singles = lm_block(words, [60, 1, 40, 9], [False, False, True, False]), lm_singles(words[:12])
    used = np.zeros(m.LEAVES, bool)
    used[singles.leaves] = used[m.tail_leaf(np.arange(m.TAILS))] = True
    weights = m.start(np.ones(m.LEAVES), used)
    weights.rows[:] = np.random.default_rng(2).normal(0, 0.1, weights.rows.shape)
    text, sums, times = m._Text(block, singles), Counter(), Counter()
    for at in np.flatnonzero(~text.held):
        at = np.array([at])
        features = text.features(at)
        for node, choice in m._choices(text.leaf[text.tokens[at]]):
            own = [int(r[0]) for r in m._rows(features, node, weights.bits)]
            z = [float(weights.bias[node[0]][j]) + sum(float(weights.rows[r][j]) for r in own) for j in range(16)]
            p = [math.exp(v) for v in z]
            slope = np.array(p) / sum(p) - np.eye(16)[choice[0]]
            for key in [("bias", int(node[0])), *own]:
                sums[key], times[key] = sums[key] + slope, times[key] + 1
    rows, seen, bias, met = m._steps(weights, [block], singles, 0, 1)
    assert {*np.flatnonzero(seen).tolist(), *(("bias", k) for k in np.flatnonzero(met).tolist())} == times.keys()
    for key, n in times.items():
        grad = sums[key] / math.sqrt(n)
        got, many = (bias[key[1]], met[key[1]]) if isinstance(key, tuple) else (rows[key], seen[key])
        assert many == n and np.allclose(got, -m.RATE / math.sqrt(0.1 + float(grad @ grad) / 4) * grad, rtol=2e-3, atol=2e-4)


def test_lm_ends_of_words():
    import pyarrow as pa

    words = [b"", b"a", b"\xff", b"ab", "é日".encode(), b"zzz", b"\x00\x00"]
    array = pa.array(words, pa.binary())
    assert language_model._ends(array).tolist() == [language_model.end_of(w) for w in words]
    assert language_model._ends(array.slice(2, 3)).tolist() == [language_model.end_of(w) for w in words[2:5]]
    assert language_model._ends(array[:1]).tolist() == [language_model.end_of(b"")]


def test_lm_learns_from_history(spark):
    """Words that only the history tells apart are scored better than by their shares, on held-out documents."""
    rng = random.Random(11)
    follows = {w: [prose(rng, "en", 1) for _ in range(2)] for w in {prose(rng, "en", 1) for _ in range(60)}}
    every = sorted({x for xs in follows.values() for x in xs} | set(follows))

    def text():
        out = [rng.choice(every)]
        for _ in range(80):
            out.append(rng.choice(follows.get(out[-1], every)))
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(700)], "doc_id long, text string").repartition(2)
    held = [r for r in language_model.lm_scores(df).collect() if r.held_out]
    assert m_changes_average()
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.3


def brute_top(rows, k=5):
    own = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in own:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in own if j != i and len(w) == len(v))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_cover_tree(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(i % 4, 0.2) for _ in range(6)]) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(3, None), (None, rows[1][1]), (4001, [None] * 6), (4002, [float("nan")] * 6), (4003, [float("inf")] * 6), (4050, [1.0, 2.0]), (4051, []), rows[9], (4100, [0.0] * 6), (4101, [0.0] * 6), rows[50], rows[50]]
    rows = [(i, v, 1, 2, 3) for i, v in rows]  # columns named as the operator names its own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, row int, v int").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # as floats hold them
    for group, block in ((4, 90), (10_000, 10_000)):
        got = cover_tree.top_k(df, query_group=group, data_block=block)
        assert sorted(tuple(r) for r in got.collect()) == brute_top(rows)
    assert cover_tree.top_k(df.where("false")).count() == 0


def test_cover_tree_is_exact_beyond_doubles(spark):
    big = float(1 << 22)
    rows = [(0, [big, 1 / 256]), (1, [big, 1 / 256]), (2, [big, 2 / 256]), (3, [big, 0.0]), (4, [-big, 5.0])]
    got = cover_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 2, 2**60 + 2), (0, 2, 1, 2**60 + 1), (0, 3, 3, 2**60), (0, 4, 4, -(2**60) + 1280)]


def test_cover_tree_covers():
    tree = cover_tree.Tree((np.random.default_rng(1).normal(size=(700, 8)) * 100).astype(np.int64))
    for n, rows in enumerate(tree.rows):
        assert np.sqrt(((tree.real[rows] - tree.points[n]) ** 2).sum(1)).max() <= tree.radii[n] + 1e-9
        assert np.arccos(np.clip(tree.unit[rows] @ tree.directions[n], -1, 1)).max() <= tree.angles[n] + 1e-6
        if tree.children[n]:
            assert sorted(np.concatenate([tree.rows[c] for c in tree.children[n]])) == sorted(rows)


def test_cover_tree_prunes():
    """On clustered vectors less than half of all pairs are scored, and the result is that of all pairs."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = (256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.15, (4000, 32)))).astype(np.int64)
    ids = np.arange(4000)
    queries = cover_tree.Queries(ids[::20], ids[::20], x[::20], 5)
    best = cover_tree.dual_search(queries.tree, queries.ids, cover_tree.Tree(x), ids, cover_tree.Best(200, 5, queries.needed))
    s = x[::20] @ x.T
    s[ids[::20][:, None] == ids[None]] = cover_tree.LEAST
    want = np.lexsort((np.broadcast_to(ids, s.shape), ~s), axis=1)[:, :5]
    assert (best.ids == want).all() and best.scored < 0.25 * s.size


def test_chat_escapes():
    rng = random.Random(5)
    parts = ["\\", *chat.CONTROL, "<", "[", "s>", "a", "/", "\n", "\\\\"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        role = "".join(rng.choice(parts) for _ in range(rng.randint(0, 3)))
        formatted, a, b = chat.segment(role, text)
        assert chat.unescape(chat.escape(text)) == text
        assert chat.read_turns(chat.BEGIN + formatted * 2) == [(role, text)] * 2
        assert chat.unescape(formatted[a:b]) == text


def chat_rows():
    rng = random.Random(14)
    rows = []
    for c in range(40):
        rows.append((c, 0, "system", "shared first turn"))
        rows.append((c, 1, "user", f"second {c % 3}"))
        rows += [(c, 2 + k, "assistant", f"</s> {c % 5} {k}") for k in range(c % 4)]
    rows += [(77, 0, None, None), (77, None, "user", "\\"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (5, 0, "system", "shared first turn")]
    return rows + [(88, 0, "user", prose(rng, "en", 9000)), (88, 1, "assistant", "[INST]" * 3000), (89, None, None, None)]


def chat_digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


@pytest.mark.parametrize("encode", [None, "ids"])
def test_chat(spark, encode):
    rows = chat_rows()
    # columns that the operator names itself
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, pack int, row int, turns int").repartition(3)
    tree = chat.prefix_tree(df, size=500, encode=(lambda text: [ord(c) % 1000 for c in text[::2]]) if encode else None)
    read = lambda out: Counter((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in out.collect())
    got = read(chat.read_back(tree, ordered=True))
    assert got == read(chat.read_back(tree.repartition(5)))  # in any order
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c if c is not None else (c, t), []).append((role or "", text or ""))
    assert Counter(r[:5] for r in got.elements()) == Counter((c if isinstance(c, int) else None, *chat_digest(turns)) for c, turns in own.items())
    nodes = [r for r in tree.collect() if r.segment is not None]
    assert sum(len(r.segment) for r in nodes) < sum(r[5] for r in got.elements())
    units = lambda r: r.ids if encode else r.segment
    for pack in by_id(nodes, "pack").values():
        at = 0
        by_node = {r.node: r for r in pack}
        assert len({(r.parent, r.segment) for r in pack}) == len(pack)  # shared turns stand once
        for r in sorted(pack, key=lambda r: r.start):
            assert r.start == at and r.end - r.start == len(units(r))
            at = r.end
            above = by_node.get(r.parent)
            assert r.position == (above.position + len(units(above)) if above else 0)
            assert sum(x.end - x.start for x in r.attend) == r.position  # all that stands before it, and nothing else
            if encode and r.role == "assistant":
                said = r.segment[r.learn_from : r.learn_to]
                assert r.ids[r.learn_ids_from : r.learn_ids_to] == [ord(c) % 1000 for c in said[::2]]
    assert chat.prefix_tree(df.where("false")).count() == 0


def test_chat_packs_end_between_first_turns(spark):
    """A first turn that some conversations share is emitted once, however full the pack."""
    rows = [(c, t, "user", f"{c // 5} {t} " * 20 if t else f"first {c // 5} " * 20) for c in range(50) for t in range(2)]
    tree = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1), size=700).collect()
    first = Counter(r.segment for r in tree if r.parent == 0)
    assert sum(first.values()) <= 10 + 3 and len({r.pack for r in tree}) > 3  # three bounds between four partitions


def test_merge_dropout(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), merge_dropout.load(path)
    plain = [t for _, t in TEXTS if t and "▁" not in t and "\x00" not in t]
    assert [x.tolist() for x in merge_dropout.encode_all(path, plain, 0.0, 1)] == [library.encode(t) for t in plain]
    rows = merge_dropout.digests(docs, path).collect()
    assert len(rows) == len(TEXTS) and all(r.lossless for r in rows)
    back = merge_dropout.decoded(merge_dropout.encoded(docs, path, dropout=0.5), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in TEXTS)
    one, two, three = (merge_dropout.encode_all(path, plain, 0.2, s) for s in (1, 1, 2))
    assert all((a == b).all() for a, b in zip(one, two)) and any(a.tolist() != b.tolist() for a, b in zip(one, three))
    assert merge_dropout.digests(none, path).count() == 0
    # many at once as one by one
    rng = random.Random(1)
    parts = ["".join(rng.choice(["the", "ing", "a", "er", "é", "中", "▁", "\n", " ", "  ", "   "]) for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    keys = np.array([rng.getrandbits(64) for _ in parts], np.uint64)
    flat, n = model.merge_all(np.array([ord(c) for p in parts for c in p], np.int32), np.array([len(p) for p in parts]), keys, 0.4)
    ends = np.cumsum(n)
    assert all(flat[e - k : e].tolist() == model.segment(p, 0.4, int(key)) for p, key, k, e in zip(parts, keys, n, ends))


def test_merge_dropout_varies_occurrences(spark):
    """A frequent word has several segmentations within a document and across documents, each candidate skipped as often as asked."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = merge_dropout.load(path)
    plain = merge_dropout.encode_all(path, ["running"], 0.0, 1)[0].tolist()
    text = " ".join(["running"] * 400)
    usual = sum(listed_agenda(model, " running", Drawn(k)) == plain for k in range(2000)) / 2000
    df = spark.createDataFrame([(1, text), (2, text), (None, text), (1, text)], "doc_id long, text string")
    got = [r.ids for r in merge_dropout.encoded(df, path, dropout=0.1).orderBy("doc_id").collect()]
    assert got[1] == got[2] and len({tuple(x) for x in got}) == 3  # repeated rows alike, other documents not
    for ids in got:
        words = Counter()
        at = 0
        while at < len(ids):
            end = at + 1
            while model.decode(ids[at:end]) not in ("running", " running"):
                end += 1
            words[tuple(ids[at:end])] += 1
            at = end
        assert sum(words.values()) == 400 and len(words) > 3
        assert abs(words[tuple(plain)] / 400 - usual) < 0.09
    # long stretches vary as well
    long = merge_dropout.encode_all(path, ["x" * 400, "x" * 400], 0.1, 1, [1, 2])
    assert long[0].tolist() != long[1].tolist()


def test_merge_dropout_skips_as_listed():
    """Remembered lists of skips give what the agenda gives that skips the same candidates."""
    model = merge_dropout.load(public_tokenizers.path("piece_bpe_32k.model"))
    words = [" running", " internationally", " the", " other"]
    codes, lens = np.array([ord(c) for w in words for c in w], np.int32), np.array([len(w) for w in words])
    plain, n = model.merge_all(codes, lens, None, 0.0)
    flat, m = model.merge_all(codes, lens, None, 0.0, np.zeros((4, 0), np.int16))
    starts = np.cumsum(m) - m
    assert np.delete(flat, starts).tolist() == plain.tolist() and flat[starts].tolist() == (lens - n).tolist()
    flat, m = model.merge_all(codes, lens, None, 0.0, np.array([[0], [1], [0], [2]], np.int16))
    ends = np.cumsum(m)
    for w, k, e, skip in zip(words, m, ends, [0, 1, 0, 2]):
        assert flat[e - k + 1 : e].tolist() == listed_agenda(model, w, {skip})


class Drawn:
    """A tenth of the candidates, drawn independently."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def __contains__(self, turn):
        return self.rng.random() < 0.1


def listed_agenda(model, stretch, skips):
    """The ids of a stretch whose candidates of the given numbers are skipped: by scores, then from the left."""
    sym, blocked, turn = [c.replace(" ", "▁") for c in stretch], set(), -1
    while True:
        pairs = [(model.rank[a + b], i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if a + b in model.rank and (i, a, b) not in blocked]
        if not pairs:
            return [model.ids[x] for x in sym]
        turn, (_, i) = turn + 1, min(pairs)
        if turn in skips:
            blocked.add((i, sym[i], sym[i + 1]))
        else:
            blocked = {(j - (j > i), a, b) for j, a, b in blocked}
            sym[i : i + 2] = [sym[i] + sym[i + 1]]


def test_memo_forgets_nothing_in_use():
    memo = spans.Memo(3)
    codes = np.frombuffer(b"aabbccddaabb", np.uint8)
    starts = np.arange(0, 12, 2)
    for _ in range(3):
        ids, n = spans.merged(memo, codes, starts, starts + 2, lambda k, a, b: (codes[a].astype(np.int32), np.ones(len(a), np.int64)))
        assert ids.tolist() == [97, 98, 99, 100, 97, 98] and n.tolist() == [1] * 6


def test_pairs():
    pairs = vector_bpe.Pairs([(1, 2), (3, 3)], [0, 1], {0: 3, 1: 4})
    assert pairs.merge(np.array([[1, 2, 1, 2], [2, 2, 1, 1]])).tolist() == [[4, -1, -1, -1], [2, 2, 1, 1]]
