"""Every operator on documents: odd rows, and results against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geoledger.llm import bpe, idfile, langid, packing, quality, rules, simhash, toxicity
from geoledger.llm.common import split_bucket
from geoledger.llm.docstats import stats
from geoledger.llm.pretoken import blocks
from geoledger.llm.tokens import default_tokenizer, encode

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, fp string, ids string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


TEXTS = {
    1: prose(1, 60), 2: prose(1, 60), 3: prose(1, 60) + " Extra", 4: "", 5: None, 6: "   \n\t ", 7: "one", 8: "one two", 9: prose(2, 3_000),
    10: "a" * 3_000, 11: "line one here\nline one here\n\nline two\n", 12: "<|endoftext|> don't stop  é中\U0001f600 1²", 13: "THE the The " * 40, 14: " lead", 15: "trail ",
}
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "own", 7, "f", "i") for i, t in TEXTS.items()]
    rows += [rows[0], (None, "nameless text of some words", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(default_tokenizer())
    made.encode_special_tokens = True
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Tokens


def test_encoding_equals_the_library(reference):
    rng = np.random.default_rng(3)
    letters = ["a", "b", ".", "#'", "\n", "don", " ", "  ", "\t", "'s", "1", "²", "é", "<|endoftext|>", "\U0001f600", "́", "中"]
    for _ in range(3_000):
        text = "".join(rng.choice(letters, rng.integers(0, 14)))
        assert np.frombuffer(encode(text, default_tokenizer()), "<u4").tolist() == [*reference(text), 0], text
        assert "".join(blocks(text, 3)) == text


# 1: packing


def test_packing_holds_every_id_once(docs, reference):
    got = packing.pack(docs).toPandas()
    by_doc = Counter()
    for row in got.itertuples():
        assert len(row.ids) == 4 * row.length
    for doc_id, text in TEXTS.items():
        own = got[got.doc_id == doc_id].sort_values(["start", "sequence_id"])
        copies = 2 if doc_id == 1 else 1
        ids = np.array([*reference(text), 0], "<u4")
        seen = np.zeros(len(ids), int)
        for row in own.itertuples():
            assert bytes(row.ids) == ids[row.start : row.start + row.length].tobytes() and row.doc_tokens == len(ids)
            seen[row.start : row.start + row.length] += 1
        assert (seen == copies).all()
        by_doc[doc_id] = len(own)
    assert got.doc_id.isna().sum() == 2
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    sizes = got.groupby("sequence_id").length.sum()
    assert (1024 - sizes).sum() < 1024


def test_packing_of_no_documents(empty):
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "one length", "huge counts", "short", "none"])
def test_plan_fills_sequences(kind):
    rng = np.random.default_rng(0)
    histogram = {"uniform": rng.integers(0, 90, 1024), "one length": np.bincount([700] * 10**5, minlength=1024), "huge counts": rng.integers(0, 10**9, 1024), "short": np.bincount([3] * 5_000, minlength=1024), "none": np.zeros(1024, int)}[kind]
    histogram[0] = 0
    rows, sequences = packing.plan(histogram)
    taken = np.zeros(1024, np.int64)
    for length, first, last, _, _ in rows:
        assert first == taken[length]
        taken[length] = last
    assert (taken == histogram).all() and len(rows) < 20_000
    assert 0 <= sequences * 1024 - (np.arange(1024) * histogram).sum() < 1024


def test_nnls_meets_its_conditions():
    histogram = np.zeros(1024)
    histogram[[100, 924, 300, 724, 512, 200]] = [50, 40, 30, 30, 10, 10]
    lengths = np.flatnonzero(histogram)
    combos = packing.combinations(lengths, histogram[lengths])
    x = packing.nnls(combos, histogram, sweeps=2_000, tolerance=1e-12)
    a = np.stack([np.bincount(c[c > 0], minlength=1024) for c in combos], axis=1)
    gradient = a.T @ (a @ x - histogram)
    assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient[x > 1e-9]).max() < 1e-6


# 2: SimHash


def brute_fingerprint(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints):
    """Least reachable place in a list, by all pairs."""
    root = list(range(len(fingerprints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= 2:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(fingerprints))]


def test_near_duplicates_of_odd_rows(docs):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    marks = {i: brute_fingerprint(t) for i, t in TEXTS.items()}
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == marks
    ids = sorted(marks)
    assert [got[i]["component_id"] for i in ids] == [ids[k] for k in classes([marks[i] for i in ids])]
    assert simhash.near_duplicates(docs).where("doc_id is null").select("component_id").distinct().count() == 2  # one is wordless, as document 4
    assert simhash.near_duplicates(docs).count() == docs.count()


@pytest.mark.parametrize("hot", [0, 2, 64])
def test_links_connect_all_within_two_bits(spark, hot):
    rng = np.random.default_rng(4)
    base = [int(v) for v in rng.integers(0, 2**63, 12)]
    near = [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (20, 2))]
    marks = sorted({*base, *near, *(n ^ (1 << 63) for n in near[::9])})
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot).collect()
    assert all(((a ^ b) % 2**64).bit_count() <= 2 and a != b for a, b in edges)
    place = {s: k for k, s in enumerate(signed)}
    root = list(range(len(signed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(place[a]), find(place[b])
        root[max(p, q)] = min(p, q)
    assert [find(i) for i in range(len(signed))] == classes(marks)


def test_representatives(docs, empty):
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in got.select("doc_id").collect()) == sorted([0, *(i for i in TEXTS if i not in (2, 5, 6) and not (i == 3 and (brute_fingerprint(TEXTS[3]) ^ brute_fingerprint(TEXTS[1])).bit_count() <= 2))])
    assert simhash.representatives(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


# 3: languages


def test_languages(spark, docs, empty):
    said = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "zwykle pisze krotkie zdania wczoraj", "cc": "huomenna menemme uimaan jarvelle taas"}
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(list(said.values())[k % 3].split(), 12)), list(said)[k % 3]) for k in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = split_bucket(F.col("doc_id"), 3) == 1
    languages, prototypes = langid.fit(table.where(~held))
    got = langid.identify(table.where(held), languages, prototypes).collect()
    assert languages == list(said) and got and all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in langid.identify(docs, languages, prototypes).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (4, 5, 6)) and odd[7]["lang_pred"] in said
    none = langid.fit(empty)
    assert none[0] == [] and {r["lang_pred"] for r in langid.identify(docs, *none).collect()} == {"und"}
    assert langid.identify(empty, languages, prototypes).count() == 0


def bound(text, dimensions):
    """A text's profile from its definition: letters bound to three-grams one by one, and added."""
    import re

    vector = lambda c: langid.letter_vectors(np.array([0 if c == " " else ord(c)]), dimensions)[0].astype(int)
    letters = "".join(c.lower()[:1] if c.isalpha() else " " for c in text)
    padded = " " + re.sub(" +", " ", letters).strip(" ") + " "
    total = np.zeros(dimensions, int)
    for k in range(len(padded) - 2):
        total += np.roll(vector(padded[k]), 2) * np.roll(vector(padded[k + 1]), 1) * vector(padded[k + 2])
    return total


def test_profile_is_the_sum_of_bound_letters(monkeypatch):
    monkeypatch.setattr(langid, "_BLOCK", 7)
    texts = ["Ab", "!?", "\U00010400", "Don't  stop, 42 times", "привет мир", "ひらがな カタカナ", "ΑΒΓ αβγ", ""]
    got, lettered = langid.bundle(texts, 64)
    for row, text, ok in zip(got, texts, lettered):
        assert ok == any(map(str.isalpha, text)) and (not ok or (row == bound(text, 64)).all()), text
    assert (got[[1, 7]] == 0).all()


def test_every_letter_has_its_own_vector():
    points = np.array([*range(0x3041, 0x3097), *range(0xAC00, 0xAC00 + 2_000), *range(0x430, 0x450), *range(0x3B1, 0x3C9), *range(97, 123)])
    vectors = langid.letter_vectors(points).astype(float)
    alike = vectors @ vectors.T / langid.DIMENSIONS
    np.fill_diagonal(alike, 0)
    assert np.abs(alike).max() < 0.25 and abs(vectors.mean()) < 0.01


def test_scripts_beyond_latin(spark):
    """Two languages in kana, two in Cyrillic, one in Latin letters; held-out texts against cosines of the definition."""
    rng = np.random.default_rng(3)
    letters = {"k1": "あいうえおかきくけこ", "k2": "さしすせそたちつてと", "c1": "абвгдежзик", "c2": "лмнопрстуф", "la": "abcdefghij"}
    syllables = {n: ["".join(rng.choice([*s, *"".join(letters.values())[:3]], 2)) for _ in range(12)] for n, s in letters.items()}
    text = lambda n: " ".join("".join(rng.choice(syllables[n], 3)) for _ in range(8))
    rows = [(k, text(n), n) for k, n in enumerate(list(letters) * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = split_bucket(F.col("doc_id"), 3) == 1
    languages, prototypes = langid.fit(table.where(~held), dimensions=256)
    got = {r["doc_id"]: r for r in langid.identify(table.where(held), languages, prototypes).collect()}
    assert np.mean([got[k]["lang_pred"] == n for k, _, n in rows if k in got]) > 0.95
    unit = lambda v: v / np.linalg.norm(v)
    learnt = {n: sum(np.rint(unit(bound(t, 256)) * 2**20) for k, t, m in rows if m == n and k not in got) for n in languages}
    assert all(np.allclose(learnt[n], p, atol=100) for n, p in zip(languages, prototypes))
    centre = np.mean([unit(learnt[n]) for n in languages], axis=0)
    for k, t, _ in rows[:60]:
        if k in got:
            cosines = [unit(bound(t, 256)) @ unit(unit(learnt[n]) - centre) for n in languages]
            best = int(np.argmax(cosines))
            share = 1 / sum(np.exp(langid.SHARPNESS * (c - cosines[best])) for c in cosines)
            assert got[k]["lang_pred"] == languages[best] and abs(got[k]["score"] - share) < 1e-3


def test_rare_languages_keep_their_rows(spark):
    rows = [(k, f"{'common words' if k else 'zeldzaam'} here", "big" if k else "rare") for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(table, per_language=5)[0] == ["big", "rare"]


# 5 and 6: classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(600):
        toxic, good = k % 10 == 0, k % 7 > 0
        text = prose(k + 10, int(rng.integers(30, 90)))
        if toxic:
            text += " you vilething " + " ".join(f"grumbla{s}" for s in rng.choice(["n", "st", "rt", "x"], 2))
        if not good:
            text = " ".join(w + "###" for w in text.upper().split())
        rows.append((k, text, "en", "s", len(text), None, None, None, None))
        if k % 2 == 0:
            labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_toxicity(labelled, docs, empty):
    table, labels = labelled
    model = toxicity.fit(table, labels)
    got = toxicity.score(table, model).select("doc_id", "score", "predicted").toPandas()
    assert (got.predicted == (got.doc_id % 10 == 0)).mean() > 0.98 and got.score.between(0, 1).all()
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and set(odd.columns) == {*docs.columns, "predicted"} and odd.where("predicted = 1").count() == 0
    nothing = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score(docs, nothing).where("score > 0.001").count() == 0 and toxicity.score(empty, nothing).count() == 0


def test_quality(labelled, docs, empty):
    table, labels = labelled
    model = quality.fit(table, labels)
    got = quality.score(table, model).select("doc_id", "score", "predicted").toPandas()
    assert (got.predicted == (got.doc_id % 7 > 0)).mean() > 0.98 and got.score.between(0, 1).all()
    assert quality.score(docs, model).count() == docs.count()
    nothing = quality.fit(empty, labels.limit(0))
    assert quality.score(docs, nothing).where("predicted = 0").count() == 0 and quality.score(empty, model).count() == 0


def test_labels_with_nulls_and_repeats(spark, labelled):
    table, _ = labelled
    odd = spark.createDataFrame([(None, 1, 1), (0, None, None), (10, 0, 1), (10, 1, 0), (20, 1, 1), (30, 0, 0)], LABELS)
    for model in (toxicity.fit(table, odd), quality.fit(table, odd)):
        assert len(model(["some text", ""])) == 2
    rules.fit(table, odd)


# 9: rules


def brute_stats(text):
    words, text = words_of(text), text or ""
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dups += line in seen
            seen.add(line)
    counts = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    repeated = {j for k in range(len(words) - 7) if counts[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(repeated)


def test_statistics_against_brute_force():
    rng = np.random.default_rng(6)
    texts = [t or "" for t in TEXTS.values()] + ["".join(rng.choice([*"ab#|\n ", " ", "\x1c"], 60)) for _ in range(300)] + ["x y " * 20, "a b c d e f g h " * 2 + "z"]
    for t in texts:
        s = stats(t)
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_stats(t), t


def test_rules(labelled, docs, empty):
    table, labels = labelled
    model = rules.fit(table, labels)
    got = rules.judge(table, model).select("doc_id", "kept").toPandas()
    assert (got.kept == (got.doc_id % 7 > 0)).mean() > 0.98
    odd = rules.judge(docs, model)
    assert odd.count() == docs.count() and odd.where("kept and base_failed").count() == 0 and rules.judge(empty, model).count() == 0
    nothing = rules.fit(empty, labels.limit(0))
    assert nothing is None and rules.judge(docs, nothing).where("kept = base_failed").count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(7)
    x = rng.random((3_000, 3))
    y = ((x[:, 0] < 0.4) ^ (rng.random(3_000) < 0.15) | (x[:, 1] > 0.7)).astype(float)
    signs = np.array([-1, 0, 1])
    model = rules.fit_trees(x, y, signs)
    probe = np.repeat(rng.random((200, 3)), 50, axis=0)
    for f in (0, 2):
        moved = probe.copy()
        moved[:, f] = np.tile(np.linspace(0, 1, 50), 200)
        steps = np.diff(model(moved).reshape(200, 50), axis=1)
        assert (steps * signs[f] >= -1e-12).all()
    assert ((model(x) > 0) == (y > 0)).mean() > 0.85


# 8: byte-level BPE


def test_bpe_equals_the_library(docs):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.default_ranks())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert len(both) == docs.count()
    for row in both:
        if row["doc_id"] is not None:
            text = TEXTS[row["doc_id"]] or ""
            assert row["ids"] == library.encode_ordinary(text) and bytes(row["decoded"]) == text.encode()
    coder, rng = bpe.TreeBpe(ranks, leaf=2), np.random.default_rng(8)
    tokens = list(ranks)
    for k in range(2_000):
        data = b"".join(tokens[i] for i in rng.integers(0, len(tokens), rng.integers(1, 10))) if k % 2 else bytes(rng.choice(list(b"aab=- th"), rng.integers(1, 120)))
        assert coder.piece(data) == library._encode_single_piece(data) and coder.merge_long(data) == coder.merge(data)
        assert coder.decode(coder.piece(data)) == data
    for data in (b"a" * 20_000, b"ab" * 9_000):
        assert coder.piece(data) == library._encode_single_piece(data)


def test_bpe_of_no_documents(empty):
    assert bpe.decode_documents(bpe.encode_documents(empty)).count() == 0


# 10: files


def test_files_hold_all_ids_in_order(spark, docs, reference, tmp_path):
    path = idfile.write_ids(docs, str(tmp_path / "set"))
    got = [r for r in idfile.read_ids(spark, path).collect()]
    assert len(got) == docs.count()
    at = 0
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == at and row["n_tokens"] * 4 == len(row["ids"])
        if row["doc_id"] is not None:
            assert np.frombuffer(bytes(row["ids"]), "<u4").tolist() == [*reference(TEXTS[row["doc_id"]]), 0]
        at += row["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [None, None, *sorted([1, *TEXTS])]
    some = idfile.read_ids(spark, path, only=[3, 9, 99]).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 9] and {r["start"] for r in some} <= {r["start"] for r in got}


def test_files_of_no_documents(spark, empty, tmp_path):
    assert idfile.read_ids(spark, idfile.write_ids(empty, str(tmp_path / "none"))).count() == 0


def test_a_trained_dictionary_is_needed_and_shared():
    rng = np.random.default_rng(9)
    samples = [np.concatenate((np.arange(40), rng.integers(0, 500, 60))).astype("<u4").tobytes() for _ in range(200)]
    data = idfile.train_dictionary(samples)
    writer = idfile.BlockWriter(0, data)
    for k, s in enumerate(samples):
        writer.add(k, s)
    row = writer.block()
    assert data and row[7] == idfile.dictionary_hash(data)
    assert [i for _, _, i in idfile.read_block(row[8], row[9], row[11], data)] == samples
    assert [(d, i) for _, d, i in idfile.read_block(row[8], row[9], row[11], data, {7})] == [(7, samples[7])]
    plain = idfile.BlockWriter(0, b"")
    for k, s in enumerate(samples):
        plain.add(k, s)
    assert len(row[11]) < len(plain.block()[11])


def test_rows_of_one_id_are_no_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "TASK_BYTES", 4_000)
    rows = spark.range(600).selectExpr("if(id % 2 = 0, null, 7) as doc_id", "repeat(concat('word ', id, ' '), 20) as text")
    path = idfile.write_ids(rows, str(tmp_path / "hot"))
    parts = [r["n"] for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert len(parts) > 6 and max(parts) < 200
    got = idfile.read_ids(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 300 + [7] * 300 and got[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


def test_another_dictionary_is_refused(spark, docs, tmp_path):
    path = idfile.write_ids(docs, str(tmp_path / "set"))
    name = spark.read.parquet(f"{path}/dictionary").first()["dictionary"]
    spark.createDataFrame([(name, bytearray(b"other"))], "dictionary string, data binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="dictionary"):
        idfile.read_ids(spark, path)


# Registered queries


def test_registered_digests(spark, tmp_path, docs):
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    from geoledger.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op8_byte_bpe"](spark, str(tmp_path)).collect()}
    for doc_id, text in TEXTS.items():
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    for name in ("op1_packing", "op2_simhash", "op3_language_id", "op5_toxicity", "op6_quality", "op9_quality_rules", "op10_token_files"):
        rows = QUERIES[name](spark, str(tmp_path)).select("doc_id").distinct().count()
        assert rows == len(TEXTS), name
    for row in QUERIES["op10_token_files"](spark, str(tmp_path)).collect():
        assert row["ids_crc32"] == zlib.crc32(encode(TEXTS[row["doc_id"]] or "", default_tokenizer(), True))
