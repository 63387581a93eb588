"""Each operator against brute force, on rows with nulls, empty, long and repeated texts, and on columns with clashing names."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillsift.llm import ann, bpe, exact_dedup, graph, language, licenses, line_dedup, packing, quality, simhash, substring_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, h long, h1 long, k long, k1 long, d long, pos int, line string, part int, ids string, score double, fp long, n int, line_text string, "
    "gone string, first int, length long, variant int, recipe string, site string, id long, component_id long, word string, count long"
)
EXTRA = (7, 7, 7, 7, 7, 7, "x", 7, "x", 0.5, 7, 7, "x", "x", 7, 7, 7, "x", "x", 7, 7, "x", 7)


def rows(seed=3):
    """(doc_id, text, lang, source): prose from a few words, copies, near copies, shared passages and the odd cases."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "al be co du em fi go ha".split() for b in "ra so ti vu we xy zo".split()]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, shared_lines = prose(60), [prose(6) for _ in range(5)]
    out = []
    for i in range(140):
        text = "\n".join(prose(r.randrange(1, 40)) for _ in range(r.randrange(1, 5)))
        if i % 7 == 0:
            text += "\n" + r.choice(shared_lines)
        if i % 11 == 0:
            text = prose(5) + " " + passage + " " + prose(3)
        if i % 13 == 0 and out:
            text = r.choice(out)[1] or ""
        if i % 17 == 0 and out:
            w = (r.choice(out)[1] or "a b").split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        out.append((i, text, "en" if i % 3 else "fr", f"s{i % 9}"))
    odd = [None, "", " ", "\n\n", "one", "Released under the MIT License.", "日本語 テキスト", "<|endoftext|> and <|ENDOFTEXT|>", "x " * 30000, "café́  \x1c İ ǅ 'S"]
    out += [(200 + i, t, "en", "s1") for i, t in enumerate(odd)]
    out += [(None, "no id here", "en", "s2"), (5, out[5][1], "en", None), (3, "the same id with another text", None, "s3")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    data = [(*x, len(x[1]) if x[1] is not None else None, *EXTRA) for x in rows()]
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return Counter(tuple(r) for r in df.collect())


def test_small_batches(spark):
    from quillsift.llm.common import BATCH_BYTES, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for before, after in (("64m", BATCH_BYTES), ("1g", BATCH_BYTES), ("67108864b", BATCH_BYTES), ("1k", 1024), (str(BATCH_BYTES), BATCH_BYTES)):
        spark.conf.set(key, before)
        small_batches(spark.range(1))
        assert spark.conf.get(key).rstrip("b") in (str(after), "1k")
    spark.conf.unset(key)


def test_kept_tables():
    """A worker's tables stay from task to task of one kind, and go when a task of another kind begins."""
    from quillsift.llm import common

    made = []
    for kind, again in (("a", 1), ("a", 0), ("b", 1), ("b", 0), ("a", 1)):
        common.start_task(kind)
        common.kept(kind, "x", lambda: made.append(1) or object())
        assert len(made) == again
        made.clear()
        assert {k for k, _ in common._KEPT} == {kind}


def test_tables_outlive_tasks(spark):
    """The second task of a worker finds what the first one learnt: Spark's copies of functions share the module's tables."""
    import pyarrow as pa

    from quillsift.llm import packing as own

    def run(batches):
        for batch in batches:
            encoder = own.encoder_of(WORD_BPE)
            known = len(encoder.known)
            list(encoder.encode_many([b"some words to learn"]))
            yield pa.RecordBatch.from_arrays([pa.array([known] * batch.num_rows, pa.int64())], ["known"])

    counts = [spark.range(1).coalesce(1).mapInArrow(run, "known long").collect()[0]["known"] for _ in range(2)]
    assert counts[1] >= 4


# 1 licences


def brute_phrases(text):
    words = licenses.words_of((text or "").encode())
    found = [(i, label) for p, label in licenses.BASE_PHRASES.items() for q in [p.encode().split()] for i in range(len(words)) if words[i : i + len(q)] == q]
    return len(words), sorted(found)


def test_license_phrases(docs, none):
    texts = {x[1] for x in rows()}
    scanner = licenses.LicenseScanner()
    for text in texts | {"MIT license mit License apache license general public license", "mit mit license license", "the gnu general public license v3"}:
        n, found = brute_phrases(text)
        got = scanner.scan((text or "").encode())
        assert (got["n_words"], got["n_base"]) == (n, len(found))
        assert got["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert (got["first_word"], got["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert set(got["base_labels"].split(",")) <= set(got["labels"].split(",")) or not found
        assert 0 <= got["score"] <= 1
    assert licenses.scan_documents(docs).count() == docs.count()
    assert licenses.scan_documents(none).count() == 0


def test_license_matching_statistics():
    r = random.Random(1)
    templates = [[r.randrange(4) for _ in range(r.randrange(3, 20))] for _ in range(5)]
    automaton = licenses.SuffixAutomaton(templates)
    known = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    text = [r.randrange(5) for _ in range(300)]
    for i, (_, n) in enumerate(automaton.statistics(text)):
        assert n == max((m for m in range(1, i + 2) if tuple(text[i + 1 - m : i + 1]) in known), default=0)


def test_license_spans():
    scanner = licenses.LicenseScanner()
    full = licenses.TEMPLATES[0][1].encode()
    got = scanner.scan(b"Some words before. " + full + b" And after.")
    assert "mit" in got["labels"].split(",")
    assert max(s["coverage"] for s in got["spans"]) == 1.0
    changed = full.replace(b"free of charge", b"at no cost").replace(b"sublicense", b"lend")
    assert "mit" in scanner.scan(changed)["labels"].split(",")
    assert scanner.scan(b"Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc"
    assert scanner.scan(b"permission to use the copy of the work in the house")["labels"] == ""


def brute_spans(templates, text, settings=licenses.Settings()):
    """Spans by looking for every stretch of words in every template."""
    split = [licenses.words_of(t.encode()) for _, t in templates]
    words = licenses.words_of(text.encode())
    places = defaultdict(list)
    for k, t in enumerate(split):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                places[tuple(t[i:j])].append((k, i))
    longest = [next((n for n in range(i + 1, 0, -1) if tuple(words[i + 1 - n : i + 1]) in places), 0) for i in range(len(words))]
    anchors = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= settings.min_match and (i + 1 == len(words) or longest[i + 1] <= n)]
    out = []
    for k, t in enumerate(split):
        chains = []  # first word, last word, last place, words
        for at, n in anchors:
            for q, begin in places[tuple(words[at : at + n])]:
                if q != k:
                    continue
                end, now = begin + n - 1, chains[-1] if chains else None
                if now and begin > now[2] and 0 < at - now[1] <= settings.max_gap:
                    now[1:] = [at + n - 1, end, now[3] + n]
                elif now and at <= now[1]:
                    grown = at + n - 1 - now[1]
                    if grown > 0 and end - grown >= now[2]:
                        now[1:] = [at + n - 1, end, now[3] + grown]
                else:
                    chains.append([at, at + n - 1, end, n])
        least = settings.short_coverage if len(t) <= settings.short_words else settings.min_coverage
        out += [(k, a, b, n / len(t)) for a, b, _, n in chains if n / len(t) >= least]
    return sorted(out)


def test_license_spans_equal_brute_force(spark, monkeypatch):
    """Texts of cut, changed, repeated and mixed templates, with the built-in and with own templates."""
    r = random.Random(18)
    own = tuple((f"l{k % 3}", " ".join(r.choices("abcdefgh", k=r.randrange(3, 25)))) for k in range(9))
    for templates in (licenses.TEMPLATES, own):
        scanner = licenses.LicenseScanner(templates)
        texts = []
        for _ in range(60):
            parts = []
            for _ in range(r.randrange(1, 4)):
                w = r.choice(templates)[1].split()
                a = r.randrange(len(w))
                w = w[a:] + w[: r.randrange(3)] if r.random() < 0.3 else w
                parts += [x if r.random() > 0.05 else "other" for x in w] + ["between"] * r.randrange(3)
            texts.append(" ".join(parts))
        for text in texts:
            got = sorted((s["template"], s["first_word"], s["last_word"], s["coverage"]) for s in scanner.scan(text.encode())["spans"])
            assert got == brute_spans(templates, text)
        monkeypatch.setattr(licenses, "TABLE_WORDS", 1)
        untabled = licenses.LicenseScanner(templates)
        assert [untabled.scan(t.encode()) for t in texts] == [scanner.scan(t.encode()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "`an id` long, `a.text` string")
    got = licenses.scan_documents(df, id_col="an id", text_col="a.text", templates=own, phrases={"a b": "ab"}).collect()
    assert {x["doc_id"]: [s["template"] for s in x["spans"]] for x in got} == {i: [k for k, *_ in brute_spans(own, t)] for i, t in enumerate(texts)}
    assert {x["doc_id"]: x["n_base"] for x in got} == {i: sum(t.split()[j : j + 2] == ["a", "b"] for j in range(len(t.split()))) for i, t in enumerate(texts)}
    for bad in (dict(templates=(("x", "two words"),)), dict(phrases={"one": "x"})):
        with pytest.raises(ValueError, match="template"):
            licenses.LicenseScanner(**bad)


def test_license_long_text():
    scanner = licenses.LicenseScanner()
    got = scanner.scan(b"plain words \xc3\xa9 here " * 200_000 + licenses.TEMPLATES[0][1].encode() + b" mit license")
    assert got["n_words"] == 800_000 + len(licenses.words_of(licenses.TEMPLATES[0][1].encode())) + 2
    assert (got["labels"], got["n_base"], got["first_word"]) == ("mit", 1, got["n_words"] - 2) and got["spans"][0]["first_word"] == 800_000


# 2 lines


def brute_lines(data, least):
    sites, first = defaultdict(set), {}
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    for i in order:
        for p, line in enumerate((data[i][1] or "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(data[i][3])
                first.setdefault(line.strip(" "), (i, p))
    out = {}
    for i, (d, text, _, _) in enumerate(data):
        if text is None:
            out[i] = None
            continue
        keep = [x for p, x in enumerate(text.split("\n")) if len(sites[x.strip(" ")] - {None}) < least or first[x.strip(" ")] == (i, p)]
        out[i] = "\n".join(keep)
    return out


@pytest.mark.parametrize("least", [2, 4])
def test_lines(spark, docs, none, least):
    data = [x for x in rows() if x[0] not in (3, 5, None)]
    df = docs.where("doc_id NOT IN (3, 5)")
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.mark_lines(df, least).collect()}
    assert got == {data[i][0]: t for i, t in brute_lines(data, least).items()}
    clashing = df.withColumns({"n_lines": F.lit(1), "n_removed": F.lit("x"), "kept_text": F.lit("y")})
    kept = line_dedup.dedup_lines(clashing, least)
    assert kept.columns == clashing.columns and [f.dataType for f in kept.schema] == [f.dataType for f in clashing.schema]
    assert {r["n_removed"] for r in kept.collect()} == {"x"}
    assert line_dedup.dedup_lines(docs, least).count() > 100
    assert line_dedup.mark_lines(none, least).count() == 0


def test_line_near_threshold_is_exact(spark):
    """Many sites: a sketch is off, the count at the threshold isn't."""
    data = [(i, f"line{k}", None, f"site{i}") for k, n in enumerate((2999, 3000, 3001)) for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    removed = {r["text"]: r["n"] for r in line_dedup.mark_lines(df, 3000).where("n_removed > 0").groupBy("text").agg(F.count("*").alias("n")).collect()}
    assert removed == {"line1": 2999, "line2": 3000}


def test_many_lines_and_odd_names(spark):
    """Two hundred thousand lines in a text, half of them boilerplate, in columns named like the operator's own."""
    common = [f"common {i}" for i in range(100_000)]
    texts = ["\n".join(x for i, c in enumerate(common) for x in (c, f"own {d} {i}")) for d in range(3)]
    data = [(d, t, f"s{d}", "x", 1, 2, 3) for d, t in enumerate(texts)] + [(9, None, "s9", "x", 1, 2, 3)]
    df = spark.createDataFrame(data, "`the id` long, `a.text` string, k1 string, c0 string, gone int, kept int, pos int")
    began = time.perf_counter()
    kept = line_dedup.dedup_lines(df, 3, "the id", "a.text", "k1")
    got = {r["the id"]: r for r in kept.collect()}
    assert time.perf_counter() - began < 60
    assert kept.columns == df.columns and [f.dataType for f in kept.schema] == [f.dataType for f in df.schema]
    assert got[0]["a.text"] == texts[0] and got[9]["a.text"] is None
    for d in (1, 2):
        assert got[d]["a.text"] == "\n".join(f"own {d} {i}" for i in range(100_000)) and tuple(got[d])[2:] == (f"s{d}", "x", 1, 2, 3)


# 3 BPE


@pytest.fixture(scope="module")
def reference_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def test_bpe_equals_library(docs, none, reference_bpe):
    codec = bpe.SpeculativeBpe(BYTE_BPE)
    r = random.Random(2)
    texts = [x[1] or "" for x in rows()] + ["".join(r.choice(" \n\t\x1c\x85\xa0abcdethe's'll12３éàß́中😀<|endoftext|>.,!ǅΣ") for _ in range(r.randrange(40))) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode_many([t.encode() for t in texts]), strict=True):
        assert ids == reference_bpe.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids).decode() == reference_bpe.decode(ids, skip_special_tokens=False) == text
    assert codec.speculated and codec.merged
    tokens = bpe.encode_documents(docs, BYTE_BPE)
    assert collected(bpe.decode_documents(tokens, BYTE_BPE)) == collected(docs.select("doc_id", F.coalesce("text", F.lit(""))))
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(docs.where("doc_id >= 200"), BYTE_BPE).collect()}
    for d, text, *_ in rows()[140:150]:
        ids = reference_bpe.encode(text or "", add_special_tokens=False).ids
        assert digests[d]["n_tokens"] == len(ids)
        assert digests[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[d]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip_digests(none, BYTE_BPE).count() == 0


def test_bpe_pairs_of_tokens():
    codec = bpe.SpeculativeBpe(BYTE_BPE)
    r = random.Random(4)
    words = [b"".join(r.choices(codec.bytes_of[:50000], k=r.randrange(1, 5))) for _ in range(4000)]
    words = [w for w in words if w]
    assert codec.encode_words(words) == [codec.exact(w) for w in words]


def test_bpe_long_words_and_texts(reference_bpe, monkeypatch):
    """A word of a megabyte takes seconds, and texts that are split in stretches are encoded as wholes."""
    codec, r = bpe.SpeculativeBpe(BYTE_BPE), random.Random(5)
    word = "".join(r.choices("abcdefghijklmnopqrst", k=1 << 20))
    for text in (word, "a" * 200_000, word[:5000] + "é" * 5000, "=" * 70_000 + word[:3000]):
        assert codec.encode(text.encode()) == reference_bpe.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "STRETCH", 50)
    monkeypatch.setattr(bpe, "LONG_WORD", 3)
    for _ in range(200):
        text = "".join(r.choice(["word", "  ", " ", "'s", "12", "é", "<|endoftext|>", "\n", " \t", "x", "中", "..."]) for _ in range(300))
        for _ in range(2):
            assert next(codec.encode_many([text.encode()])) == reference_bpe.encode(text, add_special_tokens=False).ids
        codec.known.clear()
        codec.old.clear()


def test_bpe_other_vocabularies():
    with pytest.raises(ValueError, match="normaliser"):
        bpe.SpeculativeBpe(WORD_BPE)


def test_bpe_small_table():
    """The table of known runs may be dropped at any time."""
    codec = bpe.SpeculativeBpe(BYTE_BPE, entries=3)
    texts = [f"word{i} other{i}" for i in range(50)]
    assert [codec.decode(codec.encode(t.encode())).decode() for t in texts] == texts


# 4 languages


def test_language(spark, docs, none):
    r = random.Random(5)
    syllables = {"aa": "ka to mi ru ne".split(), "bb": "sch ung ein der ach".split(), "cc": "que aux oi ent ille".split()}
    data = []
    for i in range(600):
        lang = r.choice(list(syllables))
        data.append((i, " ".join("".join(r.choices(syllables[lang], k=r.randrange(1, 4))) for _ in range(r.randrange(5, 60))), lang))
    data += [(700, None, "aa"), (701, "123 !!! ...", "bb"), (702, "", None), (None, "kato miru", "aa"), (703, "kato miru kato", None), (704, "Ωμέγα δέλτα " * 80, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.learn(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = {r["doc_id"]: r for r in language.predict_documents(df, model).collect()}
    held_out = [x for x in data[:600] if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert sum(got[d]["lang_pred"] == lang for d, _, lang in held_out) > 0.99 * len(held_out)
    assert all(got[d]["accepted"] for d, *_ in held_out)
    for d in (700, 701, 702):
        assert (got[d]["lang_pred"], got[d]["score"], got[d]["accepted"]) == ("und", 0.0, False)
    assert got[None]["lang_pred"] == got[703]["lang_pred"] == "aa"
    assert not got[704]["accepted"]
    assert len(got) == len(data)
    kept = language.keep_known(df, model)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["accepted"]}
    unlearnt = language.learn(none, F.lit(True))
    assert {r["lang_pred"] for r in language.predict_documents(docs, unlearnt).collect()} == {"und"}
    assert language.keep_known(docs, language.learn(docs, F.lit(True))).count() > 100
    assert language.predict_documents(none, unlearnt).count() == 0


def test_language_copies(spark):
    """Thousands of copies of few texts are learnt from like one of each."""
    texts = [(0, "kato miru neka toka mika runeto"), (1, "mito kane rumi tone"), (2, "schung einder achung derach")]
    own = [(10 + i, "queaux oient illeque " * (1 + i % 7) + f"{'abcdefghij'[i % 10]}oi{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}") for i in range(500)]
    few = spark.createDataFrame([(i, t, "aa" if i < 2 else "bb" if i == 2 else "cc") for i, t in texts + own], "doc_id long, text string, lang string")
    many = few.join(spark.range(6000).select(F.lit(1).alias("x")), F.col("doc_id") <= 2).drop("x").union(few)
    plain, model = (language.learn(df, F.lit(True)) for df in (few, many))
    assert model.languages == ["aa", "bb", "cc"]
    assert set(model.of.tolist()) == {0, 1, 2} and np.isfinite(model.radius).all()
    assert np.array_equal(plain.centroids, model.centroids) and np.array_equal(plain.radius, model.radius) and np.array_equal(plain.idf, model.idf)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_documents(few, model).collect()}
    assert [got[i] for i in (0, 1, 2)] == ["aa", "aa", "bb"]


def language_texts(n, seed=5):
    r = random.Random(seed)
    syllables = {"aa": "ka to mi ru ne".split(), "bb": "sch ung ein der ach".split(), "cc": "que aux oi ent ille".split()}
    langs = [r.choice(list(syllables)) for _ in range(n)]
    return [(i, " ".join("".join(r.choices(syllables[lang], k=r.randrange(1, 4))) for _ in range(r.randrange(5, 60))), lang) for i, lang in enumerate(langs)]


def test_language_hot_copy(spark):
    """However small its hash is, one text's copies don't stand for their language."""
    data = language_texts(1500)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    hot = df.where("lang = 'aa'").orderBy(F.shiftrightunsigned(F.xxhash64("text"), 1)).limit(1)
    many = df.union(hot.join(spark.range(3000).select(F.lit(1).alias("x")), F.lit(True)).drop("x"))
    model = language.learn(many, F.lit(True))
    assert [model.of.tolist().count(i) for i in range(3)] == [language.CLUSTERS] * 3
    got = {r["doc_id"]: r for r in language.predict_documents(df, model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in data) > 0.99 * len(data)
    assert sum(got[i]["accepted"] for i, *_ in data) >= 0.99 * len(data)


def test_language_sample_is_bounded(spark):
    df = spark.createDataFrame(language_texts(600), "doc_id long, text string, lang string")
    small = language.fit(df, per_language=50, max_fit_rows=90)  # 30 of each
    least = df.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1)).toPandas().sort_values("h").groupby("lang").head(30)
    again = language.fit(spark.createDataFrame(least[["text", "lang"]]), per_language=50, max_fit_rows=90)
    assert np.array_equal(small.centroids, again.centroids) and np.array_equal(small.idf, again.idf)
    with pytest.raises(ValueError, match="languages"):
        language.fit(spark.range(9).select(F.col("id").cast("string").alias("text"), F.col("id").cast("string").alias("lang")), max_fit_rows=4)


def test_language_equals_dense_model(spark):
    """Predictions equal those of a dictionary-based TF-IDF and dense centroids made from the same sample."""
    data = [(*x[:2], "aa" if x[2] == "cc" else x[2]) for x in language_texts(120)] + [(500 + i, t, "zz") for i, t in enumerate(("Ωμέγα δέλτα", "γάμμα Ωμέγα", "12 ab, AB!"))]
    model = language.learn(spark.createDataFrame(data, "doc_id long, text string, lang string"), F.lit(True))

    def grams(text):
        raw = b" " + "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in text).encode().lower() + b" "
        found = Counter()
        for width, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
            for i in range(len(raw) - width + 1):
                if (gram := raw[i : i + width]) != b" " * width:
                    found[int.from_bytes(gram, "big") * salt % 2**32 >> 19] += 1
        return found

    counted = {t: grams(t) for _, t, _ in data}
    idf = [np.log((1 + len(data)) / (1 + sum(k in c for c in counted.values()))) + 1 for k in range(language.DIMENSIONS)]

    def vector(c):
        v = np.array([np.log1p(c[k]) * idf[k] for k in range(language.DIMENSIONS)])
        return v / np.linalg.norm(v)

    vectors = {t: vector(c) for t, c in counted.items()}
    centroids = []
    for lang in ("aa", "bb", "zz"):
        own = sorted((t for _, t, x in data if x == lang), key=lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 1)
        x = np.array([vectors[t] for t in own])
        seeds = [x.mean(axis=0) / np.linalg.norm(x.mean(axis=0))]
        while len(seeds) < min(4, len(x)):
            seeds.append(min(x, key=lambda v: max(v @ s for s in seeds)))
        for _ in range(10):
            parts = [[v for v in x if max(range(len(seeds)), key=lambda j: v @ seeds[j]) == k] for k in range(len(seeds))]
            seeds = [np.mean(p, axis=0) / np.linalg.norm(np.mean(p, axis=0)) for p in parts if p]
        centroids += [(s, lang) for s in seeds]
    assert len(centroids) == len(model.centroids)
    names, scores, _ = model.predict([t.encode() for _, t, _ in data])
    for (_, t, _), name, score in zip(data, names, scores, strict=True):
        best = max(centroids, key=lambda c: vectors[t] @ c[0])
        assert name == best[1] and abs(score - vectors[t] @ best[0]) < 1e-3


def test_language_long_text(monkeypatch):
    r = random.Random(14)
    text = "".join(r.choice("abc .é") for _ in range(5000)).encode()
    whole = language.counts([text])
    monkeypatch.setattr(language, "_BYTES", 333)
    assert np.array_equal(language.counts([text]), whole)


# 5 exact


def test_exact(docs, none):
    normal = lambda t: exact_dedup.normalise((t or "").encode())
    data = rows()
    groups = defaultdict(list)
    for d, t, *_ in data:
        groups[normal(t)].append(d)
    want = Counter()
    for d, t, *_ in data:
        g = groups[normal(t)]
        keep = min((x for x in g if x is not None), default=None)
        want[d, keep, len(g), d == keep, hashlib.sha256(normal(t)).hexdigest()] += 1
    assert collected(exact_dedup.exact_groups(docs)) == want
    assert exact_dedup.exact_groups(none).count() == 0


def test_chunks_depend_on_their_text_only():
    r = random.Random(6)
    texts = [bytes(r.randrange(97, 123) for _ in range(n)) for n in (0, 1, 600, 5000, 90000)] + [b"a" * 60000]
    alone = [next(exact_dedup.cuts([t])) for t in texts]
    assert list(exact_dedup.cuts(texts)) == alone == list(exact_dedup.cuts(texts[::-1]))[::-1]
    for t, ends in zip(texts, alone, strict=True):
        assert ends[-1] == len(t) and all(b - a <= exact_dedup.MOST for a, b in zip([0, *ends], ends))
    tail = texts[4][1000:]
    shared = {texts[4][a:b] for a, b in zip([0, *alone[4]], alone[4])} & {tail[a:b] for (ends,) in [list(exact_dedup.cuts([tail]))] for a, b in zip([0, *ends], ends)}
    assert len(shared) > 20


@pytest.mark.parametrize("share", [1, 2])
def test_colliding_chunks_are_told_apart(docs, monkeypatch, share):
    """Even if every hash, or every other one, were the same, equal recipes would mean equal texts."""
    real = exact_dedup.identifier
    want = collected(exact_dedup.exact_groups(docs))
    assert exact_dedup.colliding(docs).count() == 0
    monkeypatch.setattr(exact_dedup, "identifier", lambda c: b"one for all here" if len(c) % share == 0 else real(c))
    assert exact_dedup.colliding(docs).count() == 1
    assert collected(exact_dedup.exact_groups(docs)) == want


def test_exact_long_texts(spark, monkeypatch):
    r = random.Random(13)
    long = " ".join(f"w{r.randrange(1 << 30)}" for _ in range(400_000))
    data = [(3, long), (2, long.replace(" ", "\n \t")), (1, long[:-1] + "x"), (4, long + " ")]
    got = {x["doc_id"]: x["keep_id"] for x in exact_dedup.exact_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}
    raw = [exact_dedup.normalise(long.encode()), b"ab " * 9000, b""]
    whole = list(exact_dedup.cuts(raw))
    monkeypatch.setattr(exact_dedup, "PART", 1000)
    assert list(exact_dedup.cuts(raw)) == whole


# 6 SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, ids, most=4):
    codes = np.asarray(codes, np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= most
    label = np.arange(len(codes))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(codes))])
        if (new == label).all():
            break
        label = new
    least = {}
    for i, k in enumerate(label.tolist()):
        if ids[i] is not None:
            least[k] = min(least.get(k, ids[i]), ids[i])
    return [least.get(k) for k in label.tolist()]


def test_simhash(docs, none):
    data = rows()
    codes = [brute_fingerprint(t) if len(t or "") < 9000 else simhash.fingerprint(t.encode()) for _, t, *_ in data]
    want = Counter(zip([x[0] for x in data], np.asarray(codes, np.uint64).view(np.int64).tolist(), brute_components(codes, [x[0] for x in data]), strict=True))
    assert collected(simhash.near_duplicates(docs)) == want
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for (d, _, c), n in want.items() for _ in range(n) if d is None or d == c)
    assert simhash.near_duplicates(none).count() == 0


def test_keep_first_shared_and_null_ids(spark):
    """One document of each group stays, though ids are shared or null; a repeated row goes with its document."""
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(60)) for w in ("al", "be", "co", "du"))
    data = [(1, one), (7, one), (7, two), (9, two), (None, two), (None, three), (None, three), (4, four), (4, " " + four), (4, four + " ")]
    kept = Counter(map(tuple, simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string")).collect()))
    fours = {x: n for x, n in kept.items() if x[0] == 4}
    assert len(fours) == 1 and set(fours.values()) == {1}
    assert {x: n for x, n in kept.items() if x[0] != 4} == {(1, one): 1, (7, two): 1, (None, three): 2}


def test_fingerprint_of_long_texts(monkeypatch):
    from quillsift.llm import common

    r = random.Random(17)
    texts = [" \t".join(f"W{r.randrange(5000)}" for _ in range(n)) for n in (0, 1, 3, 4, 5, 7, 50, 900)] + ["x" * 500 + " b c d"]
    whole = [simhash.fingerprint(t.encode()) for t in texts]
    assert whole == [brute_fingerprint(t) for t in texts]
    for size in (1, 10, 100):
        monkeypatch.setattr(simhash, "parts_at_spaces", lambda t, size=size: common.parts_at_spaces(t, size))
        assert [simhash.fingerprint(t.encode()) for t in texts] == whole


def test_keep_first_odd_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 1, 2, 3), (2, text, 4, 5, 6), (3, None, 7, 8, 9)], "`the id` long, `a.text` string, d int, k int, c0 int")
    kept = simhash.keep_first(df, id_col="the id", text_col="a.text")
    assert kept.schema == df.schema and sorted(tuple(r)[::2] for r in kept.collect()) == [(1, 1, 3), (3, 7, 9)]


@pytest.mark.parametrize("cell", [3, 8192])
def test_simhash_dense_groups(spark, monkeypatch, cell):
    """Groups around centres, dealt to small cells or not."""
    monkeypatch.setattr(simhash, "CELL", cell)
    r = np.random.default_rng(1)
    codes = r.integers(0, 2**63, 6, dtype=np.uint64)[r.integers(0, 6, 300)]
    for _ in range(4):
        codes = codes ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))
    codes[:40] = codes[0]
    ids = r.permutation(300).tolist()
    prints = spark.createDataFrame(list(zip(ids, codes.view(np.int64).tolist(), strict=True)), "doc_id long, fp long")
    got = {x["doc_id"]: x["component_id"] for x in simhash.component_ids(prints).collect()}
    assert got == dict(zip(ids, brute_components(codes, ids), strict=True))


def test_gray_index_random():
    r = np.random.default_rng(2)
    for _ in range(40):
        n = int(r.integers(2, 300))
        codes = r.integers(0, 2**63, 4, dtype=np.uint64)[r.integers(0, 4, n)]
        for _ in range(int(r.integers(1, 6))):
            codes = codes ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
        codes = np.unique(codes)
        keys = r.integers(0, 3, len(codes))
        a, b = simhash.GrayIndex(keys, codes).links(4)
        assert len(a) < len(codes)
        sets = simhash._Connected(len(codes))
        sets.link(a, b)
        for k in range(3):
            some = np.flatnonzero(keys == k)
            want = brute_components(codes[some], some.tolist())
            assert len(set(zip(sets.roots()[some].tolist(), want, strict=True))) == len(set(want)) == len(set(sets.roots()[some].tolist()))


def test_gray_rank_orders_by_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    by_rank = codes[np.argsort(simhash.gray_rank(codes))]
    assert set(np.bitwise_count(by_rank[1:] ^ by_rank[:-1]).tolist()) == {1}


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (200, 201)], "u long, v long")
    assert collected(graph.components(edges)) == Counter([(i, 0) for i in range(n + 1)] + [(200, 200), (201, 200)])
    assert graph.components(edges.limit(0)).count() == 0


# 7 quality


def test_quality(spark, docs, none):
    r = random.Random(7)
    data, labels = [], []
    for i in range(900):
        good = r.random() < 0.7
        words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(r.randrange(10, 80))]
        data.append((i, " ".join(words) + "." if good else " ".join(w + "!!" for w in words[:4] * 12)))
        labels.append((i, int(good)))
    df = spark.createDataFrame(data + [(1000, None), (None, "abc"), (1001, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(1000, None), (5, labels[5][1]), (None, 1)], "doc_id long, quality int")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    got = {x["doc_id"]: x for x in quality.score_documents(df, known, train, 0.3).collect()}
    held_out = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held_out) > 0.98 * len(held_out)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())
    assert len(got) == 903
    assert all(abs(x["score"] - 0.5) < 0.001 for x in quality.score_documents(docs, known.limit(0), train, 0.3).collect())
    only_one = quality.score_documents(docs, known.where("quality = 1"), train, 0.3).collect()
    assert {x["predicted"] for x in only_one} == {1}
    assert quality.score_documents(none, known, train, 0.3).count() == 0


def test_quality_equals_one_matrix(spark):
    """Scores equal those of a ridge solved on one matrix of all rows, and of an isotonic fit by its definition on out-of-fold scores."""
    r = random.Random(15)
    data, labels = [], []
    for i in range(300):
        words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(r.randrange(10, 80))]
        labels.append(int(r.random() < len(words) / 90))
        data.append((i, " ".join(words) + "." * labels[-1] * r.randrange(2)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    known = spark.createDataFrame([*enumerate(labels), *enumerate(labels[:50])], "doc_id long, quality int")
    got = {x["doc_id"]: x["score"] for x in quality.score_documents(df, known, F.lit(True), 0.3).collect()}
    folds = np.array([x["f"] for x in df.select("doc_id", quality.fold_of("doc_id").alias("f")).orderBy("doc_id").collect()])
    x, y = np.array([quality.statistics(t.encode()) for _, t in data]), np.array(labels, float)
    z = quality.FourierMap(x.mean(axis=0), x.std(axis=0))(x)

    def weights(some):
        return np.linalg.solve(z[some].T @ z[some] + quality.RIDGE * some.sum() / z.shape[1] * np.eye(z.shape[1]), z[some].T @ y[some])

    out_of_fold = np.array([z[i] @ weights(folds != folds[i]) for i in range(300)])
    order = np.argsort(out_of_fold, kind="stable")
    s, sy = out_of_fold[order], y[order]
    total = np.concatenate([[0], np.cumsum(sy)])
    fitted = np.array([max(min((total[b] - total[a]) / (b - a) for b in range(i + 1, 301)) for a in range(i + 1)) for i in range(300)])
    levels = np.unique(np.round(fitted, 12))
    knots = [s[np.abs(fitted - v) < 1e-9].mean() for v in levels]
    raw = z @ weights(np.ones(300, bool))
    want = np.clip(0.999 * np.interp(raw, knots, levels) + 0.001 / (1 + np.exp(-raw)), 0, 1)
    assert len(set(folds.tolist())) == quality.FOLDS
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-6)


def test_quality_long_text(spark):
    text = ("some words here, and a line.\n" * 150_000).encode()
    assert len(text) > 4 << 20
    short = quality.statistics(text[: 29 * 100])
    got = dict(enumerate(quality.statistics(text)))
    assert np.allclose([got[k] for k in (2, 3, 9, *range(11, 20))], [short[k] for k in (2, 3, 9, *range(11, 20))])


def test_quality_many_labels_for_an_id(spark):
    """An id with thousands of equal label rows is learnt from once."""
    texts = [(i, "good words here and there." if i % 2 else "BAD!! BAD!! BAD!!") for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    known = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    many = known.union(known.where("doc_id = 1").join(spark.range(5000).select(F.lit(1).alias("x")), F.lit(True)).drop("x"))
    one, other = ({x["doc_id"]: x["score"] for x in quality.score_documents(df, k, F.lit(True), 0.3).collect()} for k in (known, many))
    assert all(abs(one[i] - other[i]) < 1e-9 for i in one)


def test_quality_bounded_sample(spark):
    r = random.Random(8)
    data = [(i, "good words here and there." if r.random() < 0.5 else "BAD!! BAD!! BAD!!") for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    known = df.select("doc_id", (F.substring("text", 1, 4) == "good").cast("int").alias("quality"))
    got = quality.score_documents(df, known, F.lit(True), 0.3, max_fit_rows=300).join(known, "doc_id")
    assert got.where("predicted <> quality").count() == 0


def test_pool_adjacent_violators():
    x, y = quality.pool_adjacent_violators(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == 1 and 0.5 in y


# 8 packing


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    capacity = 64
    got = packing.pack_documents(docs.where("doc_id <> 3"), WORD_BPE, capacity).collect()
    want = Counter()
    for d, text, *_ in rows():
        if d in (None, 3):
            continue
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    check_sequences(got, capacity)
    assert packing.pack_documents(none, WORD_BPE, capacity).count() == 0


def test_packing_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    docs = spark.createDataFrame([(i, "one" if i % 3 else "a b c d e " * (i % 17)) for i in range(3000)] + [(1, "one")] * 40, "doc_id long, text string").repartition(6)
    got = packing.pack_documents(docs, WORD_BPE, 100).collect()
    assert len(got) >= 3040
    assert check_sequences(got, 100) <= 1.02 * sum(r["length"] for r in got) / 100 + 1


def check_sequences(got, capacity):
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == list(np.cumsum([0, *(n for _, n in places)])[:-1])
        assert sum(n for _, n in places) <= capacity
    return len(sequences)


def test_packing_plan():
    r = random.Random(8)
    for trial in range(60):
        capacity = r.choice((10, 64, 1000))
        counts = Counter(r.randrange(1, capacity + 1) for _ in range(r.choice((1, 5, 300, 3000))))
        if trial % 5 == 0:
            counts[r.randrange(1, capacity + 1)] += 10_000
        plan = packing.plan_packing(counts, capacity)
        used = Counter()
        for lengths, times in plan.patterns:
            assert sum(lengths) <= capacity
            for n in lengths:
                used[n] += times
        assert used == counts
        total = sum(k * n for k, n in counts.items())
        assert plan.sequences <= 1 + total * (1.5 if len(counts) < 3 else 1.25) // capacity + sum(n for k, n in counts.items() if 2 * k > capacity)
    assert packing.plan_packing({5: 2, 3: 1, 2: 1, 4: 1, 1: 3, 10: 1}, 10).sequences == 4


def test_packing_keeps_short_pieces_for_long_ones():
    """As many long as short pieces: exact combinations of several short ones would leave long ones alone."""
    r = random.Random(16)
    for _ in range(5):
        counts = Counter(r.randrange(1, 4096) for _ in range(3000))
        bound = max(-(-sum(k * n for k, n in counts.items()) // 4096), sum(n for k, n in counts.items() if 2 * k > 4096))
        assert bound <= packing.plan_packing(counts, 4096).sequences <= 1.015 * bound
    combined = packing.plan_packing({3000: 4, 1000: 2, 96: 2, 600: 2, 400: 2, 90: 1, 6: 9}, 4096)
    assert any(len(lengths) > 2 and sum(lengths) == 4096 for lengths, _ in combined.patterns)


def test_packing_long_text(spark):
    from tokenizers import Tokenizer

    text = " ".join(f"word{i % 977} Ünder_{i % 13}" for i in range(300_000))
    assert len(text) > 4 << 20
    got = sorted(packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), WORD_BPE, 4096).collect(), key=lambda r: r["piece"])
    ids = [*Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids, 1]
    assert [(r["start"], r["length"]) for r in got] == [(at, min(4096, len(ids) - at)) for at in range(0, len(ids), 4096)]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.asarray(ids[at : at + 4096], "<u4").tobytes()) for at in range(0, len(ids), 4096)]
    with pytest.raises(ValueError, match="normaliser"):
        packing.ChunkEncoder(BYTE_BPE)


def test_chunk_encoder_equals_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD_BPE), packing.ChunkEncoder(WORD_BPE, entries=50)
    r = random.Random(9)
    texts = [x[1] or "" for x in rows()] + ["".join(r.choice("aAéb1'.,!|<>s…“́ ñÉİΣ\x1c\xa0") for _ in range(r.randrange(20))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode_many([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_letters_need_no_library():
    own = packing.ChunkEncoder(WORD_BPE)
    library, asked = own.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    own.tokenizer = Counted()
    r = random.Random(21)
    syllables = ["the", "ing", "sch", "ción", "ä", "É", "Ö", "ß", "ÿ", "q", "x", "eaux", "À", "zz"]
    words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 12))) for _ in range(20_000)]
    ids = np.frombuffer(own.encode(" ".join(words).encode()), "<u4").tolist()
    assert not asked
    assert ids == library.encode(" ".join(words), add_special_tokens=False).ids
    for text in ("a" * 5000 + " b", "xé÷y × Àb́c", "lé,, (ünd) it's 12é3 <|x É|>"):
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_letter_merger_equals_library():
    """Vocabularies with tokens that other neighbours make up, too, and with tokens that don't encode to themselves."""
    from tokenizers.models import BPE

    r = random.Random(22)
    left_out = 0
    for _ in range(40):
        tokens = [*bpe.byte_symbols(), *(c + "</w>" for c in bpe.byte_symbols())]
        usable, merges = [*"abc", *(c + "</w>" for c in "abc")], []
        for _ in range(r.choice((5, 30, 120))):
            a, b = r.choice(usable), r.choice(usable)
            if not a.endswith("</w>") and len(a + b) < 14 and a + b not in usable:
                usable.append(a + b)
                merges.append((a, b))
        vocab = {t: i for i, t in enumerate([*tokens, *(a + b for a, b in merges)])}
        library, own = BPE(vocab, merges, end_of_word_suffix="</w>"), packing.LetterMerger({"vocab": vocab, "merges": [" ".join(m) for m in merges]})
        left_out += len(merges) - (len(own.id_of) - 511)
        words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 30))) for _ in range(300)]
        got = [np.frombuffer(ids, "<u4").tolist() for ids in own([w.encode() for w in words])]
        assert got == [[t.id for t in library.tokenize(w)] for w in words]
    assert left_out > 50


# 9 neighbours


def test_neighbours(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 16))
    x = (centres[r.integers(0, 8, 1500)] + 0.4 * r.normal(size=(1500, 16))).astype(np.float32)
    x[100:400] = x[100]
    data = [(i, v, 1, "x") for i, v in enumerate(x.tolist())]
    bad = [(2000, None), (2050, [0.0] * 16), (2051, [float("nan")] * 16), (2052, [None] + [1.0] * 15), (2053, [float("inf")] * 16), (2054, []), (None, [1.0] * 16), (2100, [1.0, 2.0])]
    data += [(*b, 1, "x") for b in bad] + [data[7]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id long, h1 string").repartition(4)
    got = defaultdict(list)
    for q in ann.nearest(df, F.col("id") % 50 == 0, 5, shard_rows=400).orderBy("query_id", "rank").collect():
        got[q["query_id"]].append((q["rank"], q["vec_id"], q["score"]))
    assert set(got) == set(range(0, 1500, 50))  # 2100 has no other vector of its length
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        cosine = unit @ unit[q]
        assert [k for k, *_ in found] == [1, 2, 3, 4, 5] and q not in {i for _, i, _ in found}
        assert np.allclose([s for *_, s in found], cosine[[i for _, i, _ in found]], atol=1e-12)
        order = [i for i in np.lexsort((np.arange(1500), -np.round(cosine, 12))) if i != q][:5]
        hits += len(set(order) & {i for _, i, _ in found})
    assert hits >= 0.9 * 5 * len(got)
    assert [i for _, i, _ in got[150]] == [100, 101, 102, 103, 104]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), F.col("id") == 0, 5).collect()
    assert {r["vec_id"] for r in few} == {1, 2}


def test_neighbours_of_large_doubles_and_odd_names(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 4))
    scaled = x * 10.0 ** r.integers(-200, 300, (60, 1))
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(scaled.tolist())], "`the id` long, `a.vector` array<double>, id long, v long")
    got = ann.nearest(df, F.col("id") < 60, 3, id_col="the id", vector_col="a.vector").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit @ unit.T - 9 * np.eye(60)
    assert len(got) == 180
    for q in got:
        assert abs(q["score"] - np.sort(cosine[q["query_id"]])[-q["rank"]]) < 1e-9


def test_neighbours_in_groups(spark, monkeypatch):
    """Queries in several groups and blocks, vectors of two lengths, small shards: few differ from brute force."""
    monkeypatch.setattr(ann, "QUERY_GROUP", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    r = np.random.default_rng(6)
    data = [(i, v, 1) for i, v in enumerate(r.normal(size=(900, 12)).tolist())] + [(1000 + i, v, 1) for i, v in enumerate(r.normal(size=(200, 5)).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, shard int")
    got = defaultdict(list)
    for q in ann.nearest(df, F.col("id") % 10 == 0, 5, shard_rows=300).orderBy("query_id", "rank").collect():
        got[q["query_id"]].append(q["vec_id"])
    assert set(got) == {i for i, *_ in data if i % 10 == 0}
    hits = 0
    for begin, end in ((0, 900), (1000, 1200)):
        x = np.array([v for i, v, _ in data if begin <= i < end])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for q in range(begin, end, 10):
            want = np.argsort(-(unit @ unit[q - begin] - 9 * (np.arange(end - begin) == q - begin)))[:5] + begin
            assert len(got[q]) == 5
            hits += len(set(want.tolist()) & set(got[q]))
    assert hits > 0.97 * 5 * 110


def test_graph_recall():
    """Vectors without structure, the hardest to walk among: at least 0.95 of the nearest are found."""
    r = np.random.default_rng(7)
    unit = ann._unit(r.normal(size=(6000, 48)))
    graph = ann.Graph.build(unit, r.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2))
    assert len(graph.levels) > 1 and all((level.table < level.count).all() and level.count == len(level.members) for level in graph.levels)
    queries = ann._unit(r.normal(size=(200, 48)))
    found, near = graph.search(queries, ann.BEAM)
    got = np.take_along_axis(found, np.argsort(-near, axis=1)[:, :5], axis=1)
    want = np.argsort(-(queries @ unit.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got.tolist(), want.tolist(), strict=True)]) >= 0.95


def test_shards_grow():
    assert [ann.shards_of(n, 64, ann.SHARD_ROWS) for n in (1, 16_384, 16_385, 50_000, 1_048_576, 8_388_608, 10**9)] == [1, 1, 2, 4, 64, 64, 7630]
    assert ann.shards_of(10**6, 1024, ann.SHARD_ROWS) == 62 and ann.shards_of(10**7, 1024, ann.SHARD_ROWS) == 611


# 10 substrings


def brute_substrings(data, size):
    def key(x):
        return (x[0] is None, x[0] or 0)

    seen, out = set(), []
    for d, text, *_ in sorted(data, key=key):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize(("part_words", "hot", "scan"), [(50, 20_000, 1 << 19), (300_000, 20_000, 200), (300_000, 3, 1 << 19), (300_000, 3, 200)])
def test_substrings(docs, none, monkeypatch, part_words, hot, scan):
    monkeypatch.setattr(substring_dedup, "PART_WORDS", part_words)
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", hot)
    monkeypatch.setattr(substring_dedup, "SCAN_BYTES", scan)
    data = [x for x in rows() if x[0] not in (3, 5)]
    df = docs.where("doc_id IS NULL OR doc_id NOT IN (3, 5)")
    assert collected(substring_dedup.digests(df, 20)) == Counter(brute_substrings(data, 20))
    kept = substring_dedup.remove_repeats(df, 20)
    assert kept.schema == df.schema
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for d, n, removed, sha in brute_substrings(data, 20):
        if removed == n and n:
            assert d not in texts
        else:
            assert hashlib.sha256(b" ".join((texts[d] or "").encode().split())).hexdigest() == sha
            assert removed or texts[d] == next(t for i, t, *_ in data if i == d)
    assert substring_dedup.digests(docs, 20).count() == docs.count()
    assert substring_dedup.digests(none, 20).count() == 0


@pytest.mark.parametrize("hot", [4, 20_000])
def test_substrings_of_few_words(spark, monkeypatch, hot):
    """Few different words, and texts that repeat within themselves."""
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", hot)
    r = random.Random(11)
    data = []
    for i in range(120):
        text = " ".join(r.choice("a b c".split()) for _ in range(r.randrange(90)))
        if i % 4 == 0:
            text = " ".join(["p q"] * r.randrange(40))
        if i % 5 == 0 and data:
            text = " ".join(r.choice(data)[1].split()[r.randrange(10) :]) + " tail"
        data.append((i, text))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert collected(substring_dedup.digests(df, 20)) == Counter(brute_substrings(data, 20))


@pytest.mark.parametrize("hot", [100, 20_000])
def test_window_in_thousands_of_documents(spark, monkeypatch, hot):
    """A passage of one window and a bit, in 5,000 documents of few partitions, half of them without an id."""
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", hot)
    passage = " ".join(f"common{i}" for i in range(22))
    data = [(i if i % 2 else None, f"a{i} b{i} {passage} c{i}") for i in range(5000)]
    got = substring_dedup.digests(spark.createDataFrame(data, "doc_id long, text string").repartition(7), 20)
    rows = got.groupBy("n_words", "n_removed").count().collect()
    assert {(r["n_words"], r["n_removed"]): r["count"] for r in rows} == {(25, 0): 1, (25, 22): 4999}
    assert got.where("n_removed = 0").first()["doc_id"] == 1


def test_substrings_of_a_very_long_text(spark):
    """Eight megabytes in one text, of which a quarter repeats, and an unbroken word of two megabytes."""
    r = random.Random(12)
    words = [f"w{r.randrange(1 << 40):x}" for _ in range(500_000)]
    data = [(1, " ".join(words)), (2, " \n ".join(words[200_000:325_000]) + " end"), (3, "x" * (2 << 20) + " " + " ".join(words[:50]))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert max(len(t) for _, t in data) > 5 << 20
    got = {x["doc_id"]: x for x in substring_dedup.digests(df, 20).collect()}
    assert {d: (x["n_words"], x["n_removed"]) for d, x in got.items()} == {1: (500_000, 0), 2: (125_001, 125_000), 3: (51, 50)}
    assert got[1]["kept_sha256"] == hashlib.sha256(data[0][1].encode()).hexdigest()
    assert {x["doc_id"]: x["text"] for x in substring_dedup.remove_repeats(df, 20).collect()} == {1: data[0][1], 2: "end", 3: "x" * (2 << 20)}


def test_window_sizes(docs):
    for size in (4, 256):
        with pytest.raises(ValueError, match="window"):
            substring_dedup.digests(docs, size)


def test_rows_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, long), (1, long), (1, "other " + long), (2, long)], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in substring_dedup.digests(df, 20).collect())
    assert got[-1] == (2, 40, 40)
    assert got[:2].count((1, 40, 0)) == 2 and got[2] == (1, 41, 40) or got[:2] == [(1, 40, 40)] * 2 and got[2] == (1, 41, 0)


def test_bits():
    r = np.random.default_rng(6)
    for n, share in ((1, 1.0), (64, 0.5), (65, 0.1), (1000, 0.01), (1000, 0.9), (4096, 0.5)):
        raw = r.random(n) < share
        raw[0] = True
        bits, ones = substring_dedup.Bits(raw), np.flatnonzero(raw)
        places = np.arange(n + 1)
        assert bits.rank(places).tolist() == np.concatenate([[0], np.cumsum(raw)]).tolist()
        assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()


def test_wavelet_ranks():
    r = np.random.default_rng(4)
    for sigma in (1, 2, 3, 70):
        s = r.integers(0, sigma, 500)
        w = substring_dedup.WaveletMatrix(s, sigma)
        c, low, high = r.integers(0, sigma, 200), r.integers(0, 501, 200), r.integers(0, 501, 200)
        a, b = w.rank_pair(c, low, high)
        assert a.tolist() == [int((s[:i] == k).sum()) for k, i in zip(c, low, strict=True)]
        assert b.tolist() == [int((s[:i] == k).sum()) for k, i in zip(c, high, strict=True)]
