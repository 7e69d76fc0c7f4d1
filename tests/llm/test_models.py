import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, language_model, licenses, quality, toxicity
from tessera.llm.common import remainder
from tests.llm import brute

SYL = ["ba", "ko", "mi", "ter", "lun", "so", "vi", "ren", "ta", "ques"]


def sentences(rng, n, words=12):
    return " ".join(" ".join("".join(rng.choices(SYL, k=rng.randint(1, 4))) for _ in range(words)).capitalize() + "." for _ in range(n))


def insulted(rng, text, forms):
    w = text.split()
    for _ in range(2):
        w.insert(rng.randrange(len(w)), rng.choice(forms))
    return " ".join(w)


def toxic_corpus(n=900):
    rng = random.Random(4)
    stems = ["grobnak", "schlif", "dumwit"]
    docs, labels = [], []
    for k in range(n):
        text, bad = sentences(rng, 4), k % 6 == 0
        docs.append((k, insulted(rng, text, [s + e for s in stems for e in ("", "er", "ish", "ko")]) if bad else text))
        labels.append((k, int(bad), 1))
    return docs, labels


def test_toxicity_catches_gaps_and_inserted_letters(spark):
    docs, labels = toxic_corpus()
    rng = random.Random(9)
    held = {}
    for k, form in enumerate(["grobnakta", "gr.ob.nak", "s c h l i f", "dum-wit", "grobxnak", "schlyif", "DUMWIT!", "schlifques"]):
        docs.append((10_000 + k, insulted(rng, sentences(rng, 3), [form])))
        held[10_000 + k] = form
    docs += [(20_000, None), (20_001, ""), (20_002, sentences(rng, 2000)), (None, "x"), (5, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7))
    lab = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity(df, lab, held_out=remainder(F.col("doc_id"), 3) == 1).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (brute.remainder(r.doc_id, 3) == 1) for r in rows if r.doc_id is not None)
    true = {i: t for i, t, _ in labels}
    out = [(got[i].predicted, t) for i, t in true.items() if got[i].held_out]
    assert np.mean([p for p, t in out if t]) > 0.95 and np.mean([p for p, t in out if not t]) < 0.01
    missed = [f for i, f in held.items() if not got[i].predicted]
    assert not missed, missed
    assert got[20_000].predicted == got[20_001].predicted == got[20_002].predicted == 0
    clean = toxicity.without_toxic(df, lab)
    assert clean.columns == df.columns and 0 < clean.count() < len(docs)


def test_toxicity_looks_at_all_of_long_tokens_and_of_gapped_words(spark):
    docs, labels = toxic_corpus()
    rng = random.Random(12)
    clean = [sentences(rng, 3) for _ in range(9)]
    long = "_".join(sentences(rng, 1).strip(".").split())
    forms = [f"{long}_grobnak", f"{long}/schlif-{long}", f"http://{long}.dumwit.{long}", "gr ob nak", "s - c - h - l - i - f", "dum wit", " ".join(long.replace("_", "") + "dumwit")]
    held = {10_000 + k: f for k, f in enumerate(forms)}
    docs += [(i, clean[i - 10_000] + " " + f) for i, f in held.items()] + [(20_000 + k, f"{t} {long} - {' '.join(long)}") for k, t in enumerate(clean)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(df, lab).collect()}
    missed = [f for i, f in held.items() if not got[i]]
    assert not missed, missed
    assert not any(got[20_000 + k] for k in range(9))
    word = "abcdefghijklmnopqrstuvwxyz" * 3
    assert all(any(word[k : k + 12] in s for s in toxicity.pieces(word.encode())) for k in range(len(word) - 11))


def test_toxicity_knows_every_stem_that_the_labels_show(spark):
    rng = random.Random(6)
    stems = sorted({"".join(rng.choices("bdfghjkpqvwxz", k=7)) for _ in range(90)})
    docs = [(k, sentences(rng, 2) + (f" {stems[k // 2 % 90]}" if k % 2 else "")) for k in range(3600)]
    lab = spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, toxic int")
    docs += [(10_000 + k, sentences(rng, 2) + f" {s}") for k, s in enumerate(stems)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(df, lab).collect()}
    missed = [s for k, s in enumerate(stems) if not got[10_000 + k]]
    assert not missed, missed
    counts = [(f"^{s}$", 20, 0) for s in stems]
    assert len(toxicity.choose_landmarks(counts, 1800, 1800, 90)) == 90
    with pytest.raises(ValueError):
        toxicity.choose_landmarks(counts, 1800, 1800, 89)


def test_more_insults_than_landmarks_are_no_error(spark, monkeypatch):
    """The clearest are known, also where the machine can't learn from all words."""
    monkeypatch.setattr(toxicity, "MOST_CELLS", 2000)
    rng = random.Random(6)
    stems = sorted({"".join(rng.choices("bdfghjkpqvwxz", k=7)) for _ in range(40)})
    docs = [(k, sentences(rng, 2) + (f" {stems[k // 2 % 40]}" if k % 2 else "")) for k in range(1600)]
    lab = spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), lab, most_landmarks=15).collect()
    assert sum(r.predicted for r in got if r.doc_id % 2) >= 300 and not sum(r.predicted for r in got if r.doc_id % 2 == 0)


def test_toxicity_without_labels_of_a_kind(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(df, lab).collect()} == {0}
    assert toxicity.toxicity(df.limit(0), lab.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [0, 128])
def test_kernel_is_that_of_gapped_subsequences(monkeypatch, dense):
    monkeypatch.setattr(toxicity, "DENSE", dense)

    def phi(s):
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.REACH + 1)):
                    u = s[i] + s[j] + s[k]
                    out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    marks, strings = ["^scum", "^idiot"], ["^scummy", "^sc0um", "^idriot", "^the", "^id"]
    kernel = toxicity.Kernel(marks)
    which, rows = kernel(strings)
    for k, s in enumerate(strings):
        want = [sum(min(v, phi(s).get(u, 0)) for u, v in phi(m).items()) / sum(phi(m).values()) for m in marks]
        if max(want) >= toxicity.LEAST:
            assert np.allclose(rows[list(which).index(k)], np.array(want) ** toxicity.DEGREE, atol=1e-6)
        else:
            assert k not in which


def test_language_of_unseen_words(spark):
    rng = random.Random(3)
    make = {"aa": ["the", "ing", "tion", "wh", "ed"], "bb": ["ción", "que", "ado", "ll", "ñ"], "cc": ["sch", "ung", "keit", "ä", "ver"]}
    docs = []
    for k in range(900):
        lang = ("aa", "bb", "cc")[k % 3]
        docs.append((k, " ".join("".join(rng.choices(make[lang], k=rng.randint(1, 5))) for _ in range(15)), lang))
    docs += [(5000, None, "aa"), (5001, "", None), (5002, "123 !!", "bb"), (5003, "schungkeitungverschungäkeit", None), (5004, "quell ción " * 20_000, None), (None, "the", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("word", F.lit(1)).withColumn("part", F.lit(1))
    rows = language_id.identify(df, held_out=remainder(F.col("doc_id"), 5) == 0).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in docs[:900] if got[i].held_out]) > 0.98
    assert [got[i].lang_pred for i in (5000, 5001, 5002, 5003, 5004)] == ["und", "und", "und", "cc", "bb"]
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def test_language_of_runs_without_spaces(spark):
    """Such a run is judged by all of its letters, and each of its n-grams counts once."""
    rng = random.Random(13)
    make = {"aa": "abcdef", "bb": "あいうえおか"}
    docs = [(k, "".join(rng.choices(make[lang], k=300)), lang) for k in range(200) for lang in ("aa", "bb") if (k % 2 == 0) == (lang == "aa")]
    docs += [(1000, "a" * 45 + "".join(rng.choices(make["bb"], k=400)), None), (1001, "".join(rng.choices(make["bb"], k=45)) + "".join(rng.choices(make["aa"], k=400)), None)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got[1000] == "bb" and got[1001] == "aa" and all(got[i] == lang for i, _, lang in docs[:200])
    for n in (39, 40, 41, 44, 76, 77, 500):
        word = "".join(chr(0x4E00 + k) for k in range(n))
        cut = language_id.pieces(word.encode())
        found = [p[k : k + 5] for p in cut for k in range(len(p) - 4)]
        assert found == [word[k : k + 5] for k in range(n - 4)] and max(map(len, cut)) <= 40
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame([(k, b"x", f"l{k}") for k in range(4)], "doc_id long, text binary, lang string"), most_languages=3)


def test_language_scores_equal_brute_force(spark):
    """Word-first backoff by plain counting: known words, else the longest known n-grams' mean; repeated and tied rows agree."""
    rng = random.Random(21)
    vocabulary = {"aa": ["tak", "lop", "sin", "taker"], "bb": ["que", "sin", "dado", "dad"]}
    docs = [(k, " ".join(rng.choices(vocabulary[lang], k=8)), lang) for k in range(80) for lang in [("aa", "bb")[k % 2]]]
    probes = ["tak que", "takes", "dados sin", "zzz", "lopque", "t", "sin", "tak-que 9", "dado " * 30]
    rows = [*docs, *((500 + k, t, None) for k, t in enumerate(probes)), (500, probes[0], None)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_words=5).collect()
    words = {lang: Counter(w for _, t, x in docs if x == lang for w in t.split()) for lang in vocabulary}
    both = words["aa"] + words["bb"]
    top = sorted(both, key=lambda w: (-both[w], w))[:5]
    grams = {lang: Counter() for lang in vocabulary}
    for lang, own in words.items():
        for w, n in own.items():
            for size in range(1, 6):
                for k in range(len(w) + 3 - size):
                    grams[lang][f"^{w}$"[k : k + size]] += n
    logs = lambda table, key, n, lang: math.log((table[lang][key] + 0.5) / sum(table[lang][x] + 0.5 for x in n))
    known = [{g for own in grams.values() for g in own if len(g) == size} for size in range(6)]

    def value(word, lang):
        if word in top:
            return logs(words, word, top, lang)
        for size in range(5, 0, -1):
            hit = [g for k in range(len(word) + 3 - size) if (g := f"^{word}$"[k : k + size]) in known[size]]
            if hit:
                return sum(logs(grams, g, known[size], lang) for g in hit) / len(hit)
        return 0.0

    for r in got:
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        total = {lang: sum(value(w, lang) for w in ("".join(c for c in x if c.isalpha()) for x in text.split()) if w) for lang in ("aa", "bb")}
        best = max(total, key=lambda x: (total[x], x == "aa"))
        assert r.lang_pred == best and np.isclose(r.score, 1 / sum(math.exp(v - total[best]) for v in total.values()))
    assert len({r for r in got if r.doc_id == 500}) == 1


def test_quality_finds_interactions_and_odd_texts(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(1500):
        text, kind = sentences(rng, rng.randint(2, 6)), k % 8
        if kind == 0:
            text = " ".join(w for w in text.split()[:6] for _ in range(9))
        elif kind == 1:
            text = " | ".join(text.split())
        docs.append((k, text))
        labels.append((k, int(kind > 1), 0))
    docs += [(5000, None), (5001, ""), (5002, "\n\n "), (5003, "é" * 300_000), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("quality", F.lit(1)).withColumn("measures", F.lit(1))
    lab = spark.createDataFrame(labels + [(3, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality(df, lab, held_out=remainder(F.col("doc_id"), 5) == 0).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([got[i].predicted == q for i, q, _ in labels if got[i].held_out]) > 0.98
    assert quality.quality(df.limit(0), lab.limit(0)).count() == 0
    assert quality.quality(df, lab.filter("quality = 1")).filter("predicted = 1").count() == len(docs)


def plain_measures(text):
    """MEASURES of a text, worked out word by word."""
    words, raw = text.split(), text.encode()
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda a, b: a / max(b, 1)
    of = lambda kind: sum(map(kind, text))
    n, size = len(words), len(raw)
    upper, lower = of(lambda c: "A" <= c <= "Z"), of(lambda c: "a" <= c <= "z")
    stops, signs = of(lambda c: c in ".?!"), of(lambda c: c.isascii() and not c.isalnum() and c not in " \t\n\r.?!")
    return [
        math.log1p(n), share(sum(map(len, words)), n), share(len(set(words)), n), share(max(map(words.count, words), default=0), n),
        share(sum(a == b for a, b in zip(words[1:], words, strict=False)), n), share(sum(not w[-1].isalnum() and w[-1] != "_" and w[-1] not in ".,;:!?'\")]\u2026\u00bb" for w in words), n),
        share(sum(not any(c.isalpha() for c in w) for w in words), n), share(upper, upper + lower), share(of(str.isdigit), size), share(signs, size),
        share(size - of(str.isascii), size), share(n, stops), share(n, len(lines)), share(len(lines) - len(set(lines)), len(lines)),
    ]


def test_quality_scores_equal_brute_force(spark):
    """A score is the sum of the entries that plain measures of the text look up; repeated rows agree."""
    rng = random.Random(15)
    docs = [(k, "\n".join(sentences(rng, rng.randint(1, 3)) + (" | # " * (k % 3) + "Zz 12 12") for _ in range(rng.randint(1, 4)))) for k in range(240)]
    docs += [(1000, None), (1001, "\u00e9t\u00e9 \u00e9t\u00e9 a-"), (1002, "x\nx\n\ny?"), (1002, "x\nx\n\ny?")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = quality.quality(df, labels).collect()
    model = quality.fit(df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")), labels)
    for r in rows:
        for text in {t or "" for i, t in docs if i == r.doc_id}:
            x = plain_measures(text)
            bin_ = lambda cuts, k: sum(c <= x[k] for c in cuts[k])  # noqa: B023, E731
            value = model.base + sum(t[bin_(model.cuts, k)] for k, t in enumerate(model.tables))
            value += sum(t[bin_(model.pair_cuts, i), bin_(model.pair_cuts, j)] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
            assert np.isclose(r.score, 1 / (1 + math.exp(-value))), (r, text, x)
    assert len({r for r in rows if r.doc_id == 1002}) == 1 and any(r.predicted for r in rows)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.95 and (0, 1) in model.pairs


def lm_docs():
    rng = random.Random(8)
    docs = [(k, " ".join(f"{a} of the" if a == "out" else a for a in rng.choices(["out", "in", "Sun", "moon", f"rare{k}", "ébène"], k=rng.randint(0, 40)))) for k in range(300)]
    return docs + [(1000, None), (1001, ""), (1002, "never seen words"), (1003, "out of the " * 20_000), (None, "in")]


def test_language_model_counts_equal_brute_force(spark):
    docs = lm_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("row", F.lit(1))
    rows = language_model.score(df, held_out=remainder(F.coalesce("doc_id", F.lit(-1)), 7) == 2, most_symbols=5).collect()
    held = {i: brute.remainder(-1 if i is None else i, 7) == 2 for i, _ in docs}
    counts = {}
    for i, t in docs:
        if not held[i]:
            for w in [*brute.words(t), "END"]:
                counts[w] = counts.get(w, 0) + 1
    n, v, texts = sum(counts.values()), len(counts), dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        w = [*brute.words(texts[r.doc_id]), "END"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in counts for x in w), n)
        assert np.isclose(r.base_score, sum(brute.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # "of the" follows "out"


def test_symbol_probabilities_add_up_to_one():
    noise = np.array([0.2, 0.1, 0.35, 0.2, 0.15])
    none = np.zeros(0, int)
    v = language_model.Vocabulary({}, none, none, noise, 130, 9, none, none, 10)
    state = language_model.start(v)
    triples = np.array([[1, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 1], [1, 2, 0]])
    for seed in range(4):
        language_model.train(state, triples, np.array([9.0, 8, 7, 6, 1]), noise, seed)
    t = language_model.Tables.of([x.astype(float) for x in state[:5]])
    for u in range(5):
        for w in range(5):
            assert np.isclose((10.0 ** (t.near[w] + t.far[u] - t.normal[u, w])).sum(), 1, atol=1e-3)
    assert 10.0 ** (t.near[2, 3] + t.far[1, 3] - t.normal[1, 2]) > 0.4


def test_word_classes_in_sql_and_python_agree(spark):
    words = [b"a", b"ab", b"abc", "ión".encode(), "ß".encode(), b"|", b"\xff\xfe"]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select(language_model.class_of(F.col("word"))).collect()
    assert [r[0] for r in got] == [language_model.word_class(w) for w in words]


def test_scores_equal_brute_force_and_probabilities_add_up_to_one(spark):
    """The softmax over symbols, and the counts within a class, worked out plainly for each token of each text."""
    rng = random.Random(11)
    pool = [a + b for a in ("ka", "lo", "mi", "tu") for b in ("ng", "en", "on", "s")]
    docs = [(k, " ".join(rng.choices(pool, weights=range(1, 17), k=rng.randint(0, 12)))) for k in range(120)] + [(1000, "Ka never"), (1001, None), (1002, "tus lon " * 3), (1002, "tus lon " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = language_model.score(df, held_out=F.col("doc_id") >= 1000, most_symbols=6).collect()
    learnt = [brute.words(t) for i, t in docs if i < 1000]
    counts = Counter(w for x in learnt for w in x)
    top = sorted(counts, key=lambda w: (-counts[w], w))[:6]
    end, classes = language_model.END, language_model.CLASSES
    symbol = lambda w: end + 1 + top.index(w) if w in top else language_model.word_class(w)
    others = defaultdict(list)
    for w in counts:
        if w not in top:
            others[symbol(w)].append(w)
    total = {c: sum(counts[w] + 1 for w in own) + 1 for c, own in others.items()}  # and one that is unseen
    noise = np.array([sum(counts[w] for w in others[c]) + 1 for c in range(classes)] + [len(learnt) + 1] + [counts[w] + 1 for w in top], float)
    vocabulary = language_model.vocabulary(spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, c long"), len(learnt), 6)
    assert np.allclose(vocabulary.noise, noise / noise.sum())
    texts = df.filter("doc_id < 1000").select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    context, target, near, far, bias = language_model.fit(texts, vocabulary)

    def probability(before, last, word):
        """word: None for the end, "unseen" parts of a class by their own number."""
        scores = target @ (context[last] * near + context[before] * far) + bias
        p = np.exp(scores - scores.max())
        p /= p.sum()
        s = end if word is None else symbol(word)
        return p[s] if s >= end else p[s] * (counts.get(word, 0) + 1) / total.get(s, 1)

    for r in rows:
        for text in {t for i, t in docs if i == r.doc_id}:
            s = [end, end, *map(symbol, brute.words(text)), end]
            want = sum(brute.log10(probability(s[k], s[k + 1], w)) for k, w in enumerate([*brute.words(text), None]))
            assert np.isclose(r.score, want, atol=1e-3), (r, want)
    unseen = {}
    for a in "bcdfghjklmnpqrstvwxz":
        for b in "abcdefghijklmnopqrstuvwxyz0123456789":
            unseen.setdefault(symbol(f"{a}{b}".encode()), f"zz{a}{b}".encode())
    assert len(unseen) == classes
    for before, last in ((end, end), (end, symbol(top[0])), (symbol(top[1]), 3)):
        assert np.isclose(sum(probability(before, last, w) for w in [None, *counts, *unseen.values()]), 1)
    assert len({r for r in rows if r.doc_id == 1002}) == 1


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = language_model.score(df, held_out=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in rows)
    assert language_model.score(df.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_increasing_and_near_the_longest():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.choice("abcdefghijklmnop").encode() for _ in range(30)]
        b = [w for w in a if rng.random() > 0.1]
        for _ in range(3):
            b.insert(rng.randrange(len(b)), b"zz")
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
        assert len(pairs) <= lcs(a, b)
    words = [f"w{k}".encode() for k in range(50)]
    assert len(licenses.align(words, words[:20] + [b"x"] + words[22:])) == 48


def test_scan_equals_brute_force(spark):
    """Every window of every text against every template by longest common subsequence: those well over the coverage are
    found, those under it are not, and the choice among licenses with shared wording is the plain maximum."""
    rng = random.Random(17)
    names = ["MIT", "MIT-text", "MIT-0-text", "ISC-text", "GPL-notice", "LGPL-3.0-notice", "AGPL-3.0-notice", "CC-BY-4.0-notice", "CC-BY-SA-4.0-notice", "reserved"]
    texts = {n: licenses.TEMPLATES[n] for n in names}
    parts = {n: licenses.parts(t.encode()) for n, t in texts.items()}
    docs, planted = [], {}
    for k, n in enumerate([*names, *names, None, None]):
        words = texts[n].split() if n else rng.sample(texts["MIT-text"].split(), 40)
        lost = 0 if k < 10 or len(words) < 12 else 0.06
        words = [w for w in words if rng.random() >= lost]
        docs.append((k, f"{sentences(rng, rng.randint(0, 9))} {' '.join(words)} {sentences(rng, rng.randint(0, 9))}"))
        planted[k] = n
    got = defaultdict(dict)
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), texts).collect():
        got[r.doc_id][r.license] = r
    for k, text in docs:
        words = licenses.parts(text.encode())
        share = {}
        for n, own in parts.items():
            step = max(1, len(own) // 8)
            share[n] = max(lcs(own, words[b : b + len(own) + 2 * step]) for b in range(0, max(1, len(words)), step)) / len(own)
        assert set(got[k]) == ({planted[k]} if planted[k] else set()), (k, planted[k], got[k], share)
        for n, r in got[k].items():
            assert r.coverage <= share[n] + 1e-9 and r.coverage > share[n] - 0.05
            assert r.extra_words == r.last_word - r.first_word + 1 - round(r.coverage * len(parts[n]))
            assert all(x <= share[n] or x < 0.8 or len(parts[m]) < len(parts[n]) for m, x in share.items())


def test_scan_takes_the_first_of_equal_stretches(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License. x " * 2), (1, "All rights reserved"), (None, "all RIGHTS reserved.")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license, r.first_word, r.extra_words) for r in licenses.scan(df).collect()) == [(0, "reserved", 0, 0), (1, "MIT", 0, 0), (1, "reserved", 0, 0)]


def test_scan_finds_reworded_and_repeated_notices(spark):
    rng = random.Random(6)
    filler = lambda: sentences(rng, 20)
    mit = licenses.TEMPLATES["MIT-text"]
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    docs = [(1, filler() + " Released under the MIT License. " + filler()), (2, "released UNDER the mit license\n" * 3), (3, filler() + " " + cut + " " + filler()),
            (4, filler() + " the license of this work is under the version " + filler()), (5, None), (6, ""), (7, filler() * 50 + " Licensed under CC BY-NC 4.0."), (8, "Licensed under the Apache License, Version 2.0.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("license", F.lit(1)).withColumn("coverage", F.lit(1))
    got = {(r.doc_id, r.license): r for r in licenses.scan(df).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (3, "MIT-text"), (7, "CC-BY-NC-4.0"), (8, "Apache-2.0")}
    assert got[1, "MIT"].coverage == 1 and got[1, "MIT"].last_word - got[1, "MIT"].first_word == 4
    assert 0.85 < got[3, "MIT-text"].coverage < 0.95
    assert licenses.scan(df.limit(0)).count() == 0
