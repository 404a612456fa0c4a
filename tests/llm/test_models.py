"""Scores: toxicity, language and quality, by what they find in texts held out."""

import math
import random
import zlib

import numpy as np
import pytest

from quantspan.llm import language, quality, toxicity


def _words(r, parts, n):
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def made():
    r = random.Random(11)
    parts = ["an", "er", "th", "in", "on", "ti", "es", "re", "ly", "st"]
    rows, labels = [], []
    for i in range(700):
        words = _words(r, parts, r.randint(5, 120)).split()
        toxic = r.random() < 0.2
        for _ in range(1 + len(words) // 60 if toxic else 0):
            words.insert(r.randrange(len(words)), "grum" + r.choice(parts))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, odd, made):
    rows, labels = made
    known = [(i, q, t) for i, q, t in labels if i < 600]
    known += [(i, 1, None) for i in range(600, 620)] + [(None, 1, 0), (5_000, 1, 1), (1, 1, 7)]
    more = [(i if i is None else i + 1000, t) for i, t in odd]
    model = toxicity.fit(docs([*rows, *more]), _labels(spark, known))
    scored = toxicity.add_scores(docs([*rows, *more]), model)
    assert scored.columns == [*docs([]).columns, "toxicity"]
    got = {r["doc_id"]: r["toxicity"] for r in scored.collect()}
    assert all(0 <= x <= 1 for x in got.values()) and got[1001] == got[1002] < 0.3
    true = {i: t for i, _, t in labels}
    unseen = [i for i in true if i >= 600]
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(true[i]) for i in unseen)
    assert right >= 0.93 * len(unseen)


def test_toxicity_without_labels(spark, docs, odd, made):
    left = toxicity.reject_toxic(docs(odd), _labels(spark, []))
    assert left.columns == docs([]).columns and left.count() == len(odd)
    one = toxicity.fit(docs(made[0][:60]), _labels(spark, [(i, 1, 1) for i in range(60)]))
    assert one.constant == 1.0
    assert toxicity.reject_toxic(docs([]), _labels(spark, [(1, 1, 1)])).count() == 0


def test_labels_are_no_input(spark, docs, made):
    """Labels of held-out documents change no score."""
    rows, labels = made
    held = {r["doc_id"] for r in docs(rows).where(toxicity.crc_bucket(toxicity.c("doc_id"), 4) == 2).collect()}
    scores = []
    for some in (labels[:200], [(i, q, 1 - t) if i in held else (i, q, t) for i, q, t in labels[:200]]):
        scored = toxicity.add_scores(docs(rows[:40]), toxicity.fit(docs(rows), _labels(spark, some)))
        scores.append({r["doc_id"]: round(r["toxicity"], 9) for r in scored.collect()})
    assert scores[0] == scores[1]


def _exact_ratios(rows):
    """Ratio of a word by the labelled (text, toxic) rows, as the textbook has it: every gram under its own name."""
    counts, order = {}, toxicity.ORDER
    for text, toxic in rows:
        for word in text.split():
            marked = f"^{word}$"
            for i in range(2, len(marked) + 1):
                counts.setdefault(marked[max(0, i - order) : i], [0, 0])[toxic] += 1
    levels, longer = {}, []
    for n in range(order - 1, 0, -1):
        longer = [g for g in counts if len(g) == n + 1] + longer
        levels[n] = {}
        for g in longer:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1
        longer = list(levels[n])
    p = {}
    for n in range(1, order):
        own = {}
        for g, k in levels[n].items():
            own.setdefault(g[:-1], []).append(k)
        for g, k in levels[n].items():
            total, kinds = sum(own[g[:-1]]), len(own[g[:-1]])
            below = 1 / kinds if n == 1 else p[g[1:]]
            p[g] = (k - toxicity.SHARED_DISCOUNT) / total + toxicity.SHARED_DISCOUNT * kinds / total * below
    behind = {}
    for g, both in counts.items():
        behind.setdefault(g[:-1], []).append(both)

    def ratio(word):
        marked, out = f"^{word}$", 0.0
        for i in range(2, len(marked) + 1):
            g = marked[max(0, i - order) : i]
            totals = [sum(x[k] for x in behind.get(g[:-1], [])) for k in (0, 1)]
            if all(totals):
                left = [toxicity.DISCOUNT * sum(x[k] > 0 for x in behind[g[:-1]]) / totals[k] for k in (0, 1)]
                if g in counts:
                    left = [max(counts[g][k] - toxicity.DISCOUNT, 0) / totals[k] + left[k] * p[g[1:]] for k in (0, 1)]
                out += math.log(left[1] / left[0])
        return out

    return ratio


@pytest.mark.parametrize("share", [50, 1])
def test_ratios_are_those_of_their_own_grams(spark, docs, monkeypatch, share):
    """However many grams there are, and whether words are broadcast or joined."""
    monkeypatch.setattr(toxicity, "HOT_SHARE", share)
    monkeypatch.setattr(toxicity, "HOT_CONTEXTS", share)
    r = random.Random(7)
    common = ["river", "stone", "x" * 90]
    rows = [(i, " ".join([*("".join(r.choices("abcdefghijklmnopqrst", k=r.randint(1, 12))) for _ in range(r.randint(1, 40))), *r.choices(common, k=9)])) for i in range(300)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (5, "another text of this id"), (302, "1 2"), (303, None), (None, "no id é漢")]
    df = docs(rows)
    fold = {x["doc_id"]: x["f"] for x in df.select("doc_id", toxicity.crc_bucket(toxicity.c("doc_id"), toxicity.FOLDS).alias("f")).collect()}
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)]
    ratio = _exact_ratios([(t, int(i % 3 == 0)) for i, t in rows if i is not None and i < 300 and fold[i] in toxicity.COUNTED])
    got = toxicity.add_features(df, toxicity.fit(df, _labels(spark, labels))).collect()
    assert len(got) == len(rows)
    for x in got:
        own = [ratio(w) for w in toxicity.LETTERS.findall((x["text"] or "").lower())] or [0.0]
        clear = [max(v - toxicity.CLEAR, 0) for v in own]
        want = sum(own) / len(own), sum(clear) / len(own), sum(max(v, 0) for v in own) / len(own), max(own), math.log1p(sum(clear))
        assert [x[f] for f in toxicity.FEATURES] == pytest.approx(want, abs=1e-9)


def test_toxicity_moves_no_more_than_it_needs(spark, docs, made, monkeypatch):
    """Texts without labels stay where they are, and no level of grams is counted again for each level below."""
    rows, labels = made
    df = docs([*rows, (None, "no id"), (3, "another text of this id")])
    known = _labels(spark, [*labels[:40], (None, 1, 0), (3, 1, 0)])
    got = toxicity.labelled(df, known, toxicity.COUNTED)
    plain = df.where(toxicity.crc_bucket(toxicity.c("doc_id"), toxicity.FOLDS).isin(*toxicity.COUNTED)).join(known, "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select("doc_id", "text", "toxic").collect())) and got.count() > 10
    few = toxicity._maybe_in(df.select("doc_id", "text"), known.select("doc_id"))
    assert few.where("doc_id is not null").count() == 41 and few.columns == ["doc_id", "text"]
    written, plans = toxicity.materialize, []

    def seen(frame, name):
        plans.extend([frame._jdf.queryExecution().executedPlan().toString()] if name == "backoff" else [])
        return written(frame, name)

    monkeypatch.setattr(toxicity, "materialize", seen)
    grams = written(toxicity.gram_counts(toxicity.word_counts(got)), "grams")
    assert toxicity.shared_backoff(grams).count() > 100
    assert len(plans) == toxicity.ORDER - 1 and max(x.count("HashAggregate") for x in plans) <= 2


def test_language(spark, odd):
    r = random.Random(4)
    parts = {"xx": ["the", "an", "ing", "er"], "yy": ["der", "sch", "ung", "ei"], "zz": ["да", "не", "что", "ко"]}
    rows = [(i, _words(r, parts[lang], r.randint(2, 60)), lang) for i in range(240) for lang in [list(parts)[i % 3]]]
    rows += [(i + 1000 if i else None, t, None) for i, t in odd] + [(2000, "1234 !?", "xx"), (2001, "DER Schung", None)]
    df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, lang string, gram string")
    profiles = language.fit(language.training(df))
    assert profiles.languages == ["xx", "yy", "zz"]
    out = language.predict(df, profiles)
    assert out.columns == [*df.columns, "lang_pred", "score"]
    got = {x["doc_id"]: x for x in out.collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:240]) and got[2001]["lang_pred"] == "yy"
    for i in (1001, 1002, 1003, 2000):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(0 <= x["score"] <= 1 for x in got.values())
    nothing = language.fit(df.where("lang = 'none'"))
    assert {x["lang_pred"] for x in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), profiles).count() == 0


def _ranked(text):
    """N-grams of a text, most frequent first, as the textbook has it."""
    from collections import Counter

    low = "".join(x.lower() if x.isalpha() else " " for x in text).split()
    counts = Counter()
    for w in low:
        s = f" {w} "
        for n in (1, 2, 3):
            counts.update(s[k : k + n] for k in range(len(s) - n + 1) if s[k : k + n].strip())
    return counts


def test_grams_are_those_of_padded_words():
    from collections import Counter

    for text in ("Ein Wort, noch 2 Wörter!", "a", "", "  ", "x-y"):
        got = Counter(language.gram_text(int(g)) for g in language.grams(text))
        assert got == _ranked(text)


def test_quality(spark, docs, odd):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["river", "stone", "light", "carries", "under", "the", "and", "of"]) for _ in range(n))
    good = [(i, ". ".join(say(9).capitalize() for _ in range(r.randint(3, 9))) + ".") for i in range(120)]
    bad = [(200 + i, " ".join(w.upper() + r.choice(["!!!", "$$$", " |"]) for w in say(40).split())) for i in range(40)]
    rows = [*good, *bad, *[(i if i is None else i + 900, t) for i, t in odd]]
    out = quality.score_quality(docs(rows))
    assert out.columns == [*docs([]).columns, "weak_label", "quality"]
    got = {x["doc_id"]: x for x in out.collect()}
    for i, _ in good:
        assert got[i]["weak_label"] > 0.5 and got[i]["quality"] > 0.5
    for i, _ in bad:
        assert got[i]["weak_label"] < 0.5 and got[i]["quality"] < 0.5
    assert got[901]["weak_label"] == got[902]["weak_label"] and 0 <= got[901]["quality"] <= 1
    assert quality.score_quality(docs([])).count() == 0


def test_expectation_maximisation_finds_accuracies():
    r = random.Random(1)
    rates = [0.9, 0.8, 0.7] + [0.6] * (len(quality.LABELLERS) - 3)
    counts = {}
    for _ in range(20_000):
        y = 1 if r.random() < 0.6 else -1
        code = quality.pattern([0 if r.random() < 0.3 else y if r.random() < a else -y for a in rates])
        counts[code] = counts.get(code, 0) + 1
    found = quality.expectation_maximisation(counts)
    assert abs(found.good - 0.6) < 0.05
    assert all(abs(a - b) < 0.05 for a, b in zip(found.accuracy(), rates, strict=True))
    assert all(quality.pattern(quality.votes_of(x)) == x for x in list(counts)[:50])


def _plain_votes(text):
    """The labellers, one text at a time, by the words of their rules."""
    text = text or ""
    words, letters = text.split(), [x for x in text if x.isalnum() and not x.isdecimal()]
    rows = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    ends = sum(x in ".!?…" and (k + 1 == len(text) or text[k + 1].isspace()) for k, x in enumerate(text))
    plain = sum(w.isalpha() or w[:-1].isalpha() for w in words)
    return [
        -(sum(x in r"#$%&*<>|~^_=\@+{}[]" for x in text) > 0.03 * len(text)),
        -(bool(letters) and sum(map(str.isupper, text)) > 0.35 * len(letters)),
        -(text.count("!") > 0.15 * n),
        -(len(rows) > 2 and len(set(rows)) < 0.7 * len(rows)),
        -(sum(not any(map(str.isalnum, w)) for w in words) > 0.1 * n),
        0 if n < 20 else 1 if 1 / 60 <= ends / n <= 1 / 3 else -1,
        int(n >= 8 and same <= 0.15 * n and plain > 0.97 * n),
        -(sum(map(str.isdigit, text)) > 0.15 * len(text)),
        -(same > 0.15 * n),
        -(n > 0 and not 2.5 <= sum(map(len, words)) / n <= 14),
        -(n < 8),
    ]


def test_votes_against_their_rules(odd):
    r = random.Random(4)
    kinds = ["abc", "ABC", "a.b", "!!", "--", "12", "a1", "é", "漢", "x#", "…", "end."]
    texts = [t for _, t in odd] + ["".join(r.choice(kinds) + r.choice([" ", " ", "\n", "\u3000", "\x1c"]) for _ in range(r.randint(1, 60))) for _ in range(200)]
    for k in range(0, len(texts), 30):
        got = [quality.votes_of(x) for x in quality.vote(quality.Texts(texts[k : k + 30])).tolist()]
        assert got == [_plain_votes(t) for t in texts[k : k + 30]]


def test_scorer_against_plain_sums(spark, docs):
    """Gradient and scores by dictionaries of hashed words; the same scores however the documents are dealt."""
    r = random.Random(6)
    rows = [(k, " ".join(r.choices(["Fine", "words", "here.", "##", "!!", "123", "zz" * 40], k=r.randint(0, 40)))) for k in range(60)]
    known = quality.described(docs(rows))
    labels = quality.weak_labels(known)
    weights = np.sin(np.arange(quality.SLOTS + 1))
    got_loss, got = quality._loss_and_gradient(known, labels, weights)
    want, loss = np.zeros(quality.SLOTS + 1), 0.0
    for _, text in rows:
        counts = {}
        for word in text.split():
            for slot in divmod(quality._slots[word], quality.SLOTS):
                counts[slot] = counts.get(slot, 0) + 1
        x = {s: (n / 2 / len(text.split())) ** 0.5 for s, n in counts.items()} | {quality.SLOTS: 1.0}
        z = sum(weights[s] * v for s, v in x.items())
        y = labels.posterior[int(quality.vote(quality.Texts([text]))[0])]
        loss += np.logaddexp(0, z) - y * z
        for s, v in x.items():
            want[s] += v * (1 / (1 + np.exp(-z)) - y)
    assert abs(got_loss - loss) < 1e-3 and np.abs(got - want).max() < 1e-6
    one, many = ({x["doc_id"]: x["quality"] for x in quality.score_quality(docs(rows).repartition(n)).collect()} for n in (1, 40))
    assert max(abs(one[k] - many[k]) for k in one) < 1e-9
    for _ in range(2000):
        word = "".join(r.choices("abAB1é漢.-ǅ", k=r.randint(1, 7)))
        general = quality._MARKS.sub(r"\1\1\1", quality._SAME.sub(r"\1", word.translate(quality._shapes)))
        assert quality._shape(word) == general
    assert quality._shape("AAbb12--....!") == "Aa0--...!" and quality._shape("é" * 99 + "X") == "aA"


def test_toxicity_without_one_class_to_calibrate(spark, docs):
    """Scores go by the mean ratio then, and are the same constant for all only if one class has no label at all."""
    fold = lambda i: zlib.crc32(str(i).encode()) % toxicity.FOLDS
    ids = [i for i in range(200) if fold(i) in (*toxicity.COUNTED, toxicity.CALIBRATING)]
    bad = [i for i in ids if fold(i) in toxicity.COUNTED][:9]
    rows = [(i, "grok blarg snarl " * 3 if i in bad else "the quiet river runs on") for i in ids]
    rows += [(900, "blarg snarl"), (901, "the river"), (902, None)]
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in ids], "doc_id long, quality int, toxic int")
    table = docs(rows)
    got = {x["doc_id"]: x["toxicity"] for x in toxicity.add_scores(table, toxicity.fit(table, labels)).collect()}
    assert got[900] > toxicity.THRESHOLD > got[901] and abs(got[902] - toxicity.THRESHOLD) < 1e-12
    none = toxicity.add_scores(table, toxicity.fit(table, labels.where("toxic = 0"))).collect()
    assert {x["toxicity"] for x in none} == {0.0}
