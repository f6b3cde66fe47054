"""Language identification: Viterbi against all labellings, planted spans, held-out accuracy, edge cases."""

import itertools
import random

import numpy as np
import pytest

from recordloom.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "er"], "cc": ["eau", "ion", "que", "é"], "ru": ["ка", "ло", "ми", "ту"], "uk": ["ва", "рі", "її", "же"]}
SCHEMA = "doc_id long, text string, lang string, spans string, score double"


def say(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(2, 4))) for _ in range(n))


def test_viterbi_is_best():
    r = np.random.default_rng(1)
    scores = r.normal(0, 6, (9, 3)).astype(np.float32)
    at, ends = r.integers(0, 9, 23), np.array([0, 6, 6, 7, 14, 23 - 2, 23])
    for switch in (0.5, 4.0, 1e6):
        label, start = langid.viterbi(scores, at, ends, switch), 0
        for end in ends:
            own = scores[at[start:end]]
            value = lambda path, own=own: sum(own[k, s] for k, s in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
            best = max((value(p) for p in itertools.product(range(3), repeat=end - start)), default=0)
            assert value(tuple(label[start:end])) == pytest.approx(best, abs=1e-3)
            start = end


def test_identify(spark):
    r = random.Random(3)
    rows = [(i, say(r, lang, r.choice([1, 3, 40])), lang) for i, lang in enumerate(r.choices(list(SYLLABLES), k=500))]
    mixed = [(say(r, "aa", 30), "aa"), (say(r, "cc", 30), "cc"), (say(r, "ru", 30), "ru")]
    odd = [(None, say(r, "bb", 20), None), (600, None, "aa"), (601, "", "bb"), (602, "123 !? ½ ²", "cc"), (603, " ".join(t for t, _ in mixed), None), (604, "漢字 漢字", None), (605, say(r, "bb", 6000), None), (606, "I" * 40_000, None), *[rows[0]] * 2]
    docs = spark.createDataFrame([(i, t, lang, "x", 0.0) for i, t, lang in [*rows, *odd]], SCHEMA).repartition(3)
    model = langid.fit(docs)
    assert model.languages == tuple(sorted(SYLLABLES)) and not model.written_in[langid.NAMES.index("cyrillic"), :3].any()
    out = [r for r in langid.identify(docs, model).collect()]
    assert len(out) == len(rows) + len(odd) and all(0 <= x.score <= 1 for x in out)
    by_id = {x.doc_id: x for x in out}
    wrong = sum(by_id[i].lang_pred != lang for i, _, lang in rows)
    assert wrong <= 2
    assert by_id[None].lang_pred == by_id[605].lang_pred == "bb" and [by_id[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3 and by_id[602].spans == []
    # a text of three languages: spans begin at their words
    text, spans = odd[4][1], by_id[603].spans
    assert [x.lang for x in spans] == [lang for _, lang in mixed] and [text[x.start : x.end].strip() for x in spans] == [t for t, _ in mixed]
    assert by_id[604].lang_pred in model.languages
    held = {r.doc_id: (r.held_out, r.lang_pred) for r in langid.predict(docs).collect()}
    assert sum(h for h, _ in held.values()) > 50 and all(held[i][1] == by_id[i].lang_pred for i, _, _ in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, say(r, lang, 9), lang, "x", 0.0) for i, lang in enumerate(r.choices(["aa", "bb"], k=200))], SCHEMA)
    other = docs.withColumn("lang", langid.F.when(langid.held_out(), "zz").otherwise(docs.lang))
    assert sorted(langid.predict(docs).collect()) == sorted(langid.predict(other).collect())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None, "x", 0.0), (2, None, "aa", "x", 0.0)], SCHEMA)
    assert {r.lang_pred for r in langid.predict(docs).collect()} == {"und"}
    assert langid.predict(docs.limit(0)).count() == 0
