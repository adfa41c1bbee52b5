"""Secret models on identifiers and random strings, findings in great number, long letter runs and null ids."""

from __future__ import annotations

import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, secret_scan
from pulsegrid.llm.word_features import WIDTH, find_words, word_features

IDENTIFIERS = [
    "com/google/common/collect/ImmutableSortedMultiset", "https_static_assets_production_bundle_version",
    "AbstractSingletonProxyFactoryBeanImplementation", "my-long-kebab-case-component-name", "MAX_CONNECTION_RETRY_COUNT",
]


# What is ordinary follows the language of the corpus; these are English words, few of them parts of the identifiers.
WORDS = """the weather changed quickly while farmers gathered their harvest before winter reached northern valleys and several merchants
brought silver lanterns across narrow bridges toward crowded markets where children listened to strange musicians playing wooden
instruments beside glowing fires important decisions require patience because complicated questions seldom offer simple answers
scientists measured temperature pressure and humidity every morning then published observations about climate patterns throughout
mountain regions government officials explained administrative procedures regarding property taxation whenever citizens complained
industrial companies manufacture machines vehicles computers and telephones using aluminium copper plastic glass and rubber
beautiful gardens attract butterflies squirrels rabbits and thousands of quietly humming bees during extraordinarily warm summers
teachers encourage students to examine evidence compare arguments evaluate conclusions and communicate effectively with others
historical documents describe ancient kingdoms powerful emperors terrible battles clever diplomats and forgotten languages
fishermen repair broken nets unload heavy boxes sharpen knives exchange jokes and watch quartz coloured clouds over the horizon""".split()


def prose(seed: int, words: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(words))


def test_identifiers_are_ordinary_and_random_strings_are_not(spark):
    docs = spark.createDataFrame([(i, prose(i)) for i in range(200)], "doc_id long, text string")
    model = secret_scan.fit(secret_scan.labelled_samples(docs))
    assert model.missed <= 0.01 and model.false <= 0.01
    draw = random.Random(3)
    keys = ["".join(draw.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (20, 24, 32, 40) * 5]
    rows = [(i, f"see {t}.") for i, t in enumerate([*IDENTIFIERS, *keys])]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert not any(found[i] for i in range(len(IDENTIFIERS)))
    assert sum(bool(found[i]) for i in range(len(IDENTIFIERS), len(rows))) >= len(keys) - 1


def test_many_findings_and_overlaps(spark):
    key = "Zq8vT3xWm9LpRk2YbNc7HdFg4JsA5uEo"
    many = " ".join(f"token={i:06d} é {key} {'ab12' * 6}{i % 10}" for i in range(3000))
    overlaps = f"secret={key}/deadbeefdeadbeefdeadbeef AKIA{'Q' * 16}{key} {key}=password:abcdef"
    docs = spark.createDataFrame([(1, many), (2, overlaps), (3, None), (4, "")], "doc_id long, text string")
    model = secret_scan.fit(secret_scan.labelled_samples(spark.createDataFrame([(i, prose(i)) for i in range(50)], "doc_id long, text string")))
    spans = {r["doc_id"]: r for r in secret_scan.find_secrets(docs, model).collect()}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, model).collect()}
    assert len(spans[1]["spans"]) == 9000 and spans[3]["spans"] == spans[4]["spans"] == []
    for i, text in ((1, many), (2, overlaps)):
        base = [tuple(s) for s in spans[i]["base"]]
        tokens = [(m.start(), 3, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text)]
        free = [t for t in tokens if key in text[t[0]:t[2]] and not any(b[0] < t[2] and t[0] < b[2] for b in base)]
        assert [tuple(s) for s in spans[i]["spans"]] == sorted(base + free)
        want, at = "", 0
        for start, _, end in sorted(base + free):
            want += text[at:start] + "[SECRET]" if start >= at else ""
            at = max(at, end)
        assert clean[i] == want + text[at:]
    assert (clean[3], clean[4]) == (None, "")


def test_every_letter_of_a_long_run_is_seen():
    run = "".join(random.Random(1).choice(string.ascii_lowercase) for _ in range(1000))
    for n in (1, 24, 25, 35, 36, 37, 1000):
        pieces = find_words(f"7 {run[:n]}, x")
        assert pieces.pop() == "x" and all(len(p) <= WIDTH for p in pieces)
        assert "".join([pieces[0], *(p[WIDTH // 2:] for p in pieces[1:])]) == run[:n]
    assert find_words("") == find_words("12 _ 3") == []
    middle = [word_features(find_words(run[:100] + m + run[100:200]))[2] for m in ("q", "z")]
    assert not np.array_equal(*middle)


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix_sources(docs, {"s": 1.0}, seed=1).select("doc.text", "shuffle_key").collect()
    assert abs(len(mixed) - 3000) < 300 and len({r["shuffle_key"] for r in mixed}) == len(mixed)
    assert abs(len({r["text"] for r in mixed}) / 3000 - (1 - np.exp(-1))) < 0.05
