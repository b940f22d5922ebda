"""License scan: phrase places against a direct search, chains against planted wordings."""

import random

from kinfold.llm import licenses
from kinfold.llm.text import letter_words


def scan(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    rows = licenses.scan_licenses(docs, **options).collect()
    assert len(rows) == len(texts)
    return {r["row"]["doc_id"]: r for r in rows}


def test_phrase_places_against_direct_search(spark):
    rng = random.Random(2)
    vocab = ["Apache", "license", "MIT", "gnu", "general", "public", "CC", "by", "the", "und", "version", "licensed", "under"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 4, 40]))) for _ in range(150)]
    texts += [None, "", "gnu general public license " * 50, "mit-license, CC.BY", "x" * 100_000 + " mit license"]
    got = scan(spark, texts)
    for i, text in enumerate(texts):
        words, places = letter_words(text), []
        for phrase, label in licenses.PHRASES:
            p = phrase.encode().split()
            places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_places"]) == (len(words), len(places))
        assert r["place_labels"] == sorted({label for _, label in places})
        assert (r["first_place"], r["last_place"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert 0 <= r["best"] <= 1
        assert not places or r["best"] == 1


def test_longest_matches_against_direct_search():
    rng = random.Random(4)
    vocab = [b"a", b"b", b"c", b"d"]
    templates = [tuple(rng.choice(vocab) for _ in range(rng.randint(5, 14))) for _ in range(6)]
    scanner = licenses.LicenseScanner([(b" ".join(t).decode(), str(i)) for i, t in enumerate(templates)], [], 3)
    for _ in range(200):
        words = [rng.choice([*vocab, b"zz"]) for _ in range(30)]
        whole = [(at, t) for t, body in enumerate(templates) for at in range(30) if tuple(words[at : at + len(body)]) == body]
        _, chains = scanner.scan(words)
        for at, t in whole:
            assert any(c == 1.0 and n == t for n, _, _, c in chains), (words, at, t)
        for t, first, last, share in chains:
            assert 0 <= first <= last < 30
            assert 0 < share <= 1


def test_templates_with_gaps_and_repeats(spark):
    body = licenses.TEMPLATES[0][0].split()
    changed = body[:20] + ["WORD", "MORE"] + body[22:]
    texts = [" ".join(["lead"] * 30 + changed + ["tail"] * 9), "All rights reserved.", " ".join(body[:9]), "Licensed under CC BY-NC 4.0.\n" * 400]
    got = scan(spark, texts)
    spans = [s for s in got[0]["spans"] if s["template"] == 0]
    assert spans and spans[0]["label"] == "mit"
    assert (spans[0]["first"], spans[0]["last"]) == (30, 30 + len(changed) - 1)
    assert 0.9 < spans[0]["coverage"] < 1
    assert [s["label"] for s in got[1]["spans"]] == ["all-rights-reserved"]
    assert got[2]["spans"] == [] and got[2]["best"] > 0
    assert got[3]["n_places"] == 400
    assert {s["label"] for s in got[3]["spans"]} == {"cc-by-nc-4.0"}


def test_template_within_a_longer_one(spark):
    texts = ["Licensed under the Apache License, Version 2.0. The project is ...", "Licensed under the Apache License, Version 2.0."]
    for r in scan(spark, texts).values():
        assert [(s["label"], s["template"], s["first"], s["last"], s["coverage"]) for s in r["spans"]] == [("apache-2.0", 3, 0, 7, 1.0)]


def test_all_maximal_matches_of_nested_templates_against_direct_search():
    rng = random.Random(6)
    vocab = [b"a", b"b", b"c"]
    for _ in range(40):
        body = [rng.choice(vocab) for _ in range(rng.randint(8, 16))]
        templates = [body, body[: len(body) // 2], body[3:7], body[2:] + [b"d"] + body[:4], [b"a", b"a", b"b"] * 2]
        phrases = [(b" ".join(body[1:6]).decode() + " e", "p")]
        scanner = licenses.LicenseScanner([(b" ".join(t).decode(), str(k)) for k, t in enumerate(templates)], phrases, 4)
        words = [rng.choice([*vocab, b"d", b"zz"]) for _ in range(10)] + body[: rng.randint(4, len(body))] + [b"e"] + body[1:6] + [b"e", b"d"]
        found = []
        scanner._chains = lambda t, matches, found=found: found.extend((t, *m) for m in matches) or []
        scanner.scan(words)
        expected = []
        for t, text in enumerate(templates):
            for i in range(len(words)):
                for j in range(len(text)):
                    n = 0
                    while i + n < len(words) and j + n < len(text) and words[i + n] == text[j + n]:
                        n += 1
                    if n >= min(4, len(text)) and not (i and j and words[i - 1] == text[j - 1]):
                        expected.append((t, i, j, n))
        assert sorted(found) == sorted(expected)


def test_empty_table(spark):
    assert scan(spark, []) == {}


def test_many_similar_templates_find_the_right_one():
    """A family of templates that share most of their words: each scan notes only what breaks off."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(60)}" for _ in range(120)]
    family = [" ".join(w if rng.random() > 0.03 else f"x{rng.randrange(500)}" for w in base) for _ in range(60)]
    scanner = licenses.LicenseScanner([(t, f"l{i}") for i, t in enumerate(family)], (), 5)
    for i in (0, 17, 59):
        _, chains = scanner.scan([w.encode() for w in ("pad " * 7 + family[i] + " pad").split()])
        best = max(chains, key=lambda c: c[3])
        assert (best[0], best[1], best[3]) == (i, 7, 1.0) or family[best[0]] == family[i]


def test_a_very_long_text_is_scanned_to_its_end(spark):
    docs = spark.createDataFrame([(1, "pad " * 200_000 + "released under the MIT license")], "doc_id long, text string")
    got = licenses.scan_licenses(docs).first()
    assert (got["n_words"], got["n_places"], got["first_place"]) == (200_005, 1, 200_003)
