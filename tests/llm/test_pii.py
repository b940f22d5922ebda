import hashlib
import re
import time

import numpy as np
import pytest

from kinfold.llm import pii
from kinfold.llm.queries import op11_pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def brute_base(text):
    """The rules as written, with Python's engine."""
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            passes = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and checksum(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if passes:
                out.append((k, m.start(), m.end()))
    return out


def digits(rng, n):
    return "".join(map(str, rng.integers(0, 10, n)))


def card(rng, n=16):
    head = "4" + digits(rng, n - 2)
    return head + next(str(d) for d in range(10) if checksum(head + str(d)))


def phone(rng):
    return f"({digits(rng, 3)}) 555-{digits(rng, 4)}"


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_equal_the_rules(seed):
    rng = np.random.default_rng(seed)
    parts = ["a", "é", "@", ".", "-", " ", "_", "+", "(", ")", "1", "25", "255", "256", "0", "x.y", "@b.c", "\n", "4111111111111111", "1.2.3.4", "+1 22"]
    for _ in range(400):
        text = "".join(rng.choice(parts, rng.integers(0, 40)))
        assert pii.base_spans(text) == brute_base(text), text


def test_planted_base_spans():
    rng = np.random.default_rng(8)
    text = f"é {card(rng)} x@y.z1.com, 10.0.0.255 +1 {phone(rng)}, 4111 1111 1111 1112, 999.1.1.1 x {card(rng, 19)}"
    assert pii.base_spans(text) == brute_base(text)
    assert [s[0] for s in pii.base_spans(text)] == [pii.EMAIL, pii.IP, pii.CARD, pii.CARD, pii.PHONE]


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a.", "@", "a@", "+", "+1", "1 ", "1-", "(", ":", "1:", "a at ", "9" * 40 + "."])
def test_long_runs_take_linear_time(unit):
    text = unit * (400_000 // len(unit))
    start = time.perf_counter()
    pii.candidate_spans(text, pii.base_spans(text))
    assert time.perf_counter() - start < 20


def test_candidates_touch_no_base_span():
    text = "mail to bob@host or jim at host dot org, fe80:0:0:0:1, 1.2.3.4 and 999.1.2.3, 4111.1111.1111.1112 or (743) 555-3824 and +1 (743) 555-3825"
    base = pii.base_spans(text)
    found = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.candidate_spans(text, base)]
    assert ("email", "bob@host") in found and ("email", "jim at host dot org") in found and ("ip", "fe80:0:0:0:1") in found
    assert ("ip", "999.1.2.3") in found and ("card", "4111.1111.1111.1112") in found and ("phone", "(743) 555-3824") in found
    assert not [f for f in found if "3825" in f[1] or f[1] == "1.2.3.4"]
    assert pii.instance(pii.EMAIL, "Jim at Host dot org") == pii.instance(pii.EMAIL, "jim@host.org") == "jim@host.org"


def corpus(rng, n=120):
    """Phones stand behind "call", numbers of other things behind "item" or anywhere; some phones lack the plus sign."""
    filler = "the quick brown fox jumps over a lazy dog while it rains at noon".split()
    rows, hidden, clean = [], [], []
    for i in range(n):
        before, after = " ".join(rng.choice(filler, 6)), " ".join(rng.choice(filler, 6))
        number = phone(rng)
        if i % 6 == 0:
            rows.append((i, f"{before} call {number} now é {after}"))
            hidden.append(i)
        elif i % 6 == 5:
            rows.append((i, f"{before} item {number} {after}"))
            clean.append(i)
        else:
            rows.append((i, f"é {before} call +1 {number} now {after}"))
    return rows, hidden, clean


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, id int, found string").repartition(3)
    got = pii.find_personal_data(df, **options).select("row.doc_id", "base", "added").collect()
    return [(r[0], [tuple(s) for s in r[1]], [tuple(s) for s in r[2]]) for r in got]


def test_contexts_discover_unseen_forms(spark):
    rows, hidden, clean = corpus(np.random.default_rng(1))
    texts = dict(rows)
    got = {r[0]: r for r in found(spark, rows)}
    assert all(got[i][1] == brute_base(t) for i, t in rows)
    for i in hidden:
        (kind, s, e), = got[i][2]
        assert pii.KINDS[kind] == "phone" and texts[i][s:e].endswith(re.search(r"555-\d{4}", texts[i])[0]) and texts[i][s] == "("
    assert not [i for i in got if got[i][2] and i not in hidden]


def test_unreliable_contexts_discover_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"see +1 {phone(rng)} ok") for i in range(10)] + [(100 + i, f"see nothing{i} ok") for i in range(40)]
    rows += [(500, f"see {phone(rng)} ok")]
    assert not [r for r in found(spark, rows) if r[2]]


def test_discoveries_make_new_patterns(spark):
    rng = np.random.default_rng(3)
    numbers = [phone(rng) for _ in range(20)]
    rows = [(i, f"please dial +1 {phone(rng)}") for i in range(20)]
    rows += [(100 + i, f"please dial {n}") for i, n in enumerate(numbers)]  # found in the first round
    rows += [(200 + i, f"hotline zz {n}") for i, n in enumerate(numbers)]  # makes "hotline zz _" believable
    rows += [(300, "hotline zz 743.555.0001")]
    got = {r[0]: r[2] for r in found(spark, rows)}
    assert len(got[300]) == 1 and not {r[0]: r[2] for r in found(spark, rows, rounds=1)}[300]


def test_other_spelling_of_a_seed(spark):
    rng = np.random.default_rng(4)
    number = card(rng)
    rows = [(1, f"pay {number}"), (2, f"pays {number[:4]}.{number[4:8]}.{number[8:12]}.{number[12:]} x"), (3, "pays 1234.5678.9012.3456 x")]
    got = {r[0]: r[2] for r in found(spark, rows)}
    assert [k for k, *_ in got[2]] == [pii.CARD] and got[3] == []


def test_copies_do_not_make_a_pattern(spark):
    rng = np.random.default_rng(5)
    seed, other = phone(rng), phone(rng)
    rows = [(i, f"ring +1 {seed}") for i in range(50)] + [(99, f"ring {other}")]
    assert not [r for r in found(spark, rows) if r[2]]


def test_nulls_empty_texts_repeated_rows(spark):
    rows = [(None, "a@b.c"), (None, "a@b.c"), (1, None), (2, ""), (3, "1.2.3.4 " * 3000), (3, "x")]
    got = sorted(found(spark, rows), key=str)
    assert sorted(map(str, got)) == sorted(str((i, brute_base(t or ""), [])) for i, t in rows)
    assert found(spark, [r for r in rows if False] or [(1, None)]) == [(1, [], [])]


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_spans_of_two_kinds_do_not_overlap(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"number +1 {phone(rng)} or {card(rng)}") for i in range(30)] + [(50, "number 123456789012 or none")]
    for _, _, added in found(spark, rows):
        assert all(a[2] <= b[1] for a, b in zip(sorted(added, key=lambda s: s[1]), sorted(added, key=lambda s: s[1])[1:], strict=False))


def test_query(spark, sf_dir):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op11_pii(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = brute_base(texts[r["doc_id"]])
        names = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == j for k, *_ in base) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(names) <= set(spans) and len(set(spans)) == len(spans)
        order = [(pii.KINDS.index(s.split(":")[0]), *map(int, s.split(":")[1:])) for s in spans]
        assert order == sorted(order)
