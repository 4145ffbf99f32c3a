"""Licence scan, expiring click windows and spelling variants against plain versions, with nulls, repeats and empty tables."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from quern.llm import click_dedup, license_scan, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, word string, n int, h long"
EPOCH = datetime.datetime(1970, 1, 1)


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


@pytest.fixture(scope="module")
def licensed(spark):
    mit = next(t.text for t in license_scan.TEXTS if t.label == "mit-text")
    edited = mit.split()
    edited[20:20] = ["very", "new"]
    del edited[50]
    rows = [
        (1, "The MIT License. mit-license, MIT\nLICENSE; apache licenses"), (2, "x " * 500 + mit + " y" * 900 + " Mit License"), (3, " ".join(edited)), (4, None), (5, ""), (6, "GNU General Public License general public  LICENSE general public"),
        (7, " ".join(mit.split()[:40])), (7, "apache license"), (None, "APACHE license é mit license"), (None, None), (8, "mit license " * 3000), (9, "mıt license Kapache license"),
    ]
    return spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], DOCS).repartition(3), rows


def test_license_scan(licensed):
    docs, rows = licensed
    got = license_scan.scanned(docs).collect()
    phrases = {t.label: t.text.split() for t in license_scan.PHRASES}
    want = []
    for doc, text in rows:
        w = license_words(text)
        at = sorted((i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p)
        want.append((doc, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({k for _, k in at}))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    labels = {r.doc_id: (r.labels, r.score) for r in got if r.doc_id not in (None, 7)}
    assert labels[2] == ("mit,mit-text", 1.0) and labels[3][0] == "mit-text" and 0.8 <= labels[3][1] < 1
    assert labels[4] == labels[5] == ("", 0.0)
    assert sorted(r.labels for r in got if r.doc_id == 7) == ["", "apache"]


def test_license_spans_by_shuffle(licensed, monkeypatch):
    docs, _ = licensed
    want = sorted(map(str, license_scan.scanned(docs).collect()))
    monkeypatch.setattr(license_scan, "FEW", 1)
    assert sorted(map(str, license_scan.scanned(docs).collect())) == want
    spans = license_scan.spans(license_scan.votes(docs)).where("doc_id = 2 AND label = 'mit-text'").collect()
    assert [(s["first"], s["last"] - s["first"], s["share"]) for s in spans] == [(500, len(license_words(license_scan.TEXTS[4].text)), 1.0)]
    with pytest.raises(ValueError):
        license_scan.scanned(docs, (license_scan.Template("x", "one", True),))


def test_license_scan_of_nothing(spark):
    assert license_scan.scanned(spark.createDataFrame([], DOCS)).collect() == []


def micros(t):
    return (t - EPOCH) // datetime.timedelta(microseconds=1)


def plain_windows(rows):
    text = lambda x: "" if x is None else str(x)
    events = []
    for click, ts, arrived, client, kind, value, props in rows:
        if click is None or click < 0 or arrived is None:
            continue
        for j in range(click % 3 + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            cents = None if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
            payload = "|".join([text(client), text(kind), text(cents), text(None if ts is None else micros(ts)), text(props), str(c % 3)])
            events.append((click, hour, hour + c // 10 % 200, hashlib.sha256(payload.encode()).hexdigest()))
    low, high = min(e[2] for e in events), max(e[2] for e in events)
    most, windows, out = None, {}, []
    for b in range(8):
        batch = [e for e in events if (e[2] - low) * 8 // (high - low + 1) == b]
        for click, hour, _, h in sorted(batch, key=lambda e: (e[0], e[1], e[3])):
            if most is not None and hour < most - 96:
                continue
            w = windows.get(click)
            if w is None or hour > w[0] + 24:
                if w:
                    out.append((click, w[0], b, *w[1:]))
                windows[click] = [hour, 0, 0, 0, h]
            else:
                w[1] += 1
                if h != w[4]:
                    w[2] += 1
                    w[3] += zlib.crc32(h.encode())
        most = max((e[1] for e in batch), default=most) if most is None else max([most, *(e[1] for e in batch)])
        for click in [k for k, w in windows.items() if b == 7 or (most is not None and w[0] + 24 < most - 96)]:
            w = windows.pop(click)
            out.append((click, w[0], b, *w[1:]))
    return sorted(out)


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, j int, c int, hour int"


@pytest.fixture(scope="module")
def clicks():
    r = random.Random(5)
    rows = []
    for i in range(400):
        at = EPOCH + datetime.timedelta(days=19_700, seconds=r.randrange(60 * 86_400), microseconds=r.randrange(10**6))
        # click 5 holds a third of all rows; some rows repeat as a whole
        row = (r.choice([5, i % 90, i % 90]), r.choice([None, at]), at.replace(microsecond=0), r.choice([None, 7, 8]), r.choice([None, "view", "a|b"]), r.choice([None, float("nan"), float("inf"), -3.005, 1.005, 87.6]), r.choice([None, '{"k": 1}', ""]))
        rows += [row] * r.choice([1, 1, 1, 2])
    return [*rows, (None, None, EPOCH, 1, "x", 1.0, ""), (3, None, None, 1, "x", 1.0, ""), (-4, None, EPOCH, 1, "x", 1.0, "")]


@pytest.mark.parametrize("split_rows", [100_000, 20])
def test_click_windows(spark, clicks, split_rows):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # times have no zone: the session's is not used
    try:
        df = spark.createDataFrame([(*c, 1, 2, 3) for c in clicks], CLICKS).repartition(3)
        got = [tuple(x) for x in click_dedup.windows(df, split_rows=split_rows).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(got) == plain_windows(clicks)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", None) is None  # as before


def test_click_windows_of_nothing(spark):
    assert click_dedup.windows(spark.createDataFrame([], CLICKS)).collect() == []


def plain_variants(rows):
    n = defaultdict(int)
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: f for w in n if by[w] and n[f := min(by[w], key=lambda x: (-n[x], x))] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(by[w]), n[form[w]] if w in form else 0) for w in n)


@pytest.fixture(scope="module")
def spelled():
    r = random.Random(3)
    base = ["necessary", "separate", "Éclairage", "naïveté", "aaaaaaa", "aaaaaaaa", "interior", "intérior", "ÿÿÿÿÿÿÿ×÷"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(r.randint(1, 120)):
            w = r.choice(base[:2] if r.random() < 0.7 else base)
            if r.random() < 0.15:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("aeé") + w[at + 1 :], w[:at] + r.choice("aeé") + w[at:]])
            words.append(w)
        rows.append((i % 140, r.choice([" ", ", ", "1", "\n"]).join(words)))
    return [*rows, (None, "necessary necesary"), (None, None), (200, None), (201, ""), (202, "rarely " + "x" * 50_000), (203, "separater " * 30 + "separaters " * 3)]


@pytest.mark.parametrize("split", [20_000, 2])
def test_spelling_variants(spark, spelled, split):
    docs = spark.createDataFrame([(*x, "w", 1, 2) for x in spelled], DOCS).repartition(3)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(docs, split).collect())
    want = plain_variants(spelled)
    assert got == want and any(w[2] != w[1] and w[1] for w in want) and len(want) > 100


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.near("aab", "ab") and spelling.near("ab", "abb") and not spelling.near("ab", "ab") and not spelling.near("abcd", "ab")
    assert {x[1] for x in spelling.halves("abcdefg")} == {"abc", "defg"} and len(spelling.probes("abcdefgh")) == 4


def test_halves_meet():
    """Every word one edit away has a half among the probes."""
    r = random.Random(9)
    for _ in range(3000):
        w = "".join(r.choice("ab") for _ in range(r.randint(7, 12)))
        at = r.randrange(len(w))
        other = r.choice([w[:at] + w[at + 1 :], w[:at] + "c" + w[at + 1 :], w[:at] + "c" + w[at:]])
        assert set(spelling.halves(other)) & spelling.probes(w)


