import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import quality


def plain(text):
    """The base counts as the contract words them."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab#|<é語", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", "🙂"]), max_size=80).map("".join))
def test_base_counts(text):
    assert quality.base_counts(text.encode())[0] == plain(text)


def test_distance():
    a, b = np.array([1.0, 0, 3]), np.array([2.0, 0, 6])
    assert quality.distance(a, b) < 1e-9 and quality.distance(np.array([1.0, 0]), np.array([0, 5.0])) == 1.0
    p, q = np.array([0.2, 0.8]), np.array([0.6, 0.4])
    m = (p + q) / 2
    assert abs(quality.distance(p, q) ** 2 - 0.5 * sum(x @ np.log2(x / m) for x in (p, q))) < 1e-12


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(5)
    common = ["the", "of", "and", "to", "in", "is"]

    def prose(n, seed):
        r = np.random.default_rng(seed)
        return " ".join(common[r.integers(6)] if r.random() < 0.4 else "".join(r.choice(list("etaoinshrdlu"), r.integers(4, 9))) for _ in range(n)) + "."

    rows = [(i, prose(int(rng.integers(60, 300)), i), "en", i) for i in range(60)]
    junk = [(100 + i, " ".join(w.upper() + "!!" for w in prose(150, 500 + i).split()), "en", i) for i in range(4)]
    junk += [(200 + i, " ".join(w + "***" for w in prose(150, 700 + i).split()), "en", i) for i in range(4)]
    odd = [(300, None, "en", 0), (301, "", None, 0), (None, prose(80, 9), "xx", 0), (1, rows[1][1], "en", 0)]
    df = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string, kept int")
    got = quality.judge(df, quality.references(df)).collect()
    assert len(got) == len(rows + junk + odd)
    texts = {(r[0], r[1]) for r in rows + junk + odd}
    by = {i: t for i, t in texts}
    for r in got:
        assert {k: r[k] for k in plain("")} == plain(by[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id < 100)
    kept = quality.accepted(df, quality.references(df))
    assert kept.columns == df.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted([-1, 1, *range(60)])
    empty = df.limit(0)
    assert quality.judge(empty, quality.references(empty)).count() == 0
    none = spark.createDataFrame([], "lang string, ref string")
    assert quality.judge(df, none).where("kept").count() == 70


def test_verdicts_against_a_plain_version(spark):
    """References, distances and verdicts by the definition; languages without enough words, or without common ones, give no verdict about words."""
    r = np.random.default_rng(3)
    common = ["который", "потому", "сейчас", "человек", "вместе", "сегодня"]

    def prose(n):
        return " ".join(common[r.integers(6)] if r.random() < 0.5 else "".join(r.choice(list("абвгдежз"), 9)) for _ in range(n))

    rows = [(i, prose(200), "ru") for i in range(40)]
    rows += [(100, " ".join(common[0] if i % 3 else "".join(r.choice(list("абвгдежз"), 9)) for i in range(200)), "ru"), (101, rows[0][1], None), (102, rows[0][1].upper(), "RU")]
    rows += [(103, " ".join(rows[100 % 40][1] for _ in range(1)), "ru"), (103, rows[3][1], "ru"), (104, "", "ru"), (105, None, None), (106, prose(59), "ru"), (107, prose(60), "ru"), (108, "сейчас " * 200, "ru")]
    rows += [(200, " ".join("".join(r.choice(list("pqrstuvw"), 9)) for _ in range(60)), "zz")]
    rows += [(300 + i, " ".join("".join(r.choice(list("天地玄黄宇宙洪荒"), 12)) for _ in range(60)), "zh") for i in range(30)]
    rows += [(400, " ".join(prose(150) for _ in range(300)), "ru")]  # long
    df = spark.createDataFrame([(*x, "a", "b") for x in rows], "doc_id long, text string, lang string, ref string, __ref string")
    base = {k: plain(t) if len(t or "") < 50_000 else quality.base_counts(t.encode())[0] for k, (_, t, _) in enumerate(rows)}
    words, classes = {}, {}
    for k, (_, t, lang) in enumerate(rows):
        if not base[k]["base_failed"]:
            words.setdefault(lang or "", Counter()).update(t.encode().lower().split())
            classes[lang or ""] = classes.get(lang or "", 0) + quality.class_histogram(np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256))

    def js(a, b):
        p, q = np.asarray(a, float) / sum(a), np.asarray(b, float) / sum(b)
        return sum(0.5 * x * np.log2(2 * x / (x + y)) for u, v in ((p, q), (q, p)) for x, y in zip(u, v) if x) ** 0.5 if not np.allclose(p, q) else 0.0

    want = Counter()
    for k, (i, t, lang) in enumerate(rows):
        own, n = words.get(lang or "", Counter()), base[k]["n_words"]
        chars = dist = None
        if n >= 60 and sum(own.values()) >= 1000:
            listed = sorted(own.items(), key=lambda x: (-x[1], x[0]))[:40]
            chars = js(quality.class_histogram(np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)), classes[lang or ""])
            if sum(c for _, c in listed) >= 0.1 * sum(own.values()):
                found = Counter(t.encode().lower().split())
                here = [found[w] for w, _ in listed]
                dist = js([*here, n - sum(here)], [*(c for _, c in listed), sum(own.values()) - sum(c for _, c in listed)])
        kept = not base[k]["base_failed"] and not (chars or 0) > 0.31 and not (dist or 0) > 0.38
        want[i, n, chars is None, dist is None, round(chars or 0, 6), round(dist or 0, 6), kept] += 1
    refs = quality.references(df)
    got = Counter((x.doc_id, x.n_words, x.char_distance is None, x.word_distance is None, round(x.char_distance or 0, 6), round(x.word_distance or 0, 6), x.kept) for x in quality.judge(df, refs).collect())
    assert got == want and not quality.judge(df, refs).where("doc_id = 100").first().kept
    kept = quality.accepted(df, refs)
    assert kept.columns == df.columns and Counter(x.doc_id for x in kept.collect()) == Counter(k[0] for k in want.elements() if k[-1])
    old, quality.BROADCAST_BYTES = quality.BROADCAST_BYTES, 0
    try:
        assert Counter(x.doc_id for x in quality.accepted(df, refs).collect()) == Counter(x.doc_id for x in kept.collect())
    finally:
        quality.BROADCAST_BYTES = old
