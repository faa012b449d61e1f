import time

import numpy as np
import pyarrow as pa

from mergestone.llm import license_scan as L
from mergestone.llm.license_templates import TEMPLATES
from mergestone.llm.word_hashes import hashes_of, runs


def filler(rng, n):
    return [f"w{i}" for i in rng.integers(0, 300, n)]


def brute(text):
    """Licences of which some stretch of the template's length holds four fifths of the shingles."""
    out = set()
    s = runs(hashes_of(text), 3).tolist()
    for name, notices in TEMPLATES.items():
        for notice in notices:
            want = set(runs(hashes_of(notice), 3).tolist())
            n = len(runs(hashes_of(notice), 3))
            if any(len(want & set(s[i : i + n])) >= 0.8 * len(want) for i in range(max(1, len(s)))):
                out.add(name)
    return out


def test_every_template_at_every_offset():
    rng, scanner = np.random.default_rng(0), L.Scanner(TEMPLATES)
    for name, notices in TEMPLATES.items():
        for notice in notices:
            for offset in range(0, 40, 3):
                text = " ".join([*filler(rng, offset), notice.upper(), *filler(rng, 30)])
                got = scanner.scan(text)
                assert any(g[0] == name and g[1] == 1 and g[2] == offset and g[3] == len(notice.split()) for g in got), (name, offset, got)


def test_changed_notices_and_clean_texts():
    rng, scanner = np.random.default_rng(1), L.Scanner(TEMPLATES)
    for _ in range(150):
        notice = [n for ns in TEMPLATES.values() for n in ns][rng.integers(0, 17)].split()
        for _ in range(rng.integers(0, 3)):
            notice[rng.integers(0, len(notice))] = "changed"
        text = " ".join([*filler(rng, rng.integers(0, 50)), *notice, *filler(rng, rng.integers(0, 50))])
        assert {g[0] for g in scanner.scan(text)} == brute(text)
    assert scanner.scan(" ".join(filler(rng, 5000)) + " licensed under the sun of version 2.0") == []


def test_texts_together_are_as_texts_alone():
    rng, scanner = np.random.default_rng(2), L.Scanner(TEMPLATES)
    texts = [None, ""] + [" ".join([*filler(rng, rng.integers(0, 20)), *(n for ns in TEMPLATES.values() for n in ns if rng.random() < 0.1), *filler(rng, rng.integers(0, 20))]) for _ in range(60)]
    assert scanner.scan_all(pa.array(texts, pa.string())) == [scanner.scan(t) for t in texts]


def test_many_notices_in_one_text():
    scanner = L.Scanner(TEMPLATES)
    began = time.thread_time()
    got = scanner.scan("Licensed under the Apache License, Version 2.0. " * 6000)
    assert len(got) == 6000 and [g[2] for g in got] == list(range(0, 42_000, 7)) and time.thread_time() - began < 20


def test_words_are_bare():
    for text, plain in [('"Hello," (WORLD)...', "hello world"), ("*" * 300 + "x" + "." * 300 + " " + "_" * 200, "x " + "_" * 200), ("it's a-b", "it's a-b")]:
        assert hashes_of(text).tolist() == hashes_of(plain).tolist()


def test_scan(spark):
    rows = [(1, "a b. Released under the MIT License.\nMore.", "x"), (1, "a b. Released under the MIT License.\nMore.", "x"), (2, None, "x"), (3, "", "y"), (None, "Licensed under CC BY-NC 4.0.", "z"), (4, "x " * 60000 + "Licensed under the Apache License, Version 2.0. " * 2, "z"), (5, "nothing here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string").repartition(2)
    got = sorted(map(tuple, L.scan_licenses(df).collect()), key=str)
    assert got == sorted([(1, "MIT", 1.0, 2, 5), (1, "MIT", 1.0, 2, 5), (None, "CC-BY-NC-4.0", 1.0, 0, 5), (4, "Apache-2.0", 1.0, 60000, 7), (4, "Apache-2.0", 1.0, 60007, 7)], key=str)
    assert L.scan_licenses(df.limit(0)).count() == 0
