"""Odd tables: nulls, empty and long texts, repeated rows, clashing columns; and empty ones."""

import random

import pytest

CLASHING = ("_k", "_c", "row", "kept", "selected", "n", "h", "v", "component", "block", "spans", "words", "grade", "f")


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(90), prose(150)
    near = base.split()
    near[70] = "other"
    out = [None, "", " \n\t ", "word", "Two Words", "1234 !!", "\x00 \x1c\x85 ẞ Ⅷ \U0001f600 naïve ﬁn", base, base, " ".join(near), base.upper(), passage, prose(40) + " " + passage + " " + prose(30), prose(25) + "\n" + passage]
    out += ["ab " * 4000, "x" * 5000, "x" * 5001, "same line here\n" * 60, prose(20000), "é" * 700, "-\n" + "é" * 700 + "\n", "don't I'LL we've  spaced   out \t\r\n\n end "]
    out += [prose(rng.randint(1, 300)) for _ in range(30)]
    return out


def table(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["clash"] * len(CLASHING)) for r in rows], schema)


@pytest.fixture(scope="session")
def rows():
    body = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}") for i, t in enumerate(texts())]
    # a row that is there three times, two without an id
    return body + [body[7]] * 2 + [(None, "no id here but words enough to stand", None, None), (None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, []).where("false")


@pytest.fixture(scope="session")
def labels(spark, rows):
    known = [(r[0], i % 2 if i % 7 else 0, int(i % 5 == 0)) for i, r in enumerate(rows) if r[0] is not None]
    return spark.createDataFrame([*known, known[3], (None, 1, 0), (1, None, None), (10**9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark, rows):
    words = rows[12][1].split()
    items = [(1, " ".join(words[45:75])), (2, "word"), (3, None), (4, ""), (5, "absent words only here"), (6, "NAÏVE ﬁn"), (1, " ".join(words[45:75])), (None, " ".join(words[50:70])), (7, "two words"), (8, "x" * 5000), (9, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="session")
def pages(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "", "<p>é</p>" * 3000, "<p>é</p>" * 3000, "<p>b</p>"]
    body = [(i, f"http://x.example/{i}" if i else None, h) for i, h in enumerate(html)]
    return spark.createDataFrame([*body, body[2], (None, None, "<p>a</p>"), (None, "u", "only here")], "page_id long, url string, html string")
