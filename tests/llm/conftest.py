from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard int, spans string"


def _words(r: random.Random, n: int, vocab: int = 400) -> list[str]:
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def make_rows() -> list[tuple]:
    """Copies, near copies, shared passages, empty and null texts, very long ones, ties and repeated rows."""
    r = random.Random(5)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "One TWO", "a b c d", "ÄÖ ä ö straße ÑANDÚ 数据 😀 x"]
    base = [_words(r, 120) for _ in range(12)]
    for b in base:
        texts.append(" ".join(b))
        for k in (1, 3, 6, 40):
            near = list(b)
            near[10 : 10 + k] = _words(r, k)
            texts.append("\n".join(" ".join(near[i : i + 30]) for i in range(0, 120, 30)))
    passage = _words(r, 60)
    for _ in range(8):
        texts.append(" ".join(_words(r, 90) + passage + _words(r, r.randrange(5, 90))))
    texts += [" ".join(base[0])] * 5 + ["same line here\n" * 12, "a a a a a a " * 30, "x " * 20_000, " ".join(_words(r, 20_000, 5000))]
    texts += ["###$$$ %%% word " * 30, "mail jo.e@mail.example.com or +1 (017) 555-7713, 10.0.0.1 and 999.1.1.1", "card 4539 1488 0343 6467 not 4539 1488 0343 6468", "1.2.3.4.5.6.7.8 a@b.c_d@e.f +12"]
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, len(t or ""), -1, 99, "clash") for i, t in enumerate(texts)]
    return rows + rows[8:11]  # repeated rows


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
