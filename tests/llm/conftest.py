import random

import pytest

#: Columns that operators use for themselves, and a name that needs quoting.
CLASHES = ["_key", "_spans", "_more", "_part", "_KEY_", "sequence_id", "Offset", "certified", "part", "kept", "score", "a.b", "_h", "spans"]
DDL = "doc_id long, text string, lang string, source string, n_chars long, key long, node string, label int, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus():
    """Small documents: copies, near copies, shared passages, long and short texts, nulls, repeated rows."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(25)]
    passage = prose(rng, 70)
    texts = list(base)
    texts += [base[0]] * 5 + [base[1].upper()]
    for b in base[:8]:
        words = b.split()
        for k in range(4):
            w = list(words)
            for _ in range(k % 3 + 1):
                w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    texts += [prose(rng, 15) + "\n" + passage + "\n" + prose(rng, 15) for _ in range(6)]
    texts += [None, "", "  \n\t", "one", "One two three four", "one two three FOUR", "aa " * 900, "abc" * 400, prose(rng, 4000), "  odd \n\n spaces  ", "Ünïcödé <|endoftext|> 漢字", "x y z"]
    rows = [(i if i % 17 else 1000 + i, t, "en", f"src{i % 3}", len(t or ""), i, "clash", i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[40]]
    rows.append((None, base[2], "en", "s", 1, 1, "n", 1))
    return [(*r, *(f"{c} of {r[0]}" for c in CLASHES)) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
